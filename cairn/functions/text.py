"""Text functions as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the two tokenizers take as a token.
MIXED_TOKEN = "[a-zA-Z0-9]+|[\\u4e00-\\u9fff]+"
ASCII_TOKEN = "[a-zA-Z0-9_]+"

# Words that negate what follows them in a sentence.
NEGATIONS = ["no", "without", "absent", "negative for"]

# Phrases that name an imaging finding in a report.
IMAGING_PHRASES = {
    "consolidation": ["consolidation", "infiltration", "opacity"],
    "multilobar": ["multilobar", "bilateral", "multiple lobes"],
    "pleural_effusion": ["pleural effusion", "effusion"],
    "atelectasis": ["atelectasis"],
    "necrotizing_pneumonia": ["necrotizing", "necrosis", "cavitation"],
    "rapid_progression": ["rapid progression", "progressed", "worsening"],
}


def mixed_tokens(text: Column) -> Column:
    """Lower-case ASCII words and whole runs of CJK characters, repeats kept; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(MIXED_TOKEN), 0), F.lower)


def token_set(text: Column) -> Column:
    """Distinct lower-case ASCII words, ``_`` being part of a word; empty for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN), 0)), F.array().cast("array<string>"))


def bag_score(tokens: Column, haystack: Column) -> Column:
    """How many tokens, repeats counted, occur anywhere in the haystack."""
    return F.size(F.filter(tokens, lambda t: F.contains(haystack, t)))


def json_haystack(fields: Sequence[str], raw: Column | None = None) -> Column:
    """A record as lower-case JSON, keys included. ``raw`` is the record as it came, where there is one: with all its keys and JSON nulls.

    Of a record without it (a row of a table, where a null is a missing value) the fields that aren't null are taken.
    """
    own = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    return F.lower(own if raw is None else F.coalesce(raw, own))


def joined_haystack(*parts: Column) -> Column:
    """The parts with single spaces between them; arrays element by element, nulls as empty texts."""
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def affirmed(text: Column, phrases: Sequence[str]) -> Column:
    """Whether some phrase occurs that isn't negated anywhere in the text.

    A phrase is negated if a negating word precedes it within a sentence; one negated mention
    cancels all mentions of that phrase. False for null.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    one = [F.contains(low, F.lit(p)) & ~low.rlike(rf"(?U)\b(?:{'|'.join(NEGATIONS)})\b[^.]*\b{re.escape(p)}\b") for p in phrases]
    return reduce(lambda a, b: a | b, one)


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def wrapped_title(title: Column, width: int = 12, lines: int = 2) -> Column:
    """At most ``lines`` pieces of ``width`` characters; a longer title ends in an ellipsis. Null counts as empty."""
    text = F.coalesce(title, F.lit(""))
    pieces = [F.substring(text, 1 + i * width, width) for i in range(lines)]
    cut = F.concat(F.substring(text, 1 + (lines - 1) * width, width - 1), F.lit("…"))
    pieces[-1] = F.when(F.char_length(text) > lines * width, cut).otherwise(pieces[-1])
    return F.filter(F.array(*pieces), lambda p: p != "")


def json_object_in(text: Column) -> Column:
    """The JSON object that a text is, has in a fenced block, or has between its first and last brace; else null."""

    def parsed(x: Column) -> Column:
        v = F.try_parse_json(x)
        return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), v)

    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(parsed(F.nullif(F.trim(fenced), F.lit(""))), parsed(text), parsed(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def command_name(command: Column) -> Column:
    """``f`` of ``f(a, b)``."""
    return F.trim(F.substring_index(F.coalesce(command, F.lit("")), "(", 1))
