"""Columnar shredding of nested JSON, and flat tables from the level sequences.

A leaf path such as ``symptoms.fever_days`` below a list of cases becomes one
column per record: a sequence of (repetition level, definition level, value).
Every step of the path may hold an object or an array of objects, so every step
repeats. The repetition level says at which step an entry starts a new element (0:
first entry of the record, k: a new element of step k); the definition level says
how far the path exists: for step k, ``2k-1`` an element is there and ``2k`` it is an
object; one more if the leaf is there and isn't null.

Parsing and shredding are Catalyst expressions on ``VARIANT`` (no Python).
Reconstruction reads nothing but the level sequences: the position of an element
within its parent is the number of entries that repeat at its level since the last
entry that repeats above it, in one numpy pass over an Arrow batch.

Defined results: a payload that is null, empty or not well-formed JSON, that has
anything after its document or nests deeper than the parser allows (1,000 levels)
has no entries beyond a single one at level 0; a scalar in the place of an object
is an element but not an object; null elements keep their position; of equal
keys within an object the last counts. Other columns of the table aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

LEVELS = "array<struct<r:int,d:int,v:string>>"


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def parse_document(payload: Column) -> Column:
    """The document as ``VARIANT``; null unless the whole text is one well-formed document.

    The parser stops at the end of the first document. Read as the first of two
    elements of an array, a text with anything after its document is refused.
    """
    pair = _as_list(F.try_parse_json(F.concat(F.lit("["), payload, F.lit(",0]"))))
    return F.when(F.size(pair) == 2, F.get(pair, 0))


def unwrap_text(document: Column, depth: int = 16) -> Column:
    """A document that is a JSON string holds a document as its content, down to ``depth`` strings.

    Each string doubles the backslashes before the quotes within it, so a text of 16 strings is longer than any document.
    """

    def content(v: Column) -> Column:
        return F.when(_is_text(v), parse_document(_as_text(v))).otherwise(v)

    # Documents that are no strings are left as they are; the levels of the others are one expression, run again and again.
    return F.when(_is_text(document), F.aggregate(F.sequence(F.lit(1), F.lit(depth)), document, lambda v, _: content(v))).otherwise(document)


def case_list(document: Column) -> Column:
    """The cases of a document: ``{"cases": [...]}``, an array, ``{"case": {...}}`` or one bare object."""
    top = _as_object(document)
    several = F.try_variant_get(document, "$.cases", "array<variant>")
    single = F.try_variant_get(document, "$.case", "variant")
    return F.coalesce(
        _as_list(document),
        several,
        F.when(_as_object(single).isNotNull(), F.array(single)),
        F.when(top.isNotNull(), F.array(document)),
    )


def _entry(r: Column, d: int, v: Column | None = None) -> Column:
    return F.struct(r.cast("int").alias("r"), F.lit(d).alias("d"), (F.lit(None) if v is None else v).cast("string").alias("v"))


def _walk(items: Column, names: Sequence[str], level: int, r: Column) -> Column:
    """The entries below the elements ``items`` of step ``level``; ``names`` are the keys still to go, the last is the leaf."""

    def element(v: Column, i: Column) -> Column:
        here = F.when(i == 0, r).otherwise(F.lit(level))
        inside = F.try_variant_get(v, f"$.{names[0]}", "variant")
        if len(names) == 1:
            present = inside.isNotNull() & ~F.is_variant_null(inside)
            below = F.when(present, F.array(_entry(here, 2 * level + 1, F.coalesce(_as_text(inside), F.to_json(inside))))).otherwise(F.array(_entry(here, 2 * level)))
        else:
            kids = F.coalesce(_as_list(inside), F.when(inside.isNotNull() & ~F.is_variant_null(inside), F.array(inside)))
            below = F.when(F.size(kids) > 0, _walk(kids, names[1:], level + 1, here)).otherwise(F.array(_entry(here, 2 * level)))
        return F.when(_as_object(v).isNotNull(), below).otherwise(F.array(_entry(here, 2 * level - 1)))

    return F.flatten(F.transform(items, element))


def shred(df: DataFrame, key: str, payload: str, paths: Sequence[str]) -> DataFrame:
    """One row per record: ``key`` and one column of level sequences per leaf path (path with dots, below the cases)."""
    spark = df.sparkSession
    allow = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(allow)
    spark.conf.set(allow, "true")
    try:  # the setting is read when the expression is analysed, which happens here
        parsed = spread(df.select(key, payload)).select(F.col(key).alias(key), parse_document(F.col(payload)).alias("_doc"))
        parsed = parsed.select(key, unwrap_text(F.col("_doc")).alias("_doc")).select(key, case_list(F.col("_doc")).alias("_cases"))
    finally:
        spark.conf.set(allow, before)
    nothing = F.array(_entry(F.lit(0), 0))
    return parsed.select(key, *(F.when(F.size("_cases") > 0, _walk(F.col("_cases"), p.split("."), 1, F.lit(0))).otherwise(nothing).alias(p) for p in paths))


def _ordinals(r: np.ndarray, depth: int) -> list[np.ndarray]:
    """For levels 1..depth the position of each entry's element within its parent element."""
    at, out = np.arange(len(r)), []
    for level in range(1, depth + 1):
        opens = np.maximum.accumulate(np.where(r < level, at, 0))
        steps = np.cumsum(r == level)
        out.append(steps - steps[opens])
    return out


def _table(df: DataFrame, key: str, leaves: Sequence[str], ordinals: Sequence[str], label: str | None = None) -> DataFrame:
    """From columns ``key``, perhaps a ``label``, and one sequence per leaf (positions count, names don't)."""
    depth, skip = len(ordinals), 2 if label else 1
    names = [key, *([label] if label else []), *ordinals, *(c for x in leaves for c in (x, f"{x}_set"))]
    kinds = ["bigint", *(["string"] if label else []), *("bigint" for _ in ordinals), *(c for _ in leaves for c in ("string", "boolean"))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [batch.column(skip + i) for i in range(len(leaves))]
            flat = [s.flatten() for s in sequences]
            r = flat[0].field("r").to_numpy(zero_copy_only=False)
            if not len(r):
                continue
            d = np.stack([f.field("d").to_numpy(zero_copy_only=False) for f in flat])
            rows = pa.array(d[0] >= 2 * depth)
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(sequences[0].offsets.to_numpy())))
            columns = [batch.column(i).take(of) for i in range(skip)]
            columns += [pa.array(o, pa.int64()) for o in _ordinals(r, depth)]
            for f, dd in zip(flat, d):
                columns += [f.field("v"), pa.array(dd > 2 * depth)]
            yield pa.RecordBatch.from_arrays([c.filter(rows) for c in columns], names=names)

    return df.mapInArrow(build, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def reconstruct(levels: DataFrame, key: str, prefix: str, leaves: Sequence[str], ordinals: Sequence[str]) -> DataFrame:
    """The flat table of the repeated ancestor ``prefix`` (empty for the cases themselves).

    One row per element that is an object: ``key``, ``ordinals`` (its position at each
    level from the outermost, the link to its parent's row), a text column per leaf
    and ``<leaf>_set``, whether the leaf is there and not null.
    """
    paths = [f"{prefix}.{leaf}" if prefix else leaf for leaf in leaves]
    wanted = levels.select(F.col(key).cast("bigint").alias("_key"), *(F.col(f"`{p}`").alias(f"_l{i}") for i, p in enumerate(paths)))
    return _table(wanted, key, leaves, ordinals)


def leaf_rows(levels: DataFrame, key: str, sections: dict[str, str], ordinals: Sequence[str]) -> DataFrame:
    """All elements that hold their section's leaf with a value other than the empty text: ``key``, first ordinal, ``section_name``, second ordinal.

    The sequences of all sections go through one pass, so the payloads are parsed once.
    """
    stacked = F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"`{s}.{leaf}`").alias("l")) for s, leaf in sections.items()))
    long = levels.select(F.col(key).cast("bigint").alias("_key"), F.explode(stacked).alias("_e")).select("_key", "_e.s", "_e.l")
    t = _table(long, key, ["leaf"], ordinals, label="section_name")
    return t.where(F.col("leaf_set") & (F.col("leaf") != "")).select(key, ordinals[0], "section_name", ordinals[1])
