"""Values of a ``VARIANT`` as plain types, with defaults for what is absent or unusable.

Absent keys, JSON nulls and values of another type are told apart: a null text is the word
``none`` where an absent one takes the default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)\s*$"


# Texts that affirm.
AFFIRMING = ["1", "true", "yes", "y", "positive", "present"]


def kind(v: Column) -> Column:
    """``STRING``, ``BOOLEAN``, ``BIGINT``, ``DOUBLE``, ``DECIMAL(..)``, ``VOID`` (JSON null), ``ARRAY..``, ``OBJECT..`` or null if absent."""
    return F.schema_of_variant(v)


def child(v: Column, key: str) -> Column:
    """The value of a key of an object, as variant; null if absent or ``v`` is no object."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_number(v: Column, default: float | None = None) -> Column:
    """Numbers, booleans (1 and 0) and texts that read as a number; else the default."""
    k = kind(v)
    text = F.when(F.lower(text_of(v)).rlike(_NUMBER), F.trim(text_of(v)).try_cast("double"))
    number = (
        F.when(k == "STRING", text)
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(~k.startswith("OBJECT") & ~k.startswith("ARRAY"), F.try_variant_get(v, "$", "double"))
    )
    return F.coalesce(number, F.lit(default).cast("double"))


def as_flag(v: Column) -> Column:
    """Booleans, numbers other than 0 and the affirming words; all else is false."""
    k = kind(v)
    word = F.lower(F.trim(text_of(v))).isin(*AFFIRMING)
    flag = (
        F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(k == "STRING", word)
        .when((k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL"), F.try_variant_get(v, "$", "double") != 0)
    )
    return F.coalesce(flag, F.lit(False))


def as_word(v: Column, default: str = "") -> Column:
    """Lower-case text; JSON null is ``none``, absent is the default."""
    return F.when(v.isNull(), F.lit(default)).when(kind(v) == "VOID", F.lit("none")).otherwise(F.lower(text_of(v)))


def is_number(v: Column) -> Column:
    """Whether ``as_number`` finds a finite number."""
    n = as_number(v)
    return F.coalesce(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), F.lit(False))


def is_said(v: Column) -> Column:
    """Whether a value is a number, a boolean or a text that isn't blank."""
    k = kind(v)
    return F.coalesce((k != "VOID") & ~k.startswith("OBJECT") & ~k.startswith("ARRAY") & (F.trim(text_of(v)) != ""), F.lit(False))


def filled(v: Column) -> Column:
    """Whether a value is there and isn't null, false, 0 or empty."""
    k = kind(v)
    empty = (
        (k == "VOID")
        | ((k == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(False)))
        | ((k == "STRING") & (text_of(v) == ""))
        | (k == "OBJECT<>")
        | ((k == "ARRAY<VOID>") & F.try_variant_get(v, "$[0]", "variant").isNull())
        | (~k.startswith("OBJECT") & ~k.startswith("ARRAY") & (k != "STRING") & (F.try_variant_get(v, "$", "double") == 0))
    )
    return v.isNotNull() & ~F.coalesce(empty, F.lit(False))
