"""Raw JSON cases as rows of one fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import as_flag, as_number, as_word, child, filled, is_number, is_said, text_of
from ..functions.text import IMAGING_PHRASES, affirmed
from ..session import spread
from .shredding import case_list, parse_document, unwrap_text

# The sections of a case; the first five are expected of every case.
SECTIONS = ["symptoms", "vitals", "labs", "pathogen", "imaging", "treatment_history", "follow_up"]
EXPECTED = SECTIONS[:5]
NUMBERS = {
    "symptoms": ["fever_days", "max_temperature_c"],
    "vitals": ["spo2", "heart_rate", "respiratory_rate"],
    "labs": ["wbc_10e9_l", "neutrophil_ratio", "crp_mg_l", "pct_ng_ml", "ldh_u_l"],
    "treatment_history": ["macrolide_days"],
}
FLAGS = {
    "symptoms": ["cough", "wheezing", "dyspnea", "chest_pain"],
    "vitals": ["respiratory_distress"],
    "treatment_history": ["persistent_fever_after_treatment"],
    "follow_up": ["poor_oral_intake", "extrapulmonary_symptoms"],
}
WORDS = {"pathogen": {"mycoplasma_pcr": "", "mycoplasma_igm": "", "macrolide_resistance": "unknown"}, "treatment_history": {"response": ""}}
ZERO_IF_MISSING = {"fever_days", "macrolide_days"}


def exploded_cases(records: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, ``case_no`` and the case as variant ``raw``, one row per case object."""
    parsed = spread(records.select(key, payload)).select(F.col(key), parse_document(F.col(payload)).alias("_d")).select(key, unwrap_text(F.col("_d")).alias("_d"))
    cases = parsed.select(key, F.posexplode(case_list(F.col("_d"))).alias("case_no", "raw"))
    return cases.where(F.try_variant_get("raw", "$", "map<string,variant>").isNotNull()).withColumn("case_no", F.col("case_no").cast("bigint"))


def _section(raw: Column, name: str) -> Column:
    """The section as an object; of an array of objects its first element counts."""
    v = child(raw, name)
    return F.coalesce(F.get(F.try_variant_get(v, "$", "array<variant>"), 0), v)


def _picked(raw: Column, elements: Column, section: str, path: list[str], usable: Callable[[Column], Column]) -> Column:
    """A leaf of a section; of several elements from the first with a usable value, else from the first that has the leaf."""

    def leaf(v: Column) -> Column:
        for key in path:
            v = child(v, key)
        return v

    values = F.filter(F.transform(elements, leaf), lambda v: v.isNotNull())
    several = F.coalesce(F.get(F.filter(values, usable), 0), F.get(values, 0))
    return F.when(elements.isNotNull(), several).otherwise(leaf(child(raw, section)))


def imaging_feature(flag: Column, report: Column, name: str) -> Column:
    return flag | affirmed(report, IMAGING_PHRASES[name])


def normalized(cases: DataFrame, raw: str = "raw", first_only: bool = False) -> DataFrame:
    """Flat columns ``<section>_<field>`` in their final types, ``case_id``, ``age_years``, ``sex``, and the lists ``modalities`` and ``missing_sections``.

    Where a section is an array, each leaf comes from the first element with a usable value: a finite number for a number,
    for flags and words any number, boolean or text that isn't blank. If there is none, from the first element that has the
    leaf. ``first_only`` reads element 0 only, whatever it holds.
    """
    r = F.col(raw)
    others = [c for c in cases.columns if c != raw]
    # Each section is taken out of the case once, and each leaf out of its section once.
    if first_only:
        cases = cases.select("*", *(_section(r, s).alias(f"_s_{s}") for s in SECTIONS))
    else:
        cases = cases.select("*", *(F.try_variant_get(child(r, s), "$", "array<variant>").alias(f"_s_{s}") for s in SECTIONS))
    names = [(s, [f], is_number if group is NUMBERS else is_said) for group in (NUMBERS, FLAGS, WORDS) for s, fields in group.items() for f in fields]
    names += [("imaging", ["radiology_report"], is_said), *(("imaging", ["image_features", f], is_said) for f in IMAGING_PHRASES)]
    tops = ["case_id", "age_years", "sex"]

    def taken(s: str, path: list[str], usable: Callable[[Column], Column]) -> Column:
        if first_only:
            return child(F.col(f"_s_{s}"), ".".join(path))
        return _picked(r, F.col(f"_s_{s}"), s, path, usable)

    cases = cases.select(*others, *(filled(child(r, s)).alias(f"_f_{s}") for s in SECTIONS), *(child(r, f).alias(f"_l_{f}") for f in tops), *(taken(s, path, usable).alias(f"_l_{s}_{path[-1]}") for s, path, usable in names))

    def leaf(s: str, f: str) -> Column:
        return F.col(f"_l_{s}_{f}")

    columns = [
        F.coalesce(F.when(F.col("_l_case_id").isNotNull(), F.coalesce(text_of(F.col("_l_case_id")), F.lit("None"))), F.lit("unknown_case")).alias("case_id"),
        as_number(F.col("_l_age_years")).alias("age_years"),
        F.when(F.col("_l_sex").isNull(), F.lit("")).otherwise(text_of(F.col("_l_sex"))).alias("sex"),
    ]
    for s, fields in NUMBERS.items():
        columns += [as_number(leaf(s, f), 0.0 if f in ZERO_IF_MISSING else None).alias(f"{s}_{f}") for f in fields]
    for s, fields in FLAGS.items():
        columns += [as_flag(leaf(s, f)).alias(f"{s}_{f}") for f in fields]
    for s, fields in WORDS.items():
        columns += [as_word(leaf(s, f), default).alias(f"{s}_{f}") for f, default in fields.items()]
    report = text_of(leaf("imaging", "radiology_report"))
    columns += [imaging_feature(as_flag(leaf("imaging", f)), report, f).alias(f"imaging_{f}") for f in IMAGING_PHRASES]
    present = [F.when(F.col(f"_f_{s}"), F.lit(s)) for s in SECTIONS]
    absent = [F.when(~F.col(f"_f_{s}"), F.lit(s)) for s in EXPECTED]
    columns += [F.filter(F.array(*x), lambda y: y.isNotNull()).alias(n) for x, n in ((present, "modalities"), (absent, "missing_sections"))]
    return cases.select(*others, *columns)


def structured(cases: DataFrame, key: str) -> DataFrame:
    """The same flat columns from cases with typed sections: null flags are false, null words take the default, the report adds to the flags."""
    columns: list[Column] = [F.col(key), "case_id", "age_years", "sex"]
    for s, fields in NUMBERS.items():
        columns += [(F.coalesce(F.col(f"{s}.{f}"), F.lit(0.0)) if f in ZERO_IF_MISSING else F.col(f"{s}.{f}")).alias(f"{s}_{f}") for f in fields]
    for s, fields in FLAGS.items():
        columns += [F.coalesce(F.col(f"{s}.{f}"), F.lit(False)).alias(f"{s}_{f}") for f in fields]
    for s, fields in WORDS.items():
        columns += [F.lower(F.coalesce(F.col(f"{s}.{f}"), F.lit(default))).alias(f"{s}_{f}") for f, default in fields.items()]
    present = {f.name for f in cases.schema["imaging"].dataType["image_features"].dataType.fields}
    flag = {f: F.coalesce(F.col(f"imaging.image_features.{f}"), F.lit(False)) if f in present else F.lit(False) for f in IMAGING_PHRASES}
    columns += [imaging_feature(flag[f], F.col("imaging.radiology_report"), f).alias(f"imaging_{f}") for f in IMAGING_PHRASES]
    return cases.select(*columns)
