"""JSON documents in and out.

An array document keeps the order of its elements in ``_ord``; the order decides ties later on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import child
from ..operators.shredding import parse_document

_TEXTS = ["id", "title", "evidence_type", "source", "population", "intervention", "comparator", "main_findings", "quality", "recommendation_direction", "dose_signal", "citation"]
NODE = T.StructType([*(T.StructField(c, T.StringType()) for c in _TEXTS), T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("safety_signals", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "relation", "description")])
ENTRY = T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "topic", "level", "statement", "clinical_use")), T.StructField("tags", T.ArrayType(T.StringType()))])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, ``doc`` being its content as variant (null if it isn't JSON)."""
    return spark.read.text(path, wholetext=True).select(parse_document(F.col("value")).alias("doc"))


def array_documents(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """The elements of JSON array files as rows: ``_ord``, the fields of ``schema``, and ``_raw``, the element itself.

    A missing path is an error, or an empty table if ``missing_ok``. Elements that aren't objects have nulls.
    """
    try:
        read = documents(spark, path)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("_ord", T.LongType()), *schema.fields, T.StructField("_raw", T.StringType())]))
    rows = read.select(F.posexplode(F.try_variant_get("doc", "$", "array<variant>")).alias("_ord", "_e"))
    fields: list[Column] = [F.try_variant_get(child(F.col("_e"), f.name), "$", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    return rows.select(F.col("_ord").cast("bigint").alias("_ord"), *fields, F.to_json("_e").alias("_raw"))


def records_of(df: DataFrame, key: str, text: str, schema: T.StructType) -> DataFrame:
    """A record per row, as JSON in the column ``text``: ``_ord`` (the column ``key``), the fields of ``schema``, and ``_raw``, the text itself.

    What isn't a JSON object has nulls, and no ``_raw``.
    """
    parsed = df.select(F.col(key).cast("bigint").alias("_ord"), F.col(text).alias("_text"), parse_document(F.col(text)).alias("_e"))
    fields: list[Column] = [F.try_variant_get(child(F.col("_e"), f.name), "$", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    whole = F.try_variant_get("_e", "$", "map<string,variant>").isNotNull()
    return parsed.select("_ord", *fields, F.when(whole, F.col("_text")).alias("_raw"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, in place of what is there."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, key: str = "case_id") -> None:
    """Run records in a folder per case; slashes in its name become underscores."""
    df.withColumn("_folder", F.regexp_replace(F.coalesce(key, F.lit("unknown_case")), "/", "_")).write.mode("overwrite").partitionBy("_folder").parquet(path)
