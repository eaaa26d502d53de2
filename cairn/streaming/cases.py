"""Case normalisation on a stream of raw records: the batch operators, unchanged, on a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cases import exploded_cases, normalized

RECORD = "raw_id bigint, site_code string, received_at timestamp_ntz, payload string"


def read_records(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """Raw records as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def normalized_stream(records: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    return normalized(exploded_cases(records, key, payload))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there in micro-batches and ends; files appear once whatever fails in between."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
