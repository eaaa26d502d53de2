"""Replies of an outside text generator, as a column. Off unless a function is given.

The function is the caller's: it takes a payload and returns a reply or raises. A row whose call fails, or whose
reply holds no JSON object, keeps what was computed without it, with the reason. The function sees each row once: all
columns go through it, rows of equal keys included, and the result is cut to the shared folder, so that later actions and
retries of what follows don't call it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_object_in
from ..session import cut


def with_replies(df: DataFrame, payload: str, gateway: Callable[[str], str] | None = None) -> DataFrame:
    """``df`` with ``reply`` (a JSON object as text), ``reply_used`` and ``reply_error``."""
    nothing = F.lit(None).cast("string")
    if gateway is None:
        return df.withColumns({"reply": nothing, "reply_used": F.lit(False), "reply_error": nothing})
    at = df.columns.index(payload)
    told, failed = (name + "_" * max(len(c) for c in df.columns) for name in ("reply", "error"))  # no column has these names

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies: list[str | None] = []
            errors: list[str | None] = []
            for p in batch.column(at).to_pylist():
                try:
                    replies.append(gateway(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure leaves the local result
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, told, failed])

    schema = T.StructType([*df.schema.fields, T.StructField(told, T.StringType()), T.StructField(failed, T.StringType())])
    called = cut(df.mapInArrow(call, schema))
    good = F.to_json(json_object_in(F.col(told)))
    return called.withColumns({"reply": good, "reply_used": good.isNotNull(), "reply_error": F.when(good.isNull(), F.coalesce(failed, F.lit("the reply holds no JSON object")))}).drop(told, failed)
