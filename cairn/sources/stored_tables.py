"""Tables in the shared folder that tasks read by themselves, block by block, so that neither the driver nor a plan holds them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """The full address of a folder that isn't there yet, below the one all executors share."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> str:
    """Writes ``df`` as Parquet and gives its address; it stays in the shared folder for the plans that read it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _opened(folder: str):
    """The file system of Arrow, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3" + folder[3:] if scheme in ("s3a", "s3n") else folder)


def batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """What ``stored`` wrote, in a task; any address that Arrow can open."""
    import pyarrow.dataset as ds

    files, path = _opened(folder)
    return ds.dataset(path, filesystem=files, format="parquet").to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1)


def ordered_batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """As above, in the order of the partitions that were written and of the rows in each."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = _opened(folder)
    found = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")]
    for one in sorted(found, key=lambda p: (len(p), p)):  # partition numbers beyond five digits make names longer
        with files.open_input_file(one) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows)
