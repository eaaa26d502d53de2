"""Records that differ only in how they are written: one record each, with the number of its copies.

Canonical form. A text keeps its letters, marks and digits in order, in lower case and
composed (NFC); everything else goes, but two digits with something between them keep one
space. A list of fields is the sorted list of its fields' canonical forms, empty ones left out.

Method. Canonical forms are made once and kept in the shared folder, laid out by pass: a pass is
a range of the hash space whose filter has at most ``filter_bytes`` (``bits_per_row`` bits a row), and the
tasks that write a pass's rows write them into that pass's files, without a shuffle. Each pass then reads only its
own rows, twice: to fill its filter and to test it. Every input partition fills two blocked Bloom
filters, of hashes it saw and of hashes it saw again; partition filters are merged block by
block: what two partitions both saw has been seen again. Only rows whose hash may be repeated are
shuffled, for exact grouping on the canonical texts; all others are singletons where they stand. A
false positive costs a shuffled row, never a result.

Passes run one after the other and each writes what it found, so at any time there is one
broadcast, of one pass's filter of repeats, whatever the size of the table, and the plan of the result holds
none. All rows together are written once and read twice, however many passes there are.

Skew. Groups are reduced by a partial aggregate before the shuffle. Where every copy is
wanted, copies of a group of more than ``hot_rows`` rows are spread over ``salts``
partitions; there are at most rows / ``hot_rows`` such groups, which are broadcast.

Defined results: a row with a null title or citation, or without a letter or digit in one of
them, has no copies and stays as a record of its own; a row key that repeats is two rows, a
null row key counts as a copy but can't be named; of copies the smallest row key is kept; other columns aren't looked at; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .shared import new_folder, remove

FIELD_SEPARATORS = "[;|；]"
BLOCK_WORDS = 8  # 512 bits
PROBES = 4
PLACE_BITS = 9 * PROBES
SEGMENT_BLOCKS = 1024
BITS_PER_ROW = 8
FILTER_BYTES = 64 << 20
HOT_ROWS = 500_000
SALTS = 64


def composed(text: Column) -> Column:
    """NFC; only texts with combining marks go through Python."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(nfc(F.when(text.rlike(r"\p{M}"), text)), text)


def canonical(text: Column) -> Column:
    """Letters, marks and digits of a composed text, in lower case; one space between digits that something stands between."""
    x = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.regexp_replace(F.regexp_replace(x, r"([^\p{Nd}]) ", "$1"), r" ([^\p{Nd}])", "$1")


def canonical_fields(text: Column, separators: str = FIELD_SEPARATORS) -> Column:
    return F.array_sort(F.filter(F.transform(F.split(text, separators), canonical), lambda f: f != ""))


def canonical_rows(df: DataFrame, key: str, title: str, citation: str) -> DataFrame:
    """``_ord``, ``_title``, ``_fields`` and their hash ``_h``; nulls where the row can't have copies."""
    read = spread(df.select(key, title, citation)).select(F.col(key).alias("_ord"), composed(F.col(title)).alias("_t"), composed(F.col(citation)).alias("_c"))
    forms = read.select("_ord", canonical(F.col("_t")).alias("_title"), F.array_join(canonical_fields(F.col("_c")), "\x1f").alias("_fields"))
    whole = (F.col("_title") != "") & (F.col("_fields") != "")
    return forms.select("_ord", *(F.when(whole, F.col(c)).alias(c) for c in ("_title", "_fields")), F.when(whole, F.xxhash64("_title", "_fields")).alias("_h"))


def _fill():
    """Filters of one input partition, as compressed segments of the two."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        size = SEGMENT_BLOCKS * BLOCK_WORDS
        for batch in batches:
            block, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, counts = np.unique(block << PLACE_BITS | bits, return_counts=True)
            block, bits = keys >> PLACE_BITS, keys & (1 << PLACE_BITS) - 1
            segment = block // SEGMENT_BLOCKS
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for rows in np.split(np.arange(len(keys)), cuts) if len(keys) else []:
                s = int(segment[rows[0]])
                if s not in once:
                    once[s], again[s] = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
                at = block[rows] % SEGMENT_BLOCKS * BLOCK_WORDS
                seen = np.ones(len(rows), bool)
                places = []
                for probe in range(PROBES):
                    bit = bits[rows] >> (9 * probe) & 511
                    word, mask = at + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64)
                    places.append((word, mask))
                    seen &= (once[s][word] & mask) != 0
                repeated = seen | (counts[rows] > 1)
                for word, mask in places:
                    np.bitwise_or.at(once[s], word, mask)
                    np.bitwise_or.at(again[s], word[repeated], mask[repeated])
        for s in once:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([zlib.compress(once[s].tobytes(), 1)]), pa.array([zlib.compress(again[s].tobytes(), 1)])], names=["segment", "once", "again"])

    return fill


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order; emits the blocks in which anything has been seen again."""
    at, once, again = -1, None, None

    def blocks() -> Iterator[pa.RecordBatch]:
        table = again.reshape(SEGMENT_BLOCKS, BLOCK_WORDS)
        rows = np.flatnonzero(table.any(axis=1))
        if len(rows):
            words = pa.FixedSizeListArray.from_arrays(pa.array(table[rows].view(np.int64).ravel()), BLOCK_WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows + at * SEGMENT_BLOCKS), words], names=["_fblock", "_words"])

    for batch in batches:
        for s, o, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
            o, a = np.frombuffer(zlib.decompress(o), np.uint64), np.frombuffer(zlib.decompress(a), np.uint64)
            if s != at:
                if at >= 0:
                    yield from blocks()
                at, once, again = s, o.copy(), a.copy()
            else:
                again |= a | (once & o)
                once |= o
    if at >= 0:
        yield from blocks()


def _one_pass(rows: DataFrame, count: float, bits_per_row: int) -> DataFrame:
    """``rows``, all with ``_h``, with ``_again``: false if no other row has this ``_h``, else true (rarely also without another)."""
    blocks = max(1, math.ceil(count * bits_per_row / (64 * BLOCK_WORDS)))
    # The pass, the block and the places in it come from different bits of the hash.
    placed = rows.withColumn("_block", F.pmod(F.col("_h"), F.lit(blocks))).withColumn("_bits", F.xxhash64("_h", F.lit(2)).bitwiseAND((1 << PLACE_BITS) - 1))
    segments = placed.select("_block", "_bits").mapInArrow(_fill(), "segment bigint, once binary, again binary")
    merged = segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "_fblock bigint, _words array<bigint>")
    part = placed.join(F.broadcast(merged), F.col("_block") == F.col("_fblock"), "left")
    test = F.lit(True)
    for i in range(PROBES):
        place = F.shiftright("_bits", 9 * i).bitwiseAND(511).cast("int")
        test = test & (F.getbit(F.get("_words", F.shiftright(place, 6)), place.bitwiseAND(63).cast("int")) == 1)
    return part.select(*rows.columns, F.coalesce(test, F.lit(False)).alias("_again"))


def possible_repeats(rows: DataFrame, count: int, bits_per_row: int = BITS_PER_ROW, filter_bytes: int = FILTER_BYTES, singles: bool = True) -> DataFrame:
    """``rows`` with ``_again``, in the shared folder: false if no other row has this ``_h`` (or it is null), else true.

    Rows that aren't ``_again`` keep their ``_ord`` only, or are left out if not ``singles``. ``count`` is the number of rows.
    """

    def kept(tested: DataFrame) -> DataFrame:
        if not singles:
            return tested.where("_again")
        return tested.select("_ord", *(F.when(F.col("_again"), F.col(c)).alias(c) for c in rows.columns if c != "_ord"), "_again")

    passes = max(1, math.ceil(count * bits_per_row / (8 * filter_bytes)))
    if passes == 1:
        rows = cut(rows)
        tested = cut(kept(_one_pass(rows.where(F.col("_h").isNotNull()), count, bits_per_row)))
        return tested.unionByName(rows.where(F.col("_h").isNull()).withColumn("_again", F.lit(False))) if singles else tested
    spark = rows.sparkSession
    folder = new_folder(spark, "passes")
    try:
        # a row without a hash is in no pass
        laid = rows.withColumn("_pass", F.when(F.col("_h").isNotNull(), F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(passes))).otherwise(-1).cast("int"))
        laid.write.partitionBy("_pass").parquet(folder)
        at = spark.read.schema(laid.schema).parquet(folder)
        parts = [cut(kept(_one_pass(at.where(F.col("_pass") == p).select(*rows.columns), count / passes, bits_per_row))) for p in range(passes)]
        if singles:
            parts.append(cut(kept(at.where(F.col("_pass") == -1).select(*rows.columns).withColumn("_again", F.lit(False)))))
    finally:
        remove(spark, folder)
    return reduce(DataFrame.unionByName, parts)


def _groups(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("_h", "_title", "_fields").agg(F.min("_ord").alias("_kept"), F.count("*").alias("_n"))


def copies(df: DataFrame, key: str = "_ord", title: str = "title", citation: str = "citation", bits_per_row: int = BITS_PER_ROW, filter_bytes: int = FILTER_BYTES, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Each group's kept row with each other row: ``kept_ord``, ``copy_ord``."""
    candidates = possible_repeats(canonical_rows(df, key, title, citation), df.count(), bits_per_row, filter_bytes, singles=False).drop("_again")
    groups = cut(_groups(candidates).where("_n > 1"))
    hot = groups.where(F.col("_n") > hot_rows).select(F.col("_h").alias("_hot")).distinct()
    salted = candidates.join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_ord"), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    # a hash shared by a hot and another group is salted on both sides
    group_side = groups.join(F.broadcast(hot), F.col("_h") == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    pairs = salted.join(group_side.select("_h", "_title", "_fields", "_salt", "_kept"), ["_h", "_title", "_fields", "_salt"])
    # the kept row itself isn't its copy; were its key to repeat, the other row with it is none either
    return pairs.where(F.col("_ord") != F.col("_kept")).select(F.col("_kept").alias("kept_ord"), F.col("_ord").alias("copy_ord"))


def collapsed(df: DataFrame, key: str = "_ord", title: str = "title", citation: str = "citation", bits_per_row: int = BITS_PER_ROW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per record: ``kept_ord`` and ``copies`` (1 for a singleton). The singletons aren't shuffled."""
    tested = possible_repeats(canonical_rows(df, key, title, citation), df.count(), bits_per_row, filter_bytes)
    single = tested.where(~F.col("_again")).select(F.col("_ord").alias("kept_ord"), F.lit(1).cast("bigint").alias("copies"))
    return single.unionByName(_groups(tested.where("_again")).select(F.col("_kept").alias("kept_ord"), F.col("_n").alias("copies")))
