"""How often every distinct term occurs, in how many records, and which are too rare or too common.

Method. Rows are encoded where they stand: each block of input rows (a task's rows, up to
``BLOCK_TERMS`` distinct terms) gives its terms codes in the order in which they come, and two count arrays over
the codes are filled, one for occurrences and one for records. A block hands on one entry per distinct term, so
a hot term leaves it as one. The entries are shuffled by term once; that order gives the global dictionary, dense
integers from 0, and translates the blocks' codes to it at the same time. It is cut to the shared
folder, so that it stays the same. The translated counts are gathered as sparse arrays over ranges of ``RANGE``
identifiers (an entry takes 20 bytes, however many ranges there are), shuffled by range and summed in dense
arrays, one range at a time.

Defined results: a term is an element in lower case without surrounding whitespace (Unicode's
White_Space and the four separators U+001C to U+001F); null and blank elements are none;
null and empty arrays hold none, but their rows count as records; a row counts once
per term; no rows give no terms. Extra columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

RANGE = 1 << 16
BLOCK_TERMS = 1 << 20
HELD_COUNTS = 1 << 20
RARE_BELOW = 3
COMMON_SHARE = 1 / 20
# What surrounds a term.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def term(element: Column) -> Column:
    return F.lower(F.regexp_replace(element, rf"^{_SPACE}+|{_SPACE}+$", ""))


def terms(elements: Column) -> Column:
    return F.filter(F.transform(elements, term), lambda t: t.isNotNull() & (t != ""))


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), np.int64)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of terms to one entry per block and distinct term."""
    codes: dict[str, int] = {}
    occurrences, records = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def entries() -> Iterator[pa.RecordBatch]:
        terms_, n = pa.array(codes, pa.string()), len(codes)
        for at in range(0, n, RANGE):
            end = min(n, at + RANGE)
            yield pa.RecordBatch.from_arrays([terms_[at:end], pa.array(occurrences[at:end]), pa.array(records[at:end])], names=["term", "occurrences", "records"])

    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            continue
        code = np.array([codes.setdefault(t, len(codes)) for t in flat.dictionary.to_pylist()])[flat.indices.to_numpy()]
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        n = len(codes)
        occurrences, records = _grown(occurrences, n), _grown(records, n)
        occurrences[:n] += np.bincount(code, minlength=n)
        records[:n] += np.bincount(np.unique(row * n + code) % n, minlength=n)
        if n >= BLOCK_TERMS:
            yield from entries()
            codes, occurrences, records = {}, np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    yield from entries()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of their terms; equal terms get one number, the first of them keeps the term."""
    part, last, used = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        words, n = batch.column(0), batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[0] = last is None or words[0].as_py() != last
        if n > 1:
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        at = used + np.cumsum(new) - 1
        used, last = int(at[-1]) + 1, words[n - 1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(at), pc.if_else(pa.array(new), words, None), batch.column(1), batch.column(2)], names=["_part", "_local", "term", "occurrences", "records"])


def encoded(entries: DataFrame) -> DataFrame:
    """``entries`` with ``id``, dense from 0 in the order of the partitions and of the terms in them; ``term`` stands with one entry of each id."""
    placed = cut(entries.repartition("term").sortWithinPartitions("term").mapInArrow(_numbered, "_part bigint, _local bigint, term string, occurrences bigint, records bigint"))
    sizes = placed.groupBy("_part").agg((F.max("_local") + 1).alias("_n"))  # one row per partition
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), F.col("_part") == F.col("_p")).select("term", (F.col("_before") + F.col("_local")).alias("id"), "occurrences", "records")


def _ranges(ids: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Counts as one row per range: places in the range and the counts there."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    ids, occurrences, records = ids[first], np.add.reduceat(occurrences[order], first), np.add.reduceat(records[order], first)
    of = ids // RANGE
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    offsets = pa.array(np.r_[starts, len(ids)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((ids % RANGE).astype(np.int32), occurrences, records)]
    return pa.RecordBatch.from_arrays([pa.array(of[starts]), *lists], names=["range", "places", "occurrences", "records"])


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded counts to count arrays by range; ``HELD_COUNTS`` counts are held at most, besides a batch."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(i).to_numpy() for i in range(3)])
            size += batch.num_rows
        if size >= HELD_COUNTS:
            yield _ranges(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        yield _ranges(*(np.concatenate(x) for x in zip(*held)))


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays in the order of their ranges to one row per identifier."""
    at, total = -1, None

    def rows() -> pa.RecordBatch:
        some = np.flatnonzero(total[0])
        return pa.RecordBatch.from_arrays([pa.array(some + at * RANGE), pa.array(total[0][some]), pa.array(total[1][some])], names=["id", "occurrences", "records"])

    for batch in batches:
        for i, r in enumerate(batch.column(0).to_pylist()):
            if r != at:
                if at >= 0:
                    yield rows()
                at, total = r, np.zeros((2, RANGE), np.int64)
            places = batch.column(1)[i].values.to_numpy()
            for c in range(2):
                total[c][places] += batch.column(2 + c)[i].values.to_numpy()
    if at >= 0:
        yield rows()


def term_counts(tables: Sequence[tuple[DataFrame, str]], rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """One row per term: ``term``, ``id``, ``occurrences``, ``records`` and ``mark`` (``rare``, ``common`` or null).

    ``tables`` are pairs of a table and its array column; their rows together are the records.
    """
    total = sum(t.count() for t, _ in tables)
    rows = reduce(DataFrame.unionByName, [t.select(terms(F.col(c)).alias("_terms")) for t, c in tables])
    entries = encoded(rows.where(F.size("_terms") > 0).mapInArrow(_counted, "term string, occurrences bigint, records bigint"))
    arrays = entries.select("id", "occurrences", "records").mapInArrow(_accumulate, "range bigint, places array<int>, occurrences array<bigint>, records array<bigint>")
    sums = arrays.repartition("range").sortWithinPartitions("range").mapInArrow(_sum, "id bigint, occurrences bigint, records bigint")
    numbers = entries.where(F.col("term").isNotNull()).select("term", "id")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * common_share, "common")
    return sums.join(numbers, "id").select("term", "id", "occurrences", "records", mark.alias("mark"))
