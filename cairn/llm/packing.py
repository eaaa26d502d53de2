"""Packing texts into containers of a fixed number of tokens, mixed as wanted.

Sizes are tokens of a public tokenizer, whose ranks file is a parameter. Items never
split unless one alone exceeds the capacity: such an item gives pieces that fill a container each and a
rest, and all of them wait in its source's queue like any item.

Method. Deficit round-robin over the sources' queues: with each container a source earns its rate of the capacity,
the source with the largest deficit that has an item that still fits gives its largest such item and pays its
tokens; what a source is owed or has overdrawn is carried to the next container.

Over partitions the accounts are carried by position. All sources together give a line of tokens, on
which each source advances at its share of every stretch; when a queue runs out the others go on in proportion to their
shares, sources without a share last. An item lies where its source's tokens before it (a running sum in the order
of a hash of the key, range-partitioned, so that a source of any size is spread) put it on that line. The line
is cut into blocks of bounded size, which are packed in parallel. A source in arrears at the end of a block has
so much more in the next one: within a block a source's rate is its part of the block's tokens, so that arrears are
paid over the block and not by a run of containers of one source, and all queues of a block end together.

Only sizes are shuffled, never texts. A block has about ``BLOCK_TOKENS`` tokens and
``BLOCK_ITEMS`` items at most, whatever share of the items one source or key holds.

Defined results: null and empty texts are items of 0 tokens in a block's first container; a null
source is a queue of its own; equal and null keys are separate items; capacities that are null or
below 1 are left out, equal capacities under two names are packed for each; an empty table
gives no rows. Shares default to the sources' shares of all tokens; sources without a
share only fill what others leave.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 4_000_000
BLOCK_ITEMS = 200_000
MIXTURE_WINDOW = 100
_FEW_SOURCES = 32


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` (0 for null texts); one pass over the texts, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(count, "doc_id bigint, source string, tokens bigint")


class Queue:
    """Items of one source; gives its largest that fits. Equal sizes leave in the order of arrival."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list[tuple[int, int]]] = {}

    def put(self, size: int, item: tuple[int, int]) -> None:
        if size not in self.items:
            insort(self.sizes, size)
            self.items[size] = []
        self.items[size].append(item)

    def ready(self) -> None:
        for items in self.items.values():
            items.reverse()

    def fits(self, room: int) -> bool:
        return bool(self.sizes) and self.sizes[0] <= room

    def take(self, room: int) -> tuple[int, tuple[int, int]]:
        i = bisect_right(self.sizes, room) - 1
        size = self.sizes[i]
        item = self.items[size].pop()
        if not self.items[size]:
            del self.items[size], self.sizes[i]
        return size, item


class Accounts:
    """Deficits of the sources of a block."""

    def __init__(self, names: list[str], shares: Mapping[str, float], owed: Mapping[str, float], queues: Mapping[str, Queue]) -> None:
        self.queues = [queues[s] for s in names]
        self.shares = [shares.get(s, 0.0) for s in names]
        self.deficit = [owed.get(s, 0.0) for s in names]
        self.many = len(names) > _FEW_SOURCES
        if self.many:
            self.shares, self.deficit = np.array(self.shares), np.array(self.deficit)
        self.least = [q.sizes[0] for q in self.queues]
        if self.many:
            self.least = np.array(self.least, float)

    def earn(self, capacity: int) -> None:
        """A container's worth for the sources that have items, in proportion to their shares."""
        if self.many:
            earning = np.where(np.isfinite(self.least), self.shares, 0.0)
            self.deficit += earning * (capacity / (earning.sum() or 1.0))
            return
        whole = sum(x for x, n in zip(self.shares, self.least) if n != math.inf) or 1.0
        for i, n in enumerate(self.least):
            if n != math.inf:
                self.deficit[i] += self.shares[i] * capacity / whole

    def next(self, room: int) -> int:
        """The source with the largest deficit that has an item for ``room``, -1 if there is none."""
        if self.many:
            able = np.where(self.least <= room, self.deficit, -np.inf)
            i = int(able.argmax())
            return i if able[i] > -np.inf else -1
        best = -1
        for i, n in enumerate(self.least):
            if n <= room and (best < 0 or self.deficit[i] > self.deficit[best]):
                best = i
        return best

    def take(self, i: int, room: int) -> tuple[int, tuple[int, int]]:
        q = self.queues[i]
        size, item = q.take(room)
        self.deficit[i] -= size
        self.least[i] = q.sizes[0] if q.sizes else math.inf
        return size, item


def pack_block(items: list[tuple[int, str, int]], capacity: int, shares: Mapping[str, float], owed: Mapping[str, float]) -> Iterator[tuple[int, int, int, int]]:
    """(container, item, part, tokens) of one block; ``items`` are (item, source, tokens), ``shares`` the rates and ``owed`` the deficits at its beginning."""
    queues: dict[str, Queue] = {}
    for item, source, tokens in items:
        if tokens == 0:
            yield 0, item, 0, 0
            continue
        part, q = 0, queues.setdefault(source, Queue())
        while tokens > capacity:
            q.put(capacity, (item, part))
            part, tokens = part + 1, tokens - capacity
        q.put(tokens, (item, part))
    if not queues:
        return
    for q in queues.values():
        q.ready()
    accounts, container = Accounts(sorted(queues), shares, owed, queues), 0
    while accounts.next(capacity) >= 0:
        room = capacity
        accounts.earn(capacity)
        while (i := accounts.next(room)) >= 0:
            size, (item, part) = accounts.take(i, room)
            room -= size
            yield container, item, part, size
        container += 1


def stretches(totals: Mapping[str, int], shares: Mapping[str, float], block: float) -> tuple[dict[str, list[tuple[float, float, int, float]]], int]:
    """How the sources with a share advance on the line of all tokens, and the number of blocks that it has.

    Per source rows (from, to, first block, blocks per token): its tokens from ``from`` to ``to`` lie in blocks
    ``first + (x - from) * rate``. A stretch ends, and with it a block, where a queue runs out.
    """
    left = {s: float(totals.get(s, 0)) for s in shares if shares[s] > 0 and totals.get(s, 0) > 0}
    at = dict.fromkeys(left, 0.0)
    rows: dict[str, list[tuple[float, float, int, float]]] = {s: [] for s in left}
    first = 0
    while left:
        whole = sum(shares[s] for s in left)
        length = min(n * whole / shares[s] for s, n in left.items())
        blocks = max(1, math.ceil(length / block))
        for s in list(left):
            given = length * shares[s] / whole
            last = left[s] - given < 0.5
            rows[s].append((at[s], math.inf if last else at[s] + given, first, blocks / max(given, 1.0)))
            at[s], left[s] = at[s] + given, left[s] - given
            if last:
                del left[s]
        first += blocks
    return rows, first


def _positions(sizes: DataFrame, partitions: int) -> DataFrame:
    """``sizes`` with ``_x``, the tokens of its queue before an item, and ``_whole``, all tokens of the queue.

    A distributed running sum: ranges of (queue, hash) are summed in themselves and shifted by what is before them.
    """
    keys = ["_queue", "_order", "_tie"]
    placed = cut(sizes.repartitionByRange(partitions, *keys).withColumn("_seg", F.spark_partition_id()))
    sums = placed.groupBy("_queue", "_seg").agg(F.sum("tokens").alias("_n"))  # a row per range and queue in it
    queue = Window.partitionBy("_queue")
    past = queue.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_queue", "_seg", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_shift"), F.sum("_n").over(queue).alias("_whole"))
    inside = Window.partitionBy("_queue", "_seg").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["_queue", "_seg"]).withColumn("_x", F.col("_shift") + F.col("_in"))


def _natural(first: int, blocks: int) -> Column:
    return F.lit(first) + F.least(F.floor(F.col("_x") * blocks / F.greatest("_whole", F.lit(1))), F.lit(blocks - 1))


def packed(sizes: DataFrame, capacities: Mapping[str, int], shares: Mapping[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, block_items: int = BLOCK_ITEMS, partitions: int | None = None) -> DataFrame:
    """One row per item part and pack: ``pack_name``, ``container_id``, ``doc_id``, ``part_no``, ``source``, ``tokens``.

    ``sizes`` has ``doc_id``, ``source``, ``tokens`` and is read twice: cut it before. ``container_id`` is unique within its pack;
    containers are filled in the order of their ids.
    """
    schema = "pack_name string, container_id bigint, doc_id bigint, part_no int, source string, tokens bigint"
    packs = {str(n): int(c) for n, c in capacities.items() if c is not None and c >= 1}
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source is told from every name
    # Equal and null keys are spread by the place of their row.
    row = F.xxhash64(F.monotonically_increasing_id())
    sizes = sizes.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("_nameless"), "source", queue.alias("_queue"), "tokens", F.xxhash64("doc_id").alias("_order"), row.alias("_tie"))
    by_queue = sizes.groupBy("_queue").agg(F.count("*").alias("_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"))
    n, total, crowded = by_queue.agg(F.coalesce(F.sum("_items"), F.lit(0)), F.coalesce(F.sum("_tokens"), F.lit(0)), F.max(F.col("_items") / F.greatest("_tokens", F.lit(1)))).first()
    placed = _positions(sizes, partitions or int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-total // block_tokens), -(-n // block_items))
    if shares is None:
        place = _natural(0, blocks)
    else:
        named = {"n" if s is None else "s" + s: float(w) for s, w in shares.items() if w > 0}
        totals = {r[0]: r[1] for r in by_queue.where(F.col("_queue").isin(*named)).select("_queue", "_tokens").collect()}  # at most a row per share
        blocks = max(blocks, math.ceil(total * crowded / block_items)) if n else 1
        rows, first = stretches(totals, named, max(1.0, total / blocks))
        rest = max(1, math.ceil((total - sum(totals.values())) / max(1.0, total / blocks)))
        line = sizes.sparkSession.createDataFrame(list(rows.items()), "_named string, _line array<struct<a:double,b:double,first:int,rate:double>>")
        placed = placed.join(F.broadcast(line), F.col("_queue") == F.col("_named"), "left")
        here = F.get(F.filter("_line", lambda e: F.col("_x") < e["b"]), 0)
        place = F.when(F.col("_line").isNull(), _natural(first, rest)).otherwise(here["first"] + F.greatest(F.floor((F.col("_x") - here["a"]) * here["rate"]), F.lit(0)))
        blocks = first + rest
    # Items without tokens go anywhere.
    placed = placed.select("doc_id", "_nameless", "source", "_queue", "tokens", F.when(F.col("tokens") > 0, place).otherwise(F.pmod("_tie", F.lit(blocks))).cast("bigint").alias("_block"))

    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "tokens"], kind="stable")
        rows = list(zip(range(len(items)), items["_queue"], items["tokens"].tolist()))
        rates = (items.groupby("_queue")["tokens"].sum() / max(1, int(items["tokens"].sum()))).to_dict()
        parts = []
        for name, capacity in packs.items():
            out = pd.DataFrame(pack_block(rows, capacity, rates, {}), columns=["container_id", "row", "part_no", "tokens"])
            out["pack_name"] = name
            parts.append(out)
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["container_id", "row", "part_no", "tokens", "pack_name"])
        out["container_id"] = out["container_id"].astype("int64") + (int(key[0]) << 32)
        at = out["row"].astype("int64").to_numpy()
        out["doc_id"] = pd.array(items["doc_id"].to_numpy()[at], "Int64")
        out.loc[items["_nameless"].to_numpy()[at], "doc_id"] = pd.NA
        out["source"] = items["source"].to_numpy()[at]
        return out[["pack_name", "container_id", "doc_id", "part_no", "source", "tokens"]]

    return placed.groupBy("_block").applyInPandas(fill, schema)


def valid_packs(packs: DataFrame, name: str, capacity: str) -> DataFrame:
    """Each named capacity of at least 1 once; rows without a name or with another capacity are no packs."""
    return packs.where(F.col(name).isNotNull() & (F.col(capacity) >= 1)).select(F.col(name).alias("pack_name"), F.col(capacity).alias("_capacity")).distinct()


def pack_documents(documents: DataFrame, packs: DataFrame, shares: Mapping[str, float] | None = None, tokenizer: str = TOKENIZER, name: str = "pack_name", capacity: str = "capacity_tokens", max_packs: int = 1_000, **kwargs) -> DataFrame:
    """Tokenizes once and packs for each of the ``valid_packs`` (parameters, at most ``max_packs``). A name of two capacities is an error: its containers couldn't be told apart."""
    rows = valid_packs(packs, name, capacity).limit(max_packs + 1).collect()
    if len(rows) > max_packs:
        raise ValueError(f"more than {max_packs} packs")
    if repeated := sorted(n for n, times in Counter(r[0] for r in rows).items() if times > 1):
        raise ValueError(f"packs with more than one capacity: {repeated}")
    return packed(cut(token_counts(documents, tokenizer)), {r[0]: r[1] for r in rows}, shares, **kwargs)


def containers(parts: DataFrame, packs: DataFrame, name: str = "pack_name", capacity: str = "capacity_tokens") -> DataFrame:
    """One row per container: its items and used and unused tokens."""
    by = parts.groupBy("pack_name", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return by.join(valid_packs(packs, name, capacity), "pack_name").select("pack_name", "container_id", "items", "tokens", (F.col("_capacity") - F.col("tokens")).alias("unused"))


def mixture(parts: DataFrame, window: int = MIXTURE_WINDOW) -> DataFrame:
    """How the mixture of each ``window`` containers in a row differs from that of the whole pack.

    ``pack_name``, ``window_no`` from 0, ``containers``, ``tokens`` and ``deviation``: half the sum of the absolute differences
    of the sources' shares, 0 if they are the same. A pack's last window is shorter. Containers are counted by block first, so
    that a pack isn't numbered in one task.
    """
    block, nth = F.shiftright("container_id", 32).alias("_block"), F.col("container_id").bitwiseAND((1 << 32) - 1).alias("_nth")
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_queue")
    each = parts.groupBy("pack_name", block, nth, queue).agg(F.sum("tokens").alias("tokens"))
    counts = each.groupBy("pack_name", "_block").agg((F.max("_nth") + 1).alias("_containers"))  # containers of a block are dense
    past = Window.partitionBy("pack_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("pack_name", "_block", F.coalesce(F.sum("_containers").over(past), F.lit(0)).alias("_before"))
    numbered = each.join(before, ["pack_name", "_block"]).select("pack_name", (F.col("_before") + F.col("_nth")).alias("_no"), "_queue", "tokens")
    by = numbered.groupBy("pack_name", F.floor(F.col("_no") / window).alias("window_no"), "_queue").agg(F.sum("tokens").alias("_tokens"), F.max("_no").alias("_last"))
    whole = each.groupBy("pack_name", "_queue").agg(F.sum("tokens").alias("_given"))
    whole = whole.withColumn("_target", F.col("_given") / F.greatest(F.sum("_given").over(Window.partitionBy("pack_name")), F.lit(1)))
    sums = by.groupBy("pack_name", "window_no").agg(F.sum("_tokens").alias("_all"), F.max("_last").alias("_end"))
    shared = by.join(sums, ["pack_name", "window_no"]).join(whole, ["pack_name", "_queue"])
    share = F.col("_tokens") / F.greatest("_all", F.lit(1))
    # sources that a window lacks differ by their whole target
    out = shared.groupBy("pack_name", "window_no").agg(F.first("_all").alias("tokens"), F.max("_end").alias("_end"), (F.sum(F.abs(share - F.col("_target"))) + 1 - F.sum("_target")).alias("_d"))
    return out.select("pack_name", "window_no", (F.col("_end") + 1 - F.col("window_no") * window).cast("bigint").alias("containers"), "tokens", F.greatest(F.col("_d") / 2, F.lit(0.0)).alias("deviation"))
