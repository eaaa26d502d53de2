"""Evaluation passages in a corpus, found with suffix arrays over shards of the corpus.

Each task turns its documents into words, packs them into shards of a bounded number
of words (a longer document is a shard by itself), builds the suffix array of each
shard and binary-searches every suffix of every evaluation item in it. A suffix that
occurs with at least ``min_words`` words is followed to its longest verbatim match at
every place where it occurs; a document is reported once per item with the longest.

The corpus is read once, isn't shuffled, and no task holds more than one shard. The
items are a stated query set of any size: they become words in tasks and lie in the shared folder,
from where each shard, once built, is searched with one block of them after the other. Neither
the driver nor a plan holds items, and a task holds one block. Only the matches leave a task.

Longest matches. Places that match one after the other, in document and item alike, are one match: its
length is their number and ``min_words`` - 1 more. So matches of any length cost a sort of the
places, not a comparison per word. Where an item repeats a run of ``min_words`` words, places could multiply; there
the longest match of item and document is found by comparing ranks of runs of doubling length.

Defined results: null and empty texts and items hold nothing; an item of fewer than
``min_words`` words can't leak; equal items are reported each, as are equal documents;
a passage is never looked for across streams of a page. Other columns aren't read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .shared import batches as stored_batches
from .shared import stored
from .wikitext import Pieces, plain_words, words

MIN_WORDS = 12
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
BLOCK_ITEMS = 10_000
OPEN_PLACES = 4_000_000
_CHUNK = 1 << 16
_SCHEMA = "doc_id bigint, item_id bigint, matched_words int, doc_word bigint, item_word int"


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` in the order of their first ``depth`` ids or more, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    reached = 1
    while reached < depth:
        after = np.full(n, -1, np.int64)
        after[: n - reached] = rank[reached:]
        pair = rank * (n + 1) + (after + 1)
        order = np.argsort(pair)
        step = np.empty(n, np.int64)
        step[0] = 0
        sorted_pair = pair[order]
        np.cumsum(sorted_pair[1:] != sorted_pair[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        reached *= 2
        if step[-1] == n - 1:
            break
    return order


def _bound(text: np.ndarray, order: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of ``wanted`` the first place in ``order`` whose suffix isn't before it (after it, if ``upper``)."""
    m, width = wanted.shape
    low, high = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    across = np.arange(width)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        there = text[order[np.minimum(mid, len(order) - 1)][:, None] + across]
        differs = there != wanted
        first = differs.argmax(axis=1)
        rows = np.arange(m)
        less = np.where(differs[rows, first], there[rows, first] < wanted[rows, first], upper)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def longest_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(length, place in a, place in b) of the longest common run; of several the first in ``a``, then in ``b``.

    Runs of 1, 2, 4 ... get ranks, equal for equal runs; two ranks compare runs of any length.
    """
    text = np.concatenate([a, [-1], b, [-2]])
    edge, n = len(a) + 1, len(text)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    while 2 << len(ranks) - 1 <= min(len(a), len(b)):
        r, half = ranks[-1], 1 << len(ranks) - 1
        ranks.append(np.unique(r[: len(r) - half] * n + r[half:], return_inverse=True)[1].astype(np.int64))

    def common(length: int) -> tuple[int, int] | None:
        k = length.bit_length() - 1
        r, shift = ranks[k], length - (1 << k)
        key = r[: n - length + 1] * n + r[shift : shift + n - length + 1]
        left, right = key[: len(a) - length + 1], key[edge : edge + len(b) - length + 1]
        at = np.flatnonzero(np.isin(left, right))
        return (int(at[0]), int(np.flatnonzero(right == left[at[0]])[0])) if len(at) else None

    low, best, high = 0, (0, 0), min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if found := common(mid):
            low, best = mid, found
        else:
            high = mid - 1
    return low, *best


class Items:
    """A block of items: their words as numbers into a list of distinct words, and where each item begins."""

    def __init__(self, ids: list[int | None], lists: pa.ListArray) -> None:
        words = lists.flatten().dictionary_encode()
        self.ids, self.words, self.flat = ids, words.dictionary.to_pylist(), words.indices.to_numpy()
        self.starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]


class Shard:
    """Words of whole documents, numbered by a dictionary of its own; 0 ends a stream."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = array("i")
        self.starts: list[int] = []
        self.docs: list[int] = []
        self.pieces = Pieces(self._coded)
        self.text: np.ndarray | None = None

    def add(self, doc: int, parts: list[list[str]]) -> None:
        self.starts.append(len(self.ids))
        self.docs.append(doc)
        numbers = self.numbers
        for part in parts:
            self.ids.extend([numbers.setdefault(w, len(numbers) + 1) for w in part])
            self.ids.append(0)

    def _coded(self, texts: list[str]) -> list[array]:
        numbers = self.numbers
        return [array("i", [numbers.setdefault(w, len(numbers) + 1) for w in words(t)]) for t in texts]

    def read(self, doc: int, page: str | None) -> None:
        """Adds a page: its main stream and the others, each with its end."""
        self.starts.append(len(self.ids))
        self.docs.append(doc)
        pieces, ids = self.pieces(page), self.ids
        for piece in pieces:
            ids.extend(piece[0])
        ids.append(0)
        for piece in pieces:
            for other in piece[1:]:
                if other:
                    ids.extend(other)
                    ids.append(0)

    def build(self, min_words: int) -> None:
        n = len(self.ids)
        self.text = np.zeros(n + min_words, np.int32)
        self.text[:n] = np.frombuffer(self.ids, np.int32)
        self.order = suffix_array(self.text[:n], min_words)
        self.ends = np.r_[self.starts, n]

    def matches(self, items: Items, min_words: int) -> list[tuple[int, int, int, int, int]]:
        """(doc, item, words, place in the doc, place in the item) of each pair's longest match."""
        if not len(self.ids) or len(items.flat) < min_words:
            return []
        if self.text is None:
            self.build(min_words)
        find = self.numbers.get
        coded = np.array([find(w, -1) for w in items.words], np.int32)[items.flat]
        of = np.repeat(np.arange(len(items.ids)), np.diff(items.starts))
        known = np.r_[0, np.cumsum(coded > 0)]
        begins = np.flatnonzero((known[min_words:] - known[:-min_words] == min_words) & (of[: len(of) - min_words + 1] == of[min_words - 1 :]))
        low, high = np.empty(len(begins), np.int64), np.empty(len(begins), np.int64)
        across = np.arange(min_words)
        for c in range(0, len(begins), _CHUNK):
            head = coded[begins[c : c + _CHUNK, None] + across]
            low[c : c + _CHUNK] = _bound(self.text, self.order, head, False)
            high[c : c + _CHUNK] = _bound(self.text, self.order, head, True)
        occurs = high > low
        begins, low, high = begins[occurs], low[occurs], high[occurs]
        if not len(begins):
            return []
        # A head that an item repeats is looked up once; its pairs are marked.
        key = of[begins] * (len(self.order) + 1) + low
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        begins, low, high = begins[first], low[first], high[first]
        ends = np.cumsum(high - low)
        starts = np.flatnonzero(np.r_[True, np.diff(of[begins]) > 0])  # of each item that occurs
        stops = np.r_[starts[1:], len(begins)]
        out: list[tuple[int, int, int, int, int]] = []
        k = 0
        while k < len(starts):  # whole items, as many as have OPEN_PLACES places, but one at least
            before = ends[starts[k] - 1] if starts[k] else 0
            to = max(k + 1, int(np.searchsorted(ends[stops - 1], before + OPEN_PLACES, side="right")))
            part = slice(starts[k], stops[to - 1])
            out += self._followed(items, begins[part], low[part], high[part], times[part] > 1, of, coded, min_words)
            k = to
        return out

    def _followed(self, items: Items, begins: np.ndarray, low: np.ndarray, high: np.ndarray, repeated: np.ndarray, of: np.ndarray, coded: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int]]:
        hits = high - low
        which = np.repeat(np.arange(len(begins)), hits)
        place = self.order[np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)]
        doc = np.searchsorted(self.ends, place, side="right") - 1
        pair = of[begins][which] * len(self.docs) + doc
        pairs, pair = np.unique(pair, return_inverse=True)
        marked = np.zeros(len(pairs), bool)
        marked[pair[repeated[which]]] = True
        plain = ~marked[pair]
        pair, place, begin = pair[plain], place[plain], begins[which[plain]]
        out = []
        if len(pair):
            order = np.lexsort((begin, place - begin, pair))
            pair, place, begin = pair[order], place[order], begin[order]
            new = np.r_[True, (pair[1:] != pair[:-1]) | (place[1:] != place[:-1] + 1) | (begin[1:] != begin[:-1] + 1)]
            runs = np.flatnonzero(new)
            length = np.diff(np.r_[runs, len(pair)]) + min_words - 1
            pair, place, begin = pair[runs], place[runs], begin[runs]
            order = np.lexsort((begin, place, -length, pair))
            best = order[np.r_[True, pair[order][1:] != pair[order][:-1]]]
            for i in best:
                item, d = divmod(int(pairs[pair[i]]), len(self.docs))
                out.append((self.docs[d], items.ids[item], int(length[i]), int(place[i] - self.ends[d]), int(begin[i] - items.starts[item])))
        for p in np.flatnonzero(marked):
            item, d = divmod(int(pairs[p]), len(self.docs))
            # 0, the end of a stream, and -1, a word that the shard lacks, never agree
            length, at, begin = longest_common(self.text[self.ends[d] : self.ends[d + 1]], np.where(coded[items.starts[item] : items.starts[item + 1]] < 0, -3, coded[items.starts[item] : items.starts[item + 1]]))
            out.append((self.docs[d], items.ids[item], length, at, begin))
        return out


def _item_blocks(folder: str, block_words: int) -> Iterator[Items]:
    """The stored items in blocks of about ``block_words`` words; a longer item is a block by itself."""
    for batch in stored_batches(folder, BLOCK_ITEMS):
        ids, lists = batch.column(0).to_pylist(), batch.column(1)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_words, side="right")))
            yield Items(ids[at:to], lists[at:to])
            at = to


def _searcher(folder: str, min_words: int, shard_words: int, block_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(shard: Shard) -> Iterator[pa.RecordBatch]:
            for block in _item_blocks(folder, block_words) if len(shard.ids) else ():
                if found := shard.matches(block, min_words):
                    columns = list(zip(*found))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "matched_words", "doc_word", "item_word"])

        shard = Shard()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                shard.read(ids[i].as_py(), texts[i].as_py())
                if len(shard.ids) >= shard_words:
                    yield from rows(shard)
                    shard = Shard()
        yield from rows(shard)

    return search


def item_words(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """``item_id`` and ``words`` of the items that can leak."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [plain_words(t.as_py()) for t in batch.column(1)]
            some = pa.array([len(w) >= min_words for w in lists], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), pa.array(lists, pa.list_(pa.string())).filter(some)], names=["item_id", "words"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(split, "item_id bigint, words array<string>")


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and item of which some ``min_words`` consecutive words stand in the document.

    Columns: ``doc_id``, ``item_id``, ``matched_words`` (the longest match), ``doc_word`` and
    ``item_word`` (where it begins, in words).
    """
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    folder = stored(item_words(items, item_id, item_text, min_words), "items")
    return spread(corpus).mapInArrow(_searcher(folder, min_words, shard_words, block_words), _SCHEMA)


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    name = "_leaked"
    while name in documents.columns:
        name += "_"
    bad = leaks.select(F.col("doc_id").alias(name)).distinct()
    return documents.join(bad, F.col(doc_id) == F.col(name), "left_anti")
