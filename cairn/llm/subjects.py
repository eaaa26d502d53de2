"""Subject areas of pages: one-versus-rest linear classifiers over hashed word n-grams.

Pages become blocks of numbers once: the distinct sentences of some thousand pages as hashes of
their words, and for each page which sentences it has in which section. The blocks lie in the shared folder; all
that follows are passes over them in numpy, and what a pass gives the driver has a fixed size.

Words. A word counts if it stands on ``WORD_SHARE`` of all pages (at least ``LEAST_PAGES``; distinct pages are
counted by HyperLogLog registers merged over blocks) or in an excerpt, so that names, which say who is mentioned and
not what a page is about, aren't words. There are at most (words of an average page) / ``WORD_SHARE`` of them,
whatever the size of the corpus.

Weak labels. Words of the labelled excerpts are evidence for their subjects; evidence spreads over all pages in a few
rounds: a sentence's label comes from its words and from what else is known of its section and page, and lends its
label to its words. Section and page metadata (headings, titles, categories, namespace, and the parts of an address where
the pages have one) takes part like sentences whose words are kept apart from those of the text. Words spread
evenly over subjects say nothing; a sentence of only such words is about no subject. All documents count;
of a page that holds more than ``PAGE_SHARE`` of them the revisions count less, so that it weighs that share.

Classifiers. Logistic fits over unigrams and hashed bigrams, which start from the evidence of single words, on excerpts
and a sample of weakly labelled sentences, chosen by a hash per label, of about ``FIT_SENTENCES`` in all. A quarter of all
sentences, by hash, is held out. On a sample of those (``WEIGH_SENTENCES``) five weights are fitted that join a
subject's score, the best other score, what the page's other sentences are about and how much they say. Per subject the threshold is then
the one with the best F1 over all held-out sentences, whether another subject scores higher or not: a sentence has
every subject that reaches its threshold. A page gets every subject that at least ``SHARE`` of its
subject-bearing sentences are about.

Defined results: null and empty texts and pages without a subject-bearing sentence
have no row; without labelled excerpts there are no subjects and no rows; null and
blank labels are left out; equal labels after trimming and lowering are one subject; of a page that points to another
the line that does so is left out. Results don't depend on how the rows are partitioned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .wikitext import Pieces

SHARE = 0.25
ROUNDS = 5
FIT_SENTENCES = 150_000
WEIGH_SENTENCES = 10_000
MAX_EXAMPLES = 100_000
WORD_SHARE = 1e-3
LEAST_PAGES = 3
PAGE_SHARE = 1e-3
BUCKETS = 1 << 17
MIN_SENTENCE_WORDS = 4
BLOCK_DOCS = 2_000
BLOCK_WORDS = 1 << 20
# What the rounds take as sure, as telling, and how much of a page's subjects a sentence without a telling word lends its words.
SURE, TELLING, LENT, LABELLED = 0.8, 0.2, 0.3, 0.6
_REGISTERS = 32
_RANGE = 4096
_UNIT = 1 << 20  # sums are of whole numbers of 1 / _UNIT, so that their order doesn't matter
_BINS = np.arange(-15, 15.01, 0.05)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
# How a line begins that points to another page, and the namespaces of categories.
_REDIRECT = re.compile(r"\s*#(?:redirect|redirection|weiterleitung|redirección|redireccion)\b[^\n]*", re.IGNORECASE)
_CATEGORY = re.compile(r"\[\[\s*(?:category|kategorie|catégorie|categoría|categoria)\s*:([^\]|\n]*)", re.IGNORECASE)
_HEADING = re.compile(r"=+\s*(.*?)\s*=+\s*\Z")
# Digits written for letters in vandalised text.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})


def sentence_words(sentence: str) -> list[str]:
    """Lower-case words; of a word that mixes letters and digits the digits are read as letters."""
    return [w.translate(_LEET) if not w.isalpha() and not w.isdigit() else w for w in _WORD.findall(sentence.lower()) if not w.isdigit()]


def page_lines(text: str | None, pieces: Pieces | None = None) -> Iterator[tuple[int, str, bool]]:
    """The lines of a page with the number of their section, and the headings that begin sections."""
    if not text:
        return
    if m := _REDIRECT.match(text):
        text = text[m.end() :]
    section = 0
    read = (pieces or Pieces())(text)
    for stream in (*(p[0] for p in read), *(t for p in read for t in p[1:])):
        for line in stream.split("\n"):
            line = line.strip()
            if not line:
                continue
            if line[0] == "=" and (m := _HEADING.match(line)):
                section += 1
                yield section, m.group(1), True
                continue
            yield section, line, False


def page_sentences(text: str | None) -> list[tuple[int, list[str]]]:
    """The sentences of a page, as words, with the number of their section."""
    return [(section, w) for section, line, heading in page_lines(text) if not heading for s in _SENTENCE.split(line) if len(w := sentence_words(s)) >= MIN_SENTENCE_WORDS]


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1  # fits a signed number


# ---------------------------------------------------------------- pages as blocks of numbers

_BLOCK = {
    "words": "array<bigint>",  # hashes of the block's distinct words
    "codes": "array<int>", "starts": "array<int>", "meta": "array<boolean>",  # its distinct sentences: words by place in ``words``; whether one is metadata
    "sentences": "array<int>", "sections": "array<int>", "lengths": "array<int>",  # per document: which sentences, in which section, how many
    "docs": "array<bigint>", "pages": "array<bigint>",
}


class _Encoder:
    def __init__(self) -> None:
        self.hashes: dict[str, int] = {}  # a token's hash, 0 for a number
        self.pieces = Pieces()
        self.clear()

    def clear(self) -> None:
        self.tokens: list[str] = []  # of the sentences, one after the other
        self.starts, self.meta = [0], []
        self.known: dict[tuple[str, str], int] = {}
        self.lines: dict[str, list[int]] = {}
        self.sentences: list[int] = []
        self.sections: list[int] = []
        self.lengths: list[int] = []
        self.docs: list[int | None] = []
        self.pages: list[int] = []

    def hashed(self, token: str) -> int:
        """Words of metadata are told from those of the text by a letter or number and a colon before them."""
        h = self.hashes.get(token)
        if h is None:
            if len(self.hashes) > 1_000_000:
                self.hashes.clear()
            kind, _, bare = token.rpartition(":")
            kind = kind and kind + ":"
            h = self.hashes[token] = 0 if bare.isdigit() else _hash(token if bare.isalpha() else kind + bare.translate(_LEET))
        return h

    def number(self, kind: str, text: str) -> int:
        """The number of a sentence in the block."""
        n = self.known.get((kind, text))
        if n is None:
            words = _WORD.findall(text.lower())
            n = self.known[kind, text] = len(self.meta)
            self.tokens += [kind + w for w in words] if kind else words
            self.starts.append(len(self.tokens))
            self.meta.append(bool(kind))
        return n

    def add(self, doc: int | None, page: int, text: str, about: Sequence[tuple[str, str | None]]) -> None:
        before, section, lines = len(self.sentences), 0, self.lines
        for section, line, heading in page_lines(text, self.pieces):
            if heading:
                self.sentences.append(self.number("h:", line))
                self.sections.append(section)
                continue
            numbers = lines.get(line)  # revisions of a page share most of their lines
            if numbers is None:
                numbers = lines[line] = [self.number("", s) for s in _SENTENCE.split(line)]
            self.sentences += numbers
            self.sections += [section] * len(numbers)
        for kind, s in (*about, *(("c:", c) for c in _CATEGORY.findall(text))):
            if s:
                self.sentences.append(self.number(kind, s))
                self.sections.append(section + 1)
        self.lengths.append(len(self.sentences) - before)
        self.docs.append(doc)
        self.pages.append(page)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or len(self.tokens) >= BLOCK_WORDS or len(self.sentences) >= BLOCK_WORDS

    def block(self) -> pa.RecordBatch:
        """The block so far, without numbers and without sentences of too few words."""
        tokens = pa.array(self.tokens, pa.string()).dictionary_encode()
        h = np.array([self.hashed(t) for t in tokens.dictionary.to_pylist()], np.int64)[tokens.indices.to_numpy()] if self.tokens else np.zeros(0, np.int64)
        starts, meta = np.array(self.starts), np.array(self.meta, bool)
        sizes = _sums((h != 0).astype(np.int64), starts)
        valid = sizes >= np.where(meta, 1, MIN_SENTENCE_WORDS)
        words, codes = np.unique(h[(h != 0) & np.repeat(valid, np.diff(starts))], return_inverse=True)
        sentences, doc = np.array(self.sentences, np.int64), np.repeat(np.arange(len(self.docs)), self.lengths)
        kept = valid[sentences] if len(sentences) else np.zeros(0, bool)
        columns = [
            words, codes.astype(np.int32), np.r_[0, np.cumsum(sizes[valid])].astype(np.int32), meta[valid], (np.cumsum(valid) - 1)[sentences[kept]].astype(np.int32) if len(valid) else sentences.astype(np.int32),
            np.array(self.sections, np.int32)[kept], np.bincount(doc[kept], minlength=len(self.docs)).astype(np.int32), self.docs, self.pages,
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k)) for c, k in zip(columns, kinds)], names=list(_BLOCK))


def blocks_of(documents: DataFrame, doc_id: str = "doc_id", page_id: str | None = "page_id", text: str = "text", about: Sequence[str] = ()) -> DataFrame:
    """The documents that have a text as rows of numbers, in the shared folder. ``about`` are columns of metadata, such as a title or an address."""
    key = F.coalesce(*(F.col(c).cast("string") for c in (page_id, doc_id) if c), F.lit(""))
    texts = documents.select(F.col(doc_id).cast("bigint").alias("_doc"), F.xxhash64(key).alias("_page"), F.col(text).alias("_text"), *(F.col(c).cast("string").alias(f"_about{i}") for i, c in enumerate(about)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder()
        for batch in batches:
            docs, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            told = [[(f"{i}:", v) for v in batch.column(3 + i).to_pylist()] for i in range(len(about))]
            for i, (d, p, t) in enumerate(zip(docs, pages, batch.column(2))):
                encoder.add(d, p, t.as_py(), [x[i] for x in told])
                if encoder.full():
                    yield encoder.block()
        if encoder.docs:
            yield encoder.block()

    return cut(spread(texts.where(F.length("_text") > 0)).mapInArrow(encode, ", ".join(f"{n} {t}" for n, t in _BLOCK.items())))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between each two ``starts``, 0 where there are none."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, starts[:-1][some], axis=0)
    return out


def _by(rows: np.ndarray, into: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of equal ``into``."""
    return np.stack([np.bincount(into, rows[:, c], minlength=n) for c in range(rows.shape[1])], axis=1) if len(rows) else np.zeros((n, rows.shape[1]))


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _grams(flat: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Unigrams by number and bigrams by hash, sentence by sentence."""
    n = np.diff(starts)
    own = np.repeat(np.arange(len(n)), n)
    pair = own[1:] == own[:-1]
    bigrams = (_mixed(flat[:-1][pair], flat[1:][pair]) % np.uint64(BUCKETS)).astype(np.int64) + words
    all_, of = np.concatenate([flat, bigrams]), np.concatenate([own, own[:-1][pair]])
    order = np.argsort(of, kind="stable")
    return all_[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))]


class Block:
    """A row of ``blocks_of`` as arrays; with a vocabulary, words are numbers in it and others are left out."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: np.ndarray | None = None) -> None:
        for i, name in enumerate(_BLOCK):
            values = batch.column(i)[row].values
            setattr(self, name, values.to_pylist() if name == "docs" else values.to_numpy(zero_copy_only=False))
        self.sentences, self.starts = self.sentences.astype(np.int64), self.starts.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.docs)), self.lengths)
        self.said = ~self.meta[self.sentences]  # of each sentence of a document whether it is text
        if vocabulary is None:
            self.flat = self.codes
        else:
            at = np.minimum(np.searchsorted(vocabulary, self.words), len(vocabulary) - 1)
            at = np.where(vocabulary[at] == self.words, at, -1)[self.codes]
            kept = at >= 0
            self.flat, self.starts = at[kept], np.r_[0, np.cumsum(kept)][self.starts]

    def keys(self, words: int) -> np.ndarray:
        """A hash of each distinct sentence, of its words in order."""
        place = np.arange(len(self.flat)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        return _mixed(_sums(_mixed(self.flat + 1, place), self.starts), 1)


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray | None = None) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row, vocabulary)


# ---------------------------------------------------------------- words


def _registers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and word the registers of the pages that it stands on."""
    for b in _blocks(batches):
        pairs = np.unique(np.unique(b.pages, return_inverse=True)[1][b.doc] * len(b.meta) + b.sentences)
        page, sentence = np.unique(b.pages)[pairs // max(1, len(b.meta))], pairs % max(1, len(b.meta))
        n = np.diff(b.starts)[sentence]
        flat = b.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.starts[sentence], n)]
        h = _mixed(page, 7)
        register = (h % np.uint64(_REGISTERS)).astype(np.int64)
        rank = (64 - np.floor(np.log2((h >> np.uint64(5)).astype(np.float64) + 1))).astype(np.uint8)
        seen = np.zeros(len(b.words) * _REGISTERS, np.uint8)
        np.maximum.at(seen, flat.astype(np.int64) * _REGISTERS + np.repeat(register, n), np.repeat(rank, n))
        for at in range(0, len(b.words), 1 << 16):
            part = seen[at * _REGISTERS : (at + (1 << 16)) * _REGISTERS]
            yield pa.RecordBatch.from_arrays([pa.array(b.words[at : at + (1 << 16)]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(_REGISTERS), len(part) // _REGISTERS, [None, pa.py_buffer(part.tobytes())]).cast(pa.binary())], names=["word", "registers"])


def _frequent(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Registers in the order of their words to the words on about ``least`` pages or more."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None

        def found(words: np.ndarray, registers: np.ndarray) -> pa.RecordBatch:
            empty = (registers == 0).sum(axis=1)
            raw = 0.697 * _REGISTERS**2 / (2.0 ** -registers.astype(np.float64)).sum(axis=1)
            pages = np.where((raw <= 2.5 * _REGISTERS) & (empty > 0), _REGISTERS * np.log(_REGISTERS / np.maximum(empty, 1)), raw)
            return pa.RecordBatch.from_arrays([pa.array(words[pages >= least])], names=["word"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_numpy()
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, _REGISTERS)
            if held is not None:
                words, registers = np.r_[held[0], words], np.r_[held[1], registers]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            words, registers = words[first], np.maximum.reduceat(registers, first, axis=0)
            yield found(words[:-1], registers[:-1])
            held = words[-1:], registers[-1:]
        if held is not None:
            yield found(*held)

    return merge


def frequent_words(blocks: DataFrame, pages: int, word_share: float = WORD_SHARE) -> np.ndarray:
    """Hashes of the words on ``word_share`` of the pages: at most the words of an average page / ``word_share``."""
    seen = blocks.mapInArrow(_registers, "word bigint, registers binary").repartition("word").sortWithinPartitions("word")
    rows = seen.mapInArrow(_frequent(max(LEAST_PAGES - 0.9, word_share * pages)), "word bigint")
    return np.array(sorted(r[0] for r in rows.collect()), np.int64)


# ---------------------------------------------------------------- weak labels


@dataclass
class Evidence:
    """What single words say: ``weights`` (words x subjects) and how ``telling`` they are, and what weighs less of the corpus."""

    vocabulary: np.ndarray
    weights: np.ndarray
    telling: np.ndarray
    prior: np.ndarray
    heavy: np.ndarray
    heavy_weight: np.ndarray

    def weight(self, b: Block) -> np.ndarray:
        """The weight of each document."""
        if not len(self.heavy):
            return np.ones(len(b.docs))
        at = np.minimum(np.searchsorted(self.heavy, b.pages), len(self.heavy) - 1)
        return np.where(self.heavy[at] == b.pages, self.heavy_weight[at], 1.0)

    def labels(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence of each document: its label (-1 for none, -2 if it isn't known), what it lends its words, and its subjects (0 if mute)."""
        k, n = len(self.prior), len(b.docs)
        own = _sums(self.weights[b.flat], b.starts).astype(np.float64)
        told = np.zeros(len(b.meta), np.float32)
        some = np.flatnonzero(np.diff(b.starts) > 0)
        if len(some):
            told[some] = np.maximum.reduceat(self.telling[b.flat], b.starts[:-1][some])
        soft = np.exp(own - own.max(axis=1, keepdims=True))
        soft /= soft.sum(axis=1, keepdims=True)
        known = (soft * (soft.max(axis=1) >= SURE)[:, None])[b.sentences]
        section = b.doc * (int(b.sections.max(initial=0)) + 1) + b.sections
        section = np.unique(section, return_inverse=True)[1]
        of_page = _by(known, b.doc, n) + 0.5 * self.prior
        of_section = _by(known, section, int(section.max(initial=-1)) + 1)
        # A sentence's own part isn't counted; its section counts three times in all.
        around = np.maximum(of_page[b.doc] + 2 * of_section[section] - 3 * known, 0.02)
        around /= around.sum(axis=1, keepdims=True)
        both = soft[b.sentences] * around
        both /= both.sum(axis=1, keepdims=True)
        mute = (told < TELLING)[b.sentences]
        # A sentence without a telling word lends its words to the page's subjects: words found on pages of one subject become telling.
        lent = np.where(mute[:, None], LENT * around, both)
        label = np.where(mute, -1, np.where(both.max(axis=1, initial=0) >= LABELLED, both.argmax(axis=1) if k else -1, -2))
        return label, lent, np.where(mute[:, None], 0.0, both)


def _evidence(counts: np.ndarray, prior: np.ndarray, vocabulary: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> Evidence:
    """How much more often a word stands with a subject than words do at large, as far as it tells subjects apart."""
    total = counts.sum(axis=1, keepdims=True)
    share = (counts + prior) / (total + 1.0)
    even = -(share * np.log(share)).sum(axis=1) / np.log(max(2, len(prior)))
    telling = np.clip(1 - even, 0, 1) * (total[:, 0] >= 1) * (share.max(axis=1) >= 0.3)
    return Evidence(vocabulary, (np.log(share / prior) * telling[:, None]).astype(np.float32), telling.astype(np.float32), prior, *heavy)


def _totals(df: DataFrame, width: int) -> np.ndarray:
    """Adds the arrays of equal ``range`` and returns them one after the other: as many numbers as one task gives."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = -1, None
        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                values = batch.column(1)[i].values.to_numpy()
                if r != at:
                    if at >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["range", "sums"])
                    at, total = r, values.copy()
                else:
                    total += values
        if at >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["range", "sums"])

    out = np.zeros(width)
    for r, sums in df.repartition("range").sortWithinPartitions("range").mapInArrow(add, "range int, sums array<double>").collect():
        out[r * _RANGE : r * _RANGE + len(sums)] = sums
    return out


def _sent(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(total), _RANGE):
        yield pa.RecordBatch.from_arrays([pa.array([at // _RANGE], pa.int32()), pa.array([total[at : at + _RANGE]], pa.list_(pa.float64()))], names=["range", "sums"])


def _round(evidence: Evidence, k: int):
    """What all sentences lend their words, the weight of each subject, and the weight of the sentences by label (none last)."""

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(evidence.vocabulary)
        total = np.zeros(v * k + k + 1 + k + 1)
        for b in _blocks(batches, evidence.vocabulary):
            label, lent, both = evidence.labels(b)
            weight = evidence.weight(b)[b.doc]
            by_sentence = _by(np.rint(lent * (weight * _UNIT)[:, None]), b.sentences, len(b.meta))
            total[: v * k] += _by(np.repeat(by_sentence, np.diff(b.starts), axis=0), b.flat, v).ravel()
            spoken = b.said & (both.max(axis=1, initial=0) > 0)
            total[v * k : v * k + k] += np.rint(both[spoken] * (weight[spoken] * _UNIT)[:, None]).sum(axis=0)
            total[v * k + k] += np.rint(weight[spoken] * _UNIT).sum()
            counted = b.said & (label > -2)
            total[v * k + k + 1 :] += np.bincount(np.where(label < 0, k, label)[counted], np.rint(weight[counted] * _UNIT), minlength=k + 1)
        yield from _sent(total)

    return lend


# ---------------------------------------------------------------- classifiers


@dataclass
class SubjectModel:
    """``weights`` are n-grams x subjects; a sentence is about each subject for which ``joined`` reaches the threshold."""

    subjects: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    joint: np.ndarray
    thresholds: np.ndarray

    def parts(self, b: Block) -> tuple[np.ndarray, ...]:
        """Of each sentence of each document, per subject: its score, the best other score, the log share of the subject in the rest of the page, and how little that rest says."""
        k, n = len(self.subjects), len(b.docs)
        flat, starts = _grams(b.flat, b.starts, len(self.vocabulary))
        score = _sums(self.weights[flat], starts) + self.bias
        if k > 1:
            two = np.partition(score, k - 2, axis=1)[:, k - 2 :]
            other = np.where(score == two[:, 1:], two[:, :1], two[:, 1:])
        else:
            other = np.zeros_like(score)
        about = (1 / (1 + np.exp(-np.clip(score, -30, 30))))[b.sentences] * b.said[:, None]
        rest = np.maximum(_by(about, b.doc, n)[b.doc] - about, 0) + 0.5
        whole = rest.sum(axis=1, keepdims=True)
        alone = 1 / (1 + whole - 0.5 * k)
        return score[b.sentences], other[b.sentences], np.log(rest / whole), np.repeat(alone, k, axis=1)

    def joined(self, b: Block) -> np.ndarray:
        return np.round(sum(w * x for w, x in zip(self.joint, self.parts(b))) + self.joint[-1], 6)

    def found(self, b: Block, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(document, subject) of a block, by number."""
        about = (self.joined(b) >= self.thresholds) & b.said[:, None]
        votes = _by(about.astype(np.float64), b.doc, len(b.docs))
        bearing = np.bincount(b.doc, about.any(axis=1), minlength=len(b.docs))
        return np.nonzero((votes > 0) & (votes >= share * bearing[:, None]))


def _fit(grams: list[np.ndarray], labels: np.ndarray, start: np.ndarray, k: int, epochs: int = 4, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Logistic one-versus-rest fits by AdaGrad over mini-batches from ``start``; label -1 is a negative of all."""
    rng = np.random.default_rng(seed)
    weights, bias = start.copy(), np.full(k, -1.0, np.float32)
    squares = np.full((len(weights), 1), 1e-2, np.float32)
    target = (labels[:, None] == np.arange(k)).astype(np.float32)
    sizes, all_ = np.array([len(g) for g in grams]), np.concatenate(grams)
    begin = np.cumsum(sizes) - sizes
    for _ in range(epochs):
        order = rng.permutation(len(grams))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            n = sizes[batch]
            first = np.cumsum(n) - n
            flat = all_[np.arange(n.sum()) - np.repeat(first, n) + np.repeat(begin[batch], n)]
            score = np.add.reduceat(weights[flat], first, axis=0) + bias
            slope = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[batch]
            by = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.r_[True, flat[by][1:] != flat[by][:-1]])
            touched = flat[by][cuts]
            grad = np.add.reduceat(np.repeat(slope, n, axis=0)[by], cuts, axis=0) + decay * weights[touched]
            squares[touched] += (grad**2).max(axis=1, keepdims=True)
            weights[touched] -= rate * grad / np.sqrt(squares[touched])
            bias -= rate * 0.02 * slope.mean(axis=0)
    return weights, bias


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Newton steps for a logistic fit of a few weights."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
    return w


def _held(keys: np.ndarray) -> np.ndarray:
    return keys % np.uint64(4) == 0


def _share(keys: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 from other bits of a key."""
    return (keys >> np.uint64(8)).astype(np.float64) / 2.0**56


def _sample(evidence: Evidence, rates: np.ndarray):
    """Labelled sentences of pages that aren't held out, each label at its rate (none last); the key is one of page and sentence."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(evidence.vocabulary)
        for b in _blocks(batches, evidence.vocabulary):
            label, _, _ = evidence.labels(b)
            keys = b.keys(v)
            flat, starts = _grams(b.flat, b.starts, v)
            free = ~_held(keys) & (np.diff(starts) > 0)
            taken = np.flatnonzero(b.said & (label > -2) & free[b.sentences])
            key = _mixed(keys[b.sentences[taken]], b.pages[b.doc[taken]].view(np.uint64))
            some = _share(key) < rates[label[taken]]
            taken, key = taken[some], key[some]
            once = np.unique(np.stack([key, label[taken].astype(np.uint64)], axis=1), axis=0, return_index=True)[1]
            taken, key = taken[once], key[once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(label[taken].astype(np.int32)), pa.array([flat[starts[s] : starts[s + 1]] for s in b.sentences[taken]], pa.list_(pa.int64()))], names=["key", "label", "grams"]
            )

    return choose


def _weighed(model: SubjectModel, evidence: Evidence, rate: float):
    """What the joint weights are fitted on: held-out sentences at a rate, a row per subject."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, evidence.vocabulary):
            label, _, _ = evidence.labels(b)
            keys = b.keys(len(evidence.vocabulary))
            # by document as well, as the rest of the page is what differs
            chance = _share(_mixed(keys[b.sentences], b.pages[b.doc].view(np.uint64)))
            taken = np.flatnonzero(b.said & (label > -2) & _held(keys)[b.sentences] & (chance < rate))
            columns = [pa.array(np.round(x[taken].astype(np.float64), 6).ravel()) for x in model.parts(b)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((label[taken][:, None] == np.arange(len(model.subjects))).ravel())], names=["score", "other", "rest", "alone", "is"])

    return choose


def _histograms(model: SubjectModel, evidence: Evidence):
    """Held-out sentences by joined score, those about the subject and all, per subject."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.subjects)
        total = np.zeros((k, 2, len(_BINS)))
        for b in _blocks(batches, evidence.vocabulary):
            label, _, _ = evidence.labels(b)
            taken = b.said & (label > -2) & _held(b.keys(len(evidence.vocabulary)))[b.sentences]
            bins = np.clip(np.searchsorted(_BINS, model.joined(b)[taken], side="right") - 1, 0, len(_BINS) - 1)
            for c in range(k):
                total[c, 0] += np.bincount(bins[label[taken] == c, c], minlength=len(_BINS))
                total[c, 1] += np.bincount(bins[:, c], minlength=len(_BINS))
        yield from _sent(total.ravel())

    return count


def _thresholds(histograms: np.ndarray) -> np.ndarray:
    """Per subject the cut with the best F1 over all held-out sentences; 0 where none of them is about it."""
    hits, all_ = (np.cumsum(histograms[:, i, ::-1], axis=1) for i in (0, 1))
    f1 = 2 * hits / np.maximum(all_ + hits[:, -1:], 1)
    best, n = f1 >= f1.max(axis=1, keepdims=True), len(_BINS)
    middle = (best.argmax(axis=1) + n - 1 - best[:, ::-1].argmax(axis=1)) // 2  # of the cuts that are equally good
    return np.where(hits[:, -1] > 0, _BINS[::-1][middle], 0.0)


def labelled(examples: DataFrame, subject: str = "subject", text: str = "text", max_examples: int = MAX_EXAMPLES) -> list[tuple[str, str]]:
    """(label, text) of the excerpts; of more than ``max_examples`` about as many, each label at its own rate by a hash of the text, so that no label is left out."""
    label = F.lower(F.trim(F.col(subject)))
    rows = examples.select(label.alias("_label"), F.col(text).alias("_text")).where((F.col("_label") != "") & F.col("_text").isNotNull())
    sizes = rows.groupBy("_label").count().collect()  # a row per subject
    if sum(r[1] for r in sizes) > max_examples:
        each = max(1.0, max_examples / len(sizes))
        rate = F.create_map(*(F.lit(x) for r in sizes for x in (r[0], min(1.0, each / r[1]))))
        rows = rows.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 20)) < F.element_at(rate, F.col("_label")) * (1 << 20))
    return sorted((r[0], r[1]) for r in rows.collect())


def fit_subjects(
    examples: DataFrame, documents: DataFrame, fit_sentences: int = FIT_SENTENCES, rounds: int = ROUNDS, example_text: str = "text", subject: str = "subject",
    doc_id: str = "doc_id", page_id: str | None = "page_id", text: str = "text", about: Sequence[str] = (), word_share: float = WORD_SHARE, blocks: DataFrame | None = None,
) -> SubjectModel | None:
    """Fits on the labelled excerpts and all documents. ``None`` without labels. ``blocks`` are those of the documents, if they are made already."""
    rows = labelled(examples, subject, example_text)
    subjects = sorted({s for s, _ in rows})
    if not subjects:
        return None
    k, number = len(subjects), {s: i for i, s in enumerate(subjects)}
    blocks = blocks_of(documents, doc_id, page_id, text, about) if blocks is None else blocks
    page = F.xxhash64(F.coalesce(*(F.col(c).cast("string") for c in (page_id, doc_id) if c), F.lit("")))
    by_page = documents.where(F.length(text) > 0).groupBy(page.alias("_page")).count()
    pages, docs = by_page.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    most = max(1.0, PAGE_SHARE * docs)
    large = sorted((r[0], most / r[1]) for r in by_page.where(F.col("count") > most).collect())  # fewer than 1 / PAGE_SHARE
    heavy = np.array([p for p, _ in large], np.int64), np.array([w for _, w in large])

    split = [(number[s], [_hash(w) for w in words]) for s, t in rows for x in _SENTENCE.split(t) if len(words := sentence_words(x)) >= MIN_SENTENCE_WORDS]
    vocabulary = np.union1d(frequent_words(blocks, pages, word_share), np.array([h for _, w in split for h in w], np.int64)).astype(np.int64)
    v = len(vocabulary)
    if not v:
        return None
    anchors = [(y, np.searchsorted(vocabulary, w)) for y, w in split]
    fixed = np.zeros((v, k))
    for y, w in anchors:
        fixed[np.unique(w), y] += 1
    prior = np.maximum(np.bincount([y for y, _ in anchors], minlength=k), 1) / max(1, len(anchors))
    evidence, sizes = _evidence(fixed, prior / prior.sum(), vocabulary, heavy), np.zeros(k + 1)
    for _ in range(rounds):
        total = _totals(blocks.mapInArrow(_round(evidence, k), "range int, sums array<double>"), v * k + 2 * k + 2)
        lent, spoken, sizes = total[: v * k].reshape(v, k) / _UNIT, total[v * k : v * k + k + 1] / _UNIT, total[v * k + k + 1 :] / _UNIT
        evidence = _evidence(fixed * 3.0 + lent, (spoken[:k] + 1) / (spoken[k] + k), vocabulary, heavy)

    # rates[-1] is that of sentences about nothing, which label -1 finds there
    rates = np.minimum(1.0, fit_sentences / (k + 1) / np.maximum(sizes, 1))
    sample = blocks.mapInArrow(_sample(evidence, rates), "key bigint, label int, grams array<bigint>").dropDuplicates(["key", "label"])
    chosen = sample.orderBy("key", "label").toArrow()  # about fit_sentences rows
    ends = np.cumsum(chosen.column("grams").combine_chunks().value_lengths().to_numpy()) if chosen.num_rows else np.zeros(0, np.int64)
    grams = np.split(chosen.column("grams").combine_chunks().flatten().to_numpy(), ends[:-1]) if chosen.num_rows else []
    labels = chosen.column("label").to_pylist()
    for y, w in anchors:
        grams += [_grams(w, np.array([0, len(w)]), v)[0]] * 3
        labels += [y] * 3
    start = np.zeros((v + BUCKETS, k), np.float32)
    start[:v] = evidence.weights
    weights, bias = _fit(grams, np.array(labels), start, k) if grams else (start, np.zeros(k, np.float32))
    model = SubjectModel(subjects, vocabulary, weights, bias, np.array([1.0, 0.0, 1.0, 0.0, 0.0]), np.zeros(k))
    rate = min(1.0, 4 * WEIGH_SENTENCES / max(1.0, sizes.sum()))
    table = blocks.mapInArrow(_weighed(model, evidence, rate), "score double, other double, rest double, alone double, is boolean").orderBy("score", "other", "rest", "alone", "is").toPandas()
    if len(table):
        model.joint = np.round(_logistic(np.c_[table[["score", "other", "rest", "alone"]].to_numpy(), np.ones(len(table))], table["is"].to_numpy().astype(float)), 6)
    histograms = _totals(blocks.mapInArrow(_histograms(model, evidence), "range int, sums array<double>"), k * 2 * len(_BINS))
    model.thresholds = _thresholds(histograms.reshape(k, 2, len(_BINS)))
    return model


def apply_subjects(model: SubjectModel | None, blocks: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document and subject of ``blocks``."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, model.vocabulary) if model else ():
            doc, subject = model.found(b, share)
            yield pa.RecordBatch.from_arrays([pa.array([b.docs[i] for i in doc], pa.int64()), pa.array([model.subjects[c] for c in subject], pa.string())], names=["doc_id", "subject"])

    return blocks.mapInArrow(tag, "doc_id bigint, subject string")


def subject_areas(
    documents: DataFrame, examples: DataFrame, share: float = SHARE, doc_id: str = "doc_id", page_id: str | None = "page_id", text: str = "text", about: Sequence[str] = (), **kwargs
) -> DataFrame:
    """One row per document and subject that at least ``share`` of its subject-bearing sentences are about."""
    blocks = blocks_of(documents, doc_id, page_id, text, about)
    return apply_subjects(fit_subjects(examples, documents, doc_id=doc_id, page_id=page_id, text=text, about=about, blocks=blocks, **kwargs), blocks, share)


def held_out(documents: DataFrame, examples: DataFrame, example_id: str = "example_id", parts: int = 8, **kwargs) -> DataFrame:
    """Per subject the excerpts that the fit didn't see (one of ``parts``, by a hash of the text), how many of them get a subject, and how many just their own."""
    mine: Column = F.pmod(F.xxhash64("text"), F.lit(parts)) == 0
    blocks = blocks_of(documents, about=kwargs.get("about", ()))
    model = fit_subjects(examples.where(~mine), documents, blocks=blocks, **kwargs)
    label = F.lower(F.trim(F.col("subject")))
    asked = examples.where(mine & (label != "")).select(F.col(example_id).alias("doc_id"), label.alias("_own"), "text")
    got = apply_subjects(model, blocks_of(asked, page_id=None)).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("subject").alias("_got"))
    rows = asked.join(got, F.col("doc_id") == F.col("_id"), "left")
    right = F.coalesce((F.size("_got") == 1) & F.array_contains("_got", F.col("_own")), F.lit(False))
    return rows.groupBy(F.col("_own").alias("subject")).agg(F.count("*").alias("excerpts"), F.count("_got").alias("found"), F.count_if(right).alias("right"))
