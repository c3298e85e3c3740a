"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The test items are indexed: a posting list for each word, in blocks with their largest
impact. An impact is the word's BM25 weight in the item divided by the item's own score
(the score of a passage that holds all its words), so one threshold serves short and long
items. Items of like length (within a factor of two) share an index. For each of these a
document is cut into passages of twice its longest item's words that overlap by half, so
any copy of an item lies whole in one passage, and one long item makes no passages of the
others longer. Each passage is a query. Items
also lie in blocks of their own, and for all passages of a document at once the sum of
their words' largest impacts in each block is taken; where no block can reach the
threshold, the query ends there. For the others block-max WAND retrieves all items that
reach it. Then the item's question and its answer
(its last line, if it has more than one) are looked for: each must have at least
``OVERLAP`` of its five-word shingles in the passage.

The index is the only broadcast. Its size is that of the test items, which is checked;
beyond the bound the items are dealt out to several indexes, each with its own scan.
Documents are read once, without a shuffle, so no key or source can be hot.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import as_batches, fresh, utf8

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 64
#: Characters of test items in one index, and blocks of its items, at most.
INDEX_CHARS = 1_000_000
ITEM_BLOCKS = 256
ITEM_BLOCK = 4

#: ASCII characters other than letters, digits and the underscore, as blanks.
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: In UTF-8: Latin-1 signs, and general punctuation.
_SIGNS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]")


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words as UTF-8, without ASCII, Latin-1 and general punctuation."""
    b = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    if b.isascii():
        b = b.lower()
    else:
        b = b.decode("utf-8", "replace").lower().encode()
        if b"\xc2" in b or b"\xe2" in b:
            b = _SIGNS.sub(b" ", b)
    return b.translate(_BLANKS).split()


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {tuple(w)} if w else set()


def question_and_answer(text: str) -> tuple[str, str]:
    """All lines but the last, and the last; a single line is a question without an answer."""
    lines = [x for x in text.split("\n") if words(x)]
    return ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (text, "")


Item = tuple[int, str, list[bytes]]


def usable(items: list[tuple[int, str]]) -> list[Item]:
    """Items with their words, in order. Those without a word are left out; equal rows count once."""
    return [(i, t, w) for i, t in sorted({x for x in items if x[0] is not None and x[1] is not None}) if (w := words(t))]


def counts(kept: list[Item]) -> tuple[int, float, Counter]:
    """Number of items, their mean length, and the number of items that hold each word."""
    return len(kept), sum(len(w) for _, _, w in kept) / max(1, len(kept)), Counter(t for _, _, w in kept for t in set(w))


class Index:
    """Postings of (item_id, text) rows; ``corpus`` has the counts that words are weighted by, if not these rows'."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK, corpus: tuple[int, float, Counter] | None = None):
        kept = usable(items)
        n_items, mean, df = corpus or counts(kept)
        self.block = block
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(shingles(words(x)) for x in question_and_answer(t)) for _, t, _ in kept]
        self.short = [tuple(len(words(x)) for x in question_and_answer(t)) for _, t, _ in kept]
        self.longest = max((len(w) for _, _, w in kept), default=0)
        own_words = sorted({t for _, _, w in kept for t in w})
        self.vocabulary = {t: n for n, t in enumerate(own_words)}
        self.items: list[list[int]] = [[] for _ in own_words]
        self.impacts: list[list[float]] = [[] for _ in own_words]
        for at, (_, _, w) in enumerate(kept):
            weight = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in Counter(w).items()}
            own = sum(weight.values())
            for t, x in weight.items():
                self.items[self.vocabulary[t]].append(at)
                self.impacts[self.vocabulary[t]].append(x / own)
        self.block_max = [[max(x[i : i + block]) for i in range(0, len(x), block)] for x in self.impacts]
        self.bound = np.array([max(x) for x in self.impacts] or [0.0])
        size = max(ITEM_BLOCK, math.ceil(len(kept) / ITEM_BLOCKS))
        self.by_block = np.zeros((len(own_words), math.ceil(len(kept) / size)), np.float32)
        for t, (items_, impacts) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.by_block[t], np.array(items_) // size, np.array(impacts, np.float32))

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(position of the item, score) of all items whose score reaches ``threshold``, by block-max WAND."""
        least, end = threshold - 1e-9, len(self.ids)
        live = [[self.items[t][0], 0, t] for t in terms]
        found = []
        while live:
            live.sort()
            total, last = 0.0, -1
            for k, (_, _, t) in enumerate(live):
                total += self.bound[t]
                if total >= least:
                    last = k
                    break
            if last < 0:
                break
            pivot = live[last][0]
            while last + 1 < len(live) and live[last + 1][0] == pivot:
                last += 1
            near, stop = 0.0, live[last + 1][0] if last + 1 < len(live) else end
            for _, p, t in live[: last + 1]:
                q = bisect_left(self.items[t], pivot, p)
                if q < len(self.items[t]):
                    near += self.block_max[t][q // self.block]
                    edge = (q // self.block + 1) * self.block
                    stop = min(stop, self.items[t][edge - 1] + 1 if edge <= len(self.items[t]) else end)
            if near < least:  # no item up to the nearest block's end can reach it
                goal = max(stop, pivot + 1)
            elif live[0][0] == pivot:
                score = sum(self.impacts[t][p] for i, p, t in live[: last + 1])
                if score >= least:
                    found.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for x in live[: last + 1]:
                if x[0] < goal:
                    x[1] = bisect_left(self.items[x[2]], goal, x[1])
                    x[0] = self.items[x[2]][x[1]] if x[1] < len(self.items[x[2]]) else end
            live = [x for x in live if x[0] < end]
        return found

    def leaks(self, text: str | bytes | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """For each item that the text holds: score, question overlap and answer overlap of its best passage."""
        out: dict[int, tuple[float, float, float]] = {}
        w = words(text)
        self.search(w, np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w)), threshold, overlap, out)
        return out

    def search(self, w: list[bytes], ids: np.ndarray, threshold: float, overlap: float, out: dict[int, tuple[float, float, float]]) -> None:
        """``leaks`` of words whose numbers in the vocabulary are known, -1 for others, put into ``out``."""
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return
        stride = max(self.longest, 32)
        count = max(1, math.ceil((len(w) - stride) / stride))
        # A word lies in the passage that begins in its stride and in the one before.
        second, n_terms = known // stride, len(self.vocabulary)
        key = np.concatenate((second * n_terms, (second - 1) * n_terms)) + np.tile(ids[known], 2)
        key = key[(key >= 0) & (key < count * n_terms)]
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        passage = key // n_terms
        terms = key - passage * n_terms
        cuts = np.searchsorted(passage, np.arange(0, count, 1024))  # a long text's passages, some at a time
        for lo, hi in zip(cuts, np.append(cuts[1:], len(key))):
            if lo < hi:
                self._query(w, passage[lo:hi], terms[lo:hi], stride, threshold, overlap, out)

    def _query(self, w, passage, terms, stride, threshold, overlap, out) -> None:
        starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        reach = np.add.reduceat(self.by_block[terms], starts, axis=0).max(axis=1)
        ends = np.append(starts[1:], len(terms))
        for k in np.flatnonzero(reach >= threshold - 1e-4):
            hits = self.retrieve(terms[starts[k] : ends[k]].tolist(), threshold)
            if not hits:
                continue
            at = int(passage[starts[k]]) * stride
            own = w[at : at + 2 * stride]
            held = shingles(own)
            for item, score in hits:
                q, a = (self._overlap(part, n, held, own) for part, n in zip(self.parts[item], self.short[item]))
                if q >= overlap and a >= overlap and (score, q, a) > out.get(self.ids[item], (0.0, 0.0, 0.0)):
                    out[self.ids[item]] = (float(score), q, a)

    @staticmethod
    def _overlap(part: set, n: int, held: set, passage: list[str]) -> float:
        """Share of the part's shingles among the passage's; a part of fewer words than a shingle must occur whole."""
        if not part:
            return 1.0
        if n < SHINGLE:
            (own,) = part
            return float(any(tuple(passage[i : i + n]) == own for i in range(len(passage) - n + 1)))
        return len(part & held) / len(part)


class Indexes:
    """Of items, an index for each class of like lengths; words are weighted by the counts of all."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK):
        kept = usable(items)
        corpus = counts(kept)
        self.vocabulary = {t: n for n, t in enumerate(sorted(corpus[2]))}
        classes: dict[int, list[tuple[int, str]]] = {}
        for i, t, w in kept:
            classes.setdefault((max(len(w), 32) - 1).bit_length(), []).append((i, t))
        self.parts = [(Index(own, block, corpus)) for _, own in sorted(classes.items())]
        self.numbers = [np.full(len(self.vocabulary) + 1, -1, np.int64) for _ in self.parts]  # the last is that of unknown words
        for part, numbers in zip(self.parts, self.numbers):
            numbers[[self.vocabulary[t] for t in part.vocabulary]] = np.arange(len(part.vocabulary))

    def leaks(self, text: str | bytes | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """For each item that the text holds: score, question overlap and answer overlap of its best passage."""
        out: dict[int, tuple[float, float, float]] = {}
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))
        if (ids >= 0).any():
            for part, numbers in zip(self.parts, self.numbers):
                part.search(w, numbers[ids], threshold, overlap, out)
        return out


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", index_chars: int = INDEX_CHARS) -> list[Indexes]:
    """One set of indexes, or as many as hold ``index_chars`` characters of items each."""
    src = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    chars = src.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / index_chars))
    return [Indexes([(r["i"], r["t"]) for r in src.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]) for k in range(n)]


def find_leaks(docs: DataFrame, indexes: list[Indexes], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of each document and item that it holds.

    Null, empty and wordless texts hold none, as do null or wordless items; repeated rows
    give repeated results; very long texts are queried whole, a thousand passages at a time;
    an empty table on either side gives an empty result; other columns do not matter.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    out = None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value

            def rows():
                for b in batches:
                    for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                        for item, x in own.leaks(t.as_py(), threshold, overlap).items():
                            yield k, item, *x

            return as_batches(schema, rows())

        one = src.mapInArrow(run, "key long, item_id long, score double, question_overlap double, answer_overlap double")
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, indexes: list[Indexes], text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; in one pass, all columns as they are, whatever their names."""
    spark = docs.sparkSession
    n = len(docs.columns)
    (t,) = fresh(docs, "dc_text")
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                clean = pa.array([not own.leaks(x.as_py(), threshold, overlap) for x in b.column(n)], pa.bool_())
                kept = b.filter(clean)
                yield pa.RecordBatch.from_arrays(kept.columns[:n], names=b.schema.names[:n])

        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
        docs = docs.withColumn(t, utf8(text)).mapInArrow(run, schema)
    return docs
