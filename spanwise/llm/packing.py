"""Best-fit packing of tokenised documents into sequences, with vector capacities.

A sequence has three capacities: tokens, documents and attention cost (the sum of the
squared lengths of its pieces). Pieces come longest first; of the open sequences that a
piece fits under every capacity it goes to the one that it leaves the smallest weighted
norm of the residual vector, or to that with the largest weighted dot product of the
piece's demand and the residual. By default the norm, weighted so that tokens decide and
the others break ties, and capacities for documents and attention that cannot bind, as the
aim is the fewest sequences.

Documents are tokenised once, where they are read; only (id, piece, start, length, crc)
rows go on, through a written table. A piece that fills a sequence needs no packing. The
others are dealt out evenly, without a key, into parts of about ``PART`` pieces; a task
packs at most ``CHUNK`` pieces at a time, so neither a long document nor a large input
makes a task large. Each chunk leaves at most a few sequences partly empty.
"""

from __future__ import annotations

import base64
import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_batches, materialise

SEQUENCE_TOKENS = 2048
#: Neither binds: a piece has one token at least, and squares of parts sum to no more than the whole's.
MAX_DOCUMENTS = 2048
MAX_ATTENTION = SEQUENCE_TOKENS**2
WEIGHTS = (1.0, 1e-6, 1e-6)
SEPARATOR = 0
PART = 65536
CHUNK = 16384
#: Words whose ids a worker remembers; it keeps them for as long as it lives, some 280 bytes each.
CACHED_WORDS = 100_000

#: Characters that both regular expression libraries put in the same classes.
OTHER_CHARACTERS = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ſ–—‘’“”…]").search
PLAIN_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+").findall


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit numbers.

    The ids are those of the ``tokenizers`` file at ``path``. If ``ranks`` names the same
    vocabulary as byte ranks, words of plain texts are looked up in a cache and merged by
    it on a miss, which gives the same ids several times faster; texts with any other
    character, or with an added token of the file, always go to the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    # Strings of the file's added tokens are one id each; only the tokenizer itself looks for them.
    added = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values() if t.content) or r"(?!)")

    def slow(text: str) -> bytes:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if ranks is None:
        return slow
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    merge = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={})._core_bpe.encode_single_piece

    def pack_ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            ids = pack_ids(merge(word.encode()))
            if len(self) < CACHED_WORDS:
                self[word] = ids
            return ids

    known = Words()

    def fast(text: str) -> bytes:
        if OTHER_CHARACTERS(text) or added.search(text):
            return slow(text)
        return b"".join(map(known.__getitem__, PLAIN_PIECES(text)))

    return fast


def pieces_of(ids: bytes, capacity: int = SEQUENCE_TOKENS) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's ids; a longer one is cut into full pieces, its first piece the remainder."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    start, piece = 0, 0
    while start < n:
        length = first if piece == 0 else capacity
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length
        piece += 1


def best_fit(lengths: np.ndarray, tokens: int = SEQUENCE_TOKENS, documents: int = MAX_DOCUMENTS, attention: float = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which must come in descending order and fit an empty bin alone.

    Ties go to the bin opened first.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    caps = np.array([tokens, documents, attention], float)
    w = np.array(weights, float)
    rest = np.empty((3, n + 1))
    names = np.empty(n + 1, np.int64)
    opened = live = 0
    smallest = float(lengths[-1]) if n else 0.0
    for k, length in enumerate(map(float, lengths)):
        need = np.array([length, 1.0, length * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length:.0f} tokens exceeds an empty sequence")
        if k % 1024 == 1023:  # sequences that take none of the rest
            keep = np.flatnonzero((rest[0, :live] >= smallest) & (rest[1, :live] >= 1) & (rest[2, :live] >= smallest * smallest))
            rest[:, : len(keep)], names[: len(keep)], live = rest[:, keep], names[keep], len(keep)
        fits = np.flatnonzero((rest[0, :live] >= need[0]) & (rest[1, :live] >= need[1]) & (rest[2, :live] >= need[2]))
        if len(fits):
            left = rest[:, fits]
            if rule == "norm":
                score = (((left - need[:, None]) / caps[:, None]) ** 2 * w[:, None]).sum(axis=0)
                at = fits[score.argmin()]
            else:
                score = (left * (need * w / caps**2)[:, None]).sum(axis=0)
                at = fits[score.argmax()]
        else:
            at = live
            rest[:, at], names[at] = caps, opened
            live += 1
            opened += 1
        bins[k], offsets[k] = names[at], tokens - rest[0, at]
        rest[:, at] -= need
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", tokens: int = SEQUENCE_TOKENS, documents: int = MAX_DOCUMENTS, attention: float = MAX_ATTENTION, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document.

    A document's ids are its text's and then SEPARATOR; null and empty texts have that
    alone; very long texts are tokenised whole and cut into many pieces. Repeated rows are
    packed each; null keys stay; an empty table gives an empty result; other columns do not
    matter, whatever their names. ``tokenizer`` and ``ranks`` are paths of vocabulary files on every machine.
    """
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    cut = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([SEPARATOR], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        return as_batches(cut, ((k, *p) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1)) for p in pieces_of(encode(t.as_py() or "") + end, tokens)))

    ddl = "key long, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(src.mapInArrow(tokenise, ddl), "pieces")
    small = pieces.where(F.col("length") < tokens)
    parts = max(1, math.ceil(small.count() / PART))
    placed = pa.schema([*cut, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held, n = [], 0

        def flush():
            nonlocal first
            t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            bins, offsets = best_fit(t.column("length").to_numpy(), tokens, documents, attention, weights, rule)
            out = t.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets)).cast(placed)
            first += int(bins.max()) + 1
            yield from out.to_batches()

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                if n + part.num_rows > CHUNK:
                    yield from flush()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from flush()

    # Dealt out without a key: Spark sorts before it does so, which keeps a repeated task's rows the same.
    packed = small.repartition(parts).mapInArrow(fill, ddl + ", sequence_id long, offset long")
    full = pieces.where(F.col("length") >= tokens).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
