"""Byte-level dedup by sorted suffixes: deep-shallow sorting around sampled places.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Sorting
every suffix of a corpus would move many times its size, so suffixes are sampled where it
cannot matter: in every ``length``-byte string the ``GRAM``-byte gram with the lowest hash
(the first of equals) is an anchor. Equal strings have equal anchors at equal places, so
only suffixes that begin at equal anchors need comparing, with what stands before them.

1. Each anchor gives a hash of its gram and one of its context (all strings it is the
   anchor of). A worker resolves equal contexts among about a million anchors at once, so
   a passage in very many documents leaves it once; the others are dealt out by gram.
   Anchors whose context occurs again lose all their strings, which settles the inside of
   every repeated passage; anchors whose gram occurs once lose none.
2. For the rest, at the ends of passages, the contexts themselves are dealt out by gram,
   one for each distinct context. Their suffixes after the anchor, and the reversed text
   before it, are put in order by deep-shallow sorting: multikey quicksort on 8-byte
   characters to ``SHALLOW`` bytes, then a blind trie for each group that is still equal.
   Two strings are equal if the anchors' suffixes and prefixes agree far enough, which the
   longest common prefixes in both orders tell for every offset at once.
3. A gram with more contexts than ``CHUNK`` is not sorted in one task. Its contexts are
   halved by offsets: of a range of offsets, all strings occur again if the text they cover
   together does, and none does if the text they have in common does not. Both are counted
   by a 128-bit hash, and only what neither settles is halved again, so a context leaves a
   few rows around the ends of passages and a very common text is one partial sum in each task.

Contexts that occur again as a whole are told by 112 bits of hashes, of gram and context. A
bucket of grams that holds more than ``CROWD`` anchors, since one gram has very many contexts,
is not gathered in a task: plain aggregates by (gram, context) and by gram settle it.

Rows are numbered and written once, so repeated and null ids are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_batches, discard, materialise, utf8
from .substring_dedup import _join, _pack_ids, _split, _squeeze, _unsqueeze

LENGTH = 200
GRAM = 32
SHALLOW = 48
CHUNK = 4096
FLUSH = 500_000
#: Parts that anchors are dealt out to directly.
FAN = 1024
#: Contexts from which a worker sorts what it holds.
HELD = 30_000
#: Anchors in a bucket that a task settles; an even bucket has about a million.
CROWD = 8_000_000
BUCKET_BYTES = 96_000_000
#: Bytes of a document that are searched for anchors at once.
_PART = 1 << 20

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _M[0]
    h ^= h >> np.uint64(29)
    step, base = 1, int(_M[1])
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = (base * base + 2) % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(31)
    h *= _M[2]
    h ^= h >> np.uint64(29)
    return h


def anchors(body: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the anchors of all ``length``-byte strings of ``body``."""
    span = length - GRAM + 1
    places, hashes = [], []
    for at in range(0, max(0, len(body) - length) + 1, _PART):
        part = np.frombuffer(body, np.uint8, min(_PART + length - 1, len(body) - at), at)
        if len(part) < length:
            break
        h = _gram_hashes(part)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        p = np.unique((low & _LOW).astype(np.int64))
        places.append(p + at)
        hashes.append(h[p])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def context(body: bytes, at: int, length: int = LENGTH) -> tuple[int, bytes]:
    """Bytes before the anchor, and the text of all strings that the gram at ``at`` lies in."""
    lo = max(0, at - (length - GRAM))
    return at - lo, body[lo : at + length]


class _Trie:
    """A blind trie of byte strings with a common prefix: branches hold a depth and the character there."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # leaf: [None, members]; branch: [depth, {character: child}]

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node, path = self.root, []
        while node[0] is not None:  # blind descent: any child does where the character is missing
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            node[1].append(i)
            return
        up, node = None, self.root  # the place of a branch at depth n
        while node[0] is not None and node[0] < n:
            up, node = node, node[1][s[node[0]]]
        c, d = (s[n] if n < len(s) else -1), (other[n] if n < len(other) else -1)
        if node[0] == n:
            node[1][c] = [None, [i]]
            return
        branch = [n, {c: [None, [i]], d: node}]
        if up is None:
            self.root = branch
        else:
            up[1][s[up[0]]] = branch

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; the first has -1."""
        stack = [(self.root, -1)]
        while stack:
            node, lcp = stack.pop()
            if node[0] is None:
                full = len(self.strings[node[1][0]])
                for k, i in enumerate(node[1]):
                    yield i, full if k else lcp
                continue
            kids = sorted(node[1].items())
            for k in range(len(kids) - 1, -1, -1):
                stack.append((kids[k][1], node[0] if k else lcp))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the strings in order, and each one's common prefix with the one before it in that order."""
    n = len(strings)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = -(-shallow // 8)
    flat = b"".join(s[: words * 8].ljust(words * 8, b"\0") for s in strings)
    key = np.frombuffer(flat, ">u8").reshape(n, words).astype(np.uint64)
    size = np.fromiter(map(len, strings), np.int64, n)
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the strings in order: where their group begins
    lcp = np.full(n, -1, np.int64)
    live = np.arange(n)  # places in order that are in groups of two or more
    for k in range(words):
        if not len(live):
            break
        own, g = order[live], group[live]
        # A string that ends within this word comes before one that goes on with zero bytes.
        w, end = key[own, k], np.minimum(size[own] - 8 * k, 8)
        at = np.lexsort((end, w, g))
        own, g, w, end = own[at], g[at], w[at], end[at]
        order[live] = own
        same = (g[1:] == g[:-1]) & (w[1:] == w[:-1]) & (end[1:] == end[:-1])
        cut = np.flatnonzero((g[1:] == g[:-1]) & ~same) + 1
        if len(cut):
            x = w[cut] ^ w[cut - 1]
            same_bytes = np.where(x == 0, 8, _leading_bytes(x))
            lcp[live[cut]] = 8 * k + np.minimum(same_bytes, np.minimum(end[cut], end[cut - 1]))
        head = np.concatenate(([True], ~same))
        group[live] = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
        keep = np.zeros(len(live), bool)
        keep[1:] |= same
        keep[:-1] |= same
        live = live[keep]
    for lo, hi in _runs(group, live):
        trie = _Trie(strings)
        for i in order[lo:hi]:
            trie.insert(int(i))
        for at, (i, common) in enumerate(trie.walk(), lo):
            order[at] = i
            if common >= 0:
                lcp[at] = common
    lcp[0] = 0
    return order, np.maximum(lcp, 0)


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Equal bytes before the first difference, of exclusive-ors of big-endian words that are not 0."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out


def _runs(group: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(live):
        g = group[live]
        at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        for a, b in zip(at, np.append(at[1:], len(live))):
            yield int(live[a]), int(live[b - 1]) + 1


def repeated_offsets(before: list[bytes], after: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For contexts (reversed text before the anchor, text from it on): rows x offsets, where a string that
    begins that many bytes before its anchor equals one at the same offset of another row."""
    n = len(before)
    out = np.zeros((n, length - GRAM + 1), bool)
    (lo, ll), (ro, rl) = deep_shallow_sort(before), deep_shallow_sort(after)
    left, right = np.fromiter(map(len, before), np.int64, n), np.fromiter(map(len, after), np.int64, n)
    lc, rc = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(length - GRAM + 1):
        ok = np.flatnonzero((left >= t) & (right >= length - t))
        if len(ok) < 2:
            continue
        rc[ro] = np.cumsum(rl < length - t)
        lc[lo] = np.cumsum(ll < t)
        both = rc[ok] * (n + 1) + lc[ok]
        order = np.argsort(both, kind="stable")
        b = both[order]
        same = b[1:] == b[:-1]
        hit = np.zeros(len(ok), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[ok[order[hit]], t] = True
    return out


_DEALT = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), ("data", pa.binary()), ("n", pa.int64())])
_MARKS = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("state", pa.int8()), ("gram", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32())])
_MARKS_DDL = "rid long, at long, state byte, gram long, chunk int, chunks int"
#: State of an anchor: all its strings occur again; its context is to be compared; both.
_ALL, _OPEN, _SHOW = 1, 2, 3


def _blobs(rid: np.ndarray, at: np.ndarray, gram: np.ndarray, ctx: np.ndarray, many: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(place, packed anchors, their number) for each place in ``to``."""
    order = np.lexsort((at, rid, ctx, gram, to))
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for own in np.split(order, cuts):
        ids, i = _pack_ids(rid[own])
        steps = np.diff(gram[own].astype(np.int64), prepend=np.int64(0))
        yield int(to[own[0]]), _join(_squeeze(ids), _squeeze(steps, ctx[own].astype(np.int64), i, at[own], many[own].astype(np.int64))), len(own)


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    """(gram, ctx, rid, at, many) of packed anchors."""
    ids, body = _split(data)
    steps, ctx, i, at, many = _unsqueeze(body, 5)
    return np.cumsum(steps), ctx, np.cumsum(_unsqueeze(ids, 1)[0])[i], at, many


def ways_of(buckets: int) -> int:
    """Parts that a task's anchors go to at first: all buckets, or the root of very many, which a second hop deals out.

    So a task's flush makes that many blobs at most, and blobs grow with the power 1.5 of the input, not with its square.
    """
    return min(buckets, max(FAN, math.isqrt(buckets)))


def _marks(src: DataFrame, length: int, buckets: int) -> DataFrame:
    """A row for each anchor that loses its strings or whose context is to be compared."""
    ways = ways_of(buckets)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush():
            rid, at, gram, ctx = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((at, rid, ctx, gram))
            rid, at, gram, ctx = rid[order], at[order], gram[order], ctx[order]
            first = np.ones(len(rid), bool)
            first[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
            many = ~first
            many[:-1] |= ~first[1:]
            ids, i = _pack_ids(rid[many & ~first]) if (many & ~first).any() else (None, None)
            if ids is not None:  # settled here; they pass through the next step as they are
                yield 0, True, _join(_squeeze(ids), _squeeze(i, at[many & ~first])), 0
            rid, at, gram, ctx, many = rid[first], at[first], gram[first], ctx[first], many[first]
            to = (gram % np.uint64(buckets)).astype(np.int64)
            for b, blob, size in _blobs(rid, at, gram, ctx, many, to % ways):
                yield b, False, blob, size

        def rows():
            nonlocal held, n
            for b in batches:
                for rid, body in zip(b.column(0).to_pylist(), b.column(1)):
                    body = body.as_py()
                    at, gram = anchors(body, length)
                    if not len(at):
                        continue
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(x, k) >> 8 for k, x in (context(body, p, length) for p in at.tolist())), np.uint64, len(at))
                    held.append((np.full(len(at), rid), at, gram >> np.uint64(8), ctx))
                    n += len(at)
                    if n >= FLUSH:
                        yield from flush()
                        held, n = [], 0
            if held:
                yield from flush()

        return as_batches(_DEALT, rows(), 16)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rid, at, state, gram=None, chunk=None, chunks=None):
            z = np.zeros(len(rid), np.int64)
            cols = [rid, at, np.full(len(rid), state) if np.isscalar(state) else state, z if gram is None else gram, z if chunk is None else chunk, z if chunks is None else chunks]
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _MARKS)], schema=_MARKS)

        def resolve(parts):
            gram, ctx, rid, at, many = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, rid, ctx, gram))
            gram, ctx, rid, at, many = gram[order], ctx[order], rid[order], at[order], many[order].astype(bool)
            n = len(gram)
            first = np.ones(n, bool)
            first[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
            several = ~first | many
            several[:-1] |= ~first[1:]
            head = np.ones(n, bool)
            head[1:] = gram[1:] != gram[:-1]
            number = np.cumsum(head) - 1
            contexts = np.bincount(number, weights=first).astype(np.int64)
            lone = np.bincount(number, weights=first & ~several).astype(np.int64)
            # Contexts are compared where a gram has several, one of them lone.
            compare = (contexts[number] > 1) & (lone[number] > 0) & first
            state = np.where(compare, np.where(several, _SHOW, _OPEN), _ALL)
            rank = np.cumsum(compare) - 1
            begin = np.concatenate(([0], np.cumsum(np.bincount(number, weights=compare).astype(np.int64))))[number]
            keep = compare | several
            chunk = np.where(compare, (rank - begin) // CHUNK, 0)
            chunks = -(-contexts[number] // CHUNK)
            yield batch(rid[keep], at[keep], state[keep], gram[keep], chunk[keep], chunks[keep])

        now, parts = None, []
        for b in batches:
            for bucket, done, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if done:
                    ids, body = _split(data)
                    i, at = _unsqueeze(body, 2)
                    yield batch(np.cumsum(_unsqueeze(ids, 1)[0])[i], at, _ALL)
                    continue
                if bucket != now:
                    if parts:
                        yield from resolve(parts)
                    now, parts = bucket, []
                parts.append(_unblob(data))
        if parts:
            yield from resolve(parts)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, n = [], 0

            def flush():
                gram, ctx, rid, at, many = (np.concatenate(x) for x in zip(*held))
                for b, blob, size in _blobs(rid, at, gram, ctx, many, gram % buckets):
                    yield b, False, blob, size

            for batch in batches:
                for bucket, done, data, size in zip(*(c.to_pylist() for c in batch.columns)):
                    if done:
                        yield bucket, done, data, size
                        continue
                    held.append(_unblob(data))
                    n += size
                    if n >= FLUSH:
                        yield from flush()
                        held, n = [], 0
            if held:
                yield from flush()

        return as_batches(_DEALT, rows(), 16)

    ddl = "bucket int, done boolean, data binary, n long"
    dealt = src.mapInArrow(sample, ddl)
    if ways < buckets:
        dealt = dealt.where("not done").repartition(ways, "bucket").mapInArrow(regroup, ddl).unionByName(dealt.where("done"))
    dealt = dealt.withColumn("bucket", F.when(F.col("done"), F.pmod(F.xxhash64("data"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    dealt = materialise(dealt, "dealt")
    # One row for each crowded bucket: fewer than anchors / CROWD.
    crowded = F.broadcast(dealt.where("n > 0").groupBy(F.col("bucket").alias("full")).agg(F.sum("n").alias("anchors")).where(F.col("anchors") > CROWD).select("full"))
    usual = dealt.join(crowded, (F.col("bucket") == F.col("full")) & ~F.col("done"), "left_anti").select("bucket", "done", "data")
    out = usual.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, _MARKS_DDL)
    if crowded.limit(1).count():
        out = out.unionByName(_settle_crowds(dealt.join(crowded, (F.col("bucket") == F.col("full")) & ~F.col("done"), "left_semi").select("data")))
    return out


def _settle_crowds(blobs: DataFrame) -> DataFrame:
    """The marks of ``_marks`` for any number of anchors of one gram, by aggregates whose partial results are made where rows are read."""
    schema = pa.schema([("gram", pa.int64()), ("ctx", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("many", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unblob(data.as_py())], schema=schema)

    anchors_ = blobs.mapInArrow(unpack, "gram long, ctx long, rid long, at long, many long")
    contexts = materialise(anchors_.groupBy("gram", "ctx").agg(((F.count("*") > 1) | (F.max("many") > 0)).alias("several"), F.min(F.struct("rid", "at")).alias("first")), "contexts")
    grams = contexts.groupBy(F.col("gram").alias("of")).agg(F.count("*").alias("contexts"), F.count(F.when(~F.col("several"), 1)).alias("lone"))
    compared = contexts.join(grams.where("contexts > 1 and lone > 0"), F.col("gram") == F.col("of"))
    chunks = F.ceil(F.col("contexts") / CHUNK).cast("int")
    shown = compared.select("first.rid", "first.at", F.when(F.col("several"), _SHOW).otherwise(_OPEN).cast("byte").alias("state"), "gram", F.pmod(F.xxhash64("ctx"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))
    repeated = contexts.where("several").select(F.col("gram").alias("g"), F.col("ctx").alias("c"))
    whole = anchors_.join(repeated, (F.col("gram") == F.col("g")) & (F.col("ctx") == F.col("c")), "left_semi").select("rid", "at", F.lit(_ALL).cast("byte").alias("state"), F.lit(0).cast("long").alias("gram"), F.lit(0).alias("chunk"), F.lit(0).alias("chunks"))
    return shown.unionByName(whole)


_FOUND = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("gram", pa.int64()), ("context", pa.binary())])


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """(rid, at, low, high, gram, context): offsets of strings that occur again; where ``low`` is null a context of a
    gram that has more than a task sorts, with the bytes before its anchor as ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows):
            hits = repeated_offsets([r[6][: r[5]][::-1] for r in rows], [r[6][r[5] :] for r in rows], length)
            edges = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, lo = np.nonzero(edges == 1)
            _, hi = np.nonzero(edges == -1)
            for k, a, b in zip(i.tolist(), lo.tolist(), hi.tolist()):
                yield rows[k][3], rows[k][4], a, b - 1, None, None

        def rows():
            held = []
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if r[2] > 1:
                        yield r[3], r[4], None, r[5], r[0], r[6]
                        continue
                    if len(held) >= HELD and r[0] != held[-1][0]:  # only whole groups are sorted together
                        yield from work(held)
                        held = []
                    held.append(r)
            if held:
                yield from work(held)

        return as_batches(_FOUND, rows())

    return contexts.repartition("gram", "chunk").sortWithinPartitions("gram", "chunk").mapInArrow(run, "rid long, at long, low int, high int, gram long, context binary")


def _halve(hot: DataFrame, length: int) -> DataFrame | None:
    """(rid, at, low, high): ranges of offsets at which all strings occur again, of (rid, at, gram, before, context); None if there are no rows.

    Of contexts that a range settles together one goes on, for others that hold only some of its strings.
    """
    left = hot.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - GRAM)).withColumn("open", F.lit(True))
    out = None
    while left.limit(1).count():
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.filter(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi"))), lambda x: x["lo"] <= x["hi"])
        cut = left.withColumn("half", F.explode(halves)).select("rid", "at", "gram", "before", "context", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "open")
        after = F.length("context") - F.col("before")
        # The range holds a string of this context, and it holds all of them.
        some = F.greatest(F.col("lo"), F.lit(length) - after) <= F.least(F.col("hi"), F.col("before"))
        all_ = (F.col("before") >= F.col("hi")) & (after >= F.lit(length) - F.col("lo"))
        cut = cut.where(some).withColumn("common", F.md5(F.substring(F.col("context"), F.col("before") - F.col("lo") + 1, F.lit(length) - F.col("hi") + F.col("lo"))))
        cut = materialise(cut.withColumn("whole", F.when(all_, F.md5(F.substring(F.col("context"), F.col("before") - F.col("hi") + 1, F.lit(length) + F.col("hi") - F.col("lo"))))), "halves")
        wholes = cut.where("whole is not null").groupBy(F.col("gram").alias("g"), F.col("lo").alias("l"), F.col("whole").alias("w")).agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("first")).where("n > 1")
        told = cut.join(wholes, (F.col("gram") == F.col("g")) & (F.col("lo") == F.col("l")) & (F.col("whole") == F.col("w")), "left")
        told = materialise(told.select(*cut.columns, F.col("n").isNotNull().alias("settled"), (F.struct("rid", "at") == F.col("first")).alias("one")), "told")
        settled = told.where("settled and open").select("rid", "at", F.col("lo").alias("low"), F.col("hi").alias("high"))
        out = settled if out is None else out.unionByName(settled)
        on = told.where("lo < hi and (not settled or one)").withColumn("open", F.col("open") & ~F.col("settled"))
        commons = on.groupBy(F.col("gram").alias("g"), F.col("lo").alias("l"), F.col("common").alias("c")).agg(F.count("*").alias("n"), F.max("open").alias("some")).where("n > 1 and some").select("g", "l", "c")
        left = materialise(on.join(commons, (F.col("gram") == F.col("g")) & (F.col("lo") == F.col("l")) & (F.col("common") == F.col("c")), "left_semi").select("rid", "at", "gram", "before", "context", "lo", "hi", "open"), "open")
        discard(cut)
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_bytes: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), with ``keep_bytes`` also the bytes that stay.

    A row for each input row. Null texts are empty; texts shorter than ``length`` lose
    nothing, very long ones are searched a megabyte at a time; repeated rows are each other's
    repeats, whatever their ids, and null ids are ids like any other; an empty table gives an
    empty result; other columns do not matter. ``length`` is at least twice GRAM.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    src = materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), utf8(text).alias("body")), "rows")
    total = src.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    marks = materialise(_marks(src.select("rid", "body"), length, buckets), "anchors")
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = src.repartition(parts, "rid")

    shown = marks.where(F.col("state") != _ALL).groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("at", "gram", "chunk", "chunks")).alias("wanted"))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("rid", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("context", pa.binary())])

        def rows():
            for b in batches:
                for rid, body, wants in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    body = body.as_py()
                    for w in wants.as_py():
                        yield w["gram"], w["chunk"], w["chunks"], rid, w["at"], *context(body, w["at"], length)

        return as_batches(schema, rows())

    contexts = placed.join(shown, F.col("rid") == F.col("of")).select("rid", "body", "wanted").mapInArrow(show, "gram long, chunk int, chunks int, rid long, at long, before int, context binary")
    found = materialise(_compare(contexts, length), "offsets")
    hits = found.where("low is not null").select("rid", "at", "low", "high")
    late = _halve(found.where("low is null").select("rid", "at", "gram", F.col("high").alias("before"), "context"), length)
    hits = hits if late is None else hits.unionByName(late)
    whole = marks.where(F.col("state") != _OPEN).select("rid", "at", F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"))
    lists = whole.unionByName(hits).groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("at", "low", "high")).alias("gone"))
    joined = src.repartition(parts, "rid").join(lists, F.col("rid") == F.col("of"), "left").select("key", "body", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_bytes else [])])

        def rows():
            for b in batches:
                gone = b.column(2)
                for k, body, own in zip(b.column(0).to_pylist(), b.column(1), gone):
                    body, spans = body.as_py(), []
                    if own.is_valid:
                        x = own.values.flatten()
                        at, low, high = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in x)
                        begin, last = np.maximum(at - high, 0), np.minimum(at - low, len(body) - length)
                        some = begin <= last
                        order = np.argsort(begin[some], kind="stable")
                        for a, z in zip(begin[some][order].tolist(), (last[some][order] + length).tolist()):
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], z)
                            else:
                                spans.append([a, z])
                    kept, done = [], 0
                    for a, z in spans:
                        kept.append(body[done:a])
                        done = z
                    rest = b"".join((*kept, body[done:]))
                    yield (k, len(body), len(body) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *([rest] if keep_bytes else []))

        return as_batches(names, rows(), 1024)

    return joined.mapInArrow(finish, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else ""))
