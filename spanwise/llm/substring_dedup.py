"""Substring dedup by suffix automata of reference passages and matching statistics.

A window of ``window`` words goes if its words also start in a document with a smaller id.
Automata of whole shards cannot be broadcast (a shard of a corpus is larger than any
worker, and each document would stream through all of them), so the reference is first cut
down to the passages that matter, and every document gets the automaton of its own:

1. Every window of every document is hashed to 64 bits. A worker resolves equal hashes of
   about two million windows at once, so a passage in very many documents leaves it once;
   the rest is dealt out by hash, compressed, and equal hashes meet there. Either way a
   window learns of one document with a smaller id, and of the place in it.
2. Windows that follow each other in both documents join to segments.
3. The segments' words are taken from the documents they refer to: the reference passages.
4. Each document streams through the suffix automaton of its passages; its matching
   statistics give the maximal spans of ``window`` words or more that go. Words are
   compared here, so a collision of hashes removes nothing.
5. A window that its automaton refutes has the hash of other words, and may still repeat
   one in a third document. Such hashes, and those of unequal windows of one document, are
   looked at again: their windows are taken from all documents and compared by their words.
   With 64 bits this is a rare event; the result does not depend on it.

Documents are shuffled once, by id, for steps 3 and 4; numbers of buckets follow the size
of the text, which bounds each task. Beyond ``FAN`` buckets hashes are dealt out in two
hops, so that the number of compressed parts stays in proportion to the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_batches, materialise, utf8

WINDOW = 13
HASH_BITS = 64
#: Windows that a worker resolves at once.
FLUSH = 2_000_000
#: Bytes of text for a bucket of hashes; a word is about six.
BUCKET_BYTES = 12_000_000
#: Buckets that a worker deals out to at once.
FAN = 1024
#: Hashes that are looked at again in one pass over the documents.
AGAIN = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAYLOAD = pa.schema([("bucket", pa.int32()), ("resolved", pa.bool_()), ("data", pa.binary())])


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """A hash of each run of ``window`` words, in HASH_BITS bits."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = out * _BASE + h[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(64 - HASH_BITS)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length, each cut to the bytes that its values need, byte by byte, compressed."""
    n = len(columns[0])
    head, planes = [n], []
    for c in columns:
        b = np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(n, 8)
        width = max((k + 1 for k in range(8) if b[:, k].any()), default=1)
        head.append(width)
        planes += [b[:, k].tobytes() for k in range(width)]
    return zstandard.ZstdCompressor(1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def _unsqueeze(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    head = raw[: 8 * (columns + 1)].view(np.int64)
    n, at, out = int(head[0]), 8 * (columns + 1), []
    for width in head[1:].tolist():
        b = np.zeros((n, 8), np.uint8)
        for k in range(width):
            b[:, k] = raw[at : at + n]
            at += n
        out.append(b.view(np.int64).reshape(n))
    return out


def _pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids as differences, and the position of each among them."""
    distinct, at = np.unique(ids, return_inverse=True)
    return np.diff(distinct, prepend=np.int64(0)), at


def _cuts(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each bucket's rows."""
    order = np.argsort(to, kind="stable")
    names, at = np.unique(to[order], return_index=True)
    for b, own in zip(names.tolist(), np.split(order, at[1:])):
        yield b, own


def _resolved_rows(doc, pos, ref, ref_pos, buckets: int, ways: int) -> Iterator[tuple[int, bool, bytes]]:
    """Windows with their references, dealt out by document in ``ways`` groups of buckets."""
    to = (doc.astype(np.uint64) * _BASE >> np.uint64(33)).astype(np.int64) % buckets * ways // buckets
    for b, own in _cuts(to):
        ids, at = _pack_ids(np.concatenate((doc[own], ref[own])))
        yield b, True, _join(_squeeze(ids), _squeeze(at[: len(own)], pos[own], at[len(own) :], ref_pos[own]))


def _fold(parts: list[tuple], buckets: int, ways: int, last: bool = False) -> Iterator[tuple[int, bool, bytes]]:
    """Windows whose hash a smaller document of ``parts`` has too, resolved; unless it is the last step also the others, dealt out by hash."""
    h, doc, pos = (np.concatenate(x) for x in zip(*parts))
    h, doc, pos, first = _first_of_each(h, doc, pos)
    lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    yield from _resolved_rows(doc[~first], pos[~first], doc[lead[~first]], pos[lead[~first]], buckets, ways)
    if last:
        return
    h, doc, pos = h[first], doc[first], pos[first]
    for b, own in _cuts((h % np.uint64(buckets)).astype(np.int64) * ways // buckets):
        ids, at = _pack_ids(doc[own])
        yield b, False, _join(_squeeze(ids), _squeeze(np.diff(h[own].view(np.int64), prepend=np.int64(0)), at, pos[own]))


def _unresolved(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, body = _split(data)
    steps, at, pos = _unsqueeze(body, 3)
    return np.cumsum(steps).view(np.uint64), np.cumsum(_unsqueeze(ids, 1)[0])[at], pos


def _resolved(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, body = _split(data)
    names = np.cumsum(_unsqueeze(ids, 1)[0])
    d, pos, r, ref_pos = _unsqueeze(body, 4)
    return names[d], pos, names[r], ref_pos


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _split(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:4], "little")
    return data[4 : 4 + n], data[4 + n :]


def _first_of_each(h: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Rows sorted by hash, document and place; of a hash and document the first stays. Also where each hash begins."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc, pos = h[new], doc[new], pos[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h, doc, pos, first


_DDL = "bucket int, resolved boolean, data binary"
#: The bucket of hashes that unequal windows of one document share.
_SHARED = -1


def shared_hashes(words: list[bytes], hashes: np.ndarray, window: int) -> np.ndarray:
    """Hashes that unequal windows of these words have in common."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    return np.array(sorted({int(h[i]) for i in same if words[order[i] : order[i] + window] != words[order[i + 1] : order[i + 1] + window]}), np.uint64)


def _deal(df: DataFrame, buckets: int) -> DataFrame:
    """Rows of _PAYLOAD in their buckets; they come by groups of buckets, which beyond FAN buckets are dealt out in a second hop."""
    ways = min(buckets, max(FAN, math.isqrt(buckets)))

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: dict[bool, list] = {False: [], True: []}
            n = {False: 0, True: 0}

            def flush(done):
                if held[done]:
                    yield from _resolved_rows(*(np.concatenate(x) for x in zip(*held[done])), buckets, buckets) if done else _fold(held[done], buckets, buckets)
                    held[done], n[done] = [], 0

            for b in batches:
                for bucket, done, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if bucket == _SHARED:
                        yield bucket, done, data
                        continue
                    part = _resolved(data) if done else _unresolved(data)
                    held[done].append(part)
                    n[done] += len(part[0])
                    if n[done] >= FLUSH:
                        yield from flush(done)
            yield from flush(False)
            yield from flush(True)

        return as_batches(_PAYLOAD, rows(), 16)

    if ways < buckets:
        df = df.repartition(ways, "bucket").sortWithinPartitions("bucket").mapInArrow(regroup, _DDL)
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _candidates(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, data): resolved windows by bucket of their document."""
    src = docs.where("key is not null").select("key", "body")
    ways = min(buckets, max(FAN, math.isqrt(buckets)))

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, n = [], 0
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                    words = t.as_py().split()
                    x = window_hashes(words, window)
                    if len(x):
                        if len(np.unique(x)) < len(x) and len(shared := shared_hashes(words, x, window)):
                            yield _SHARED, True, _squeeze(shared.view(np.int64))
                        held.append((x, np.full(len(x), k, np.int64), np.arange(len(x), dtype=np.int64)))
                        n += len(x)
                        if n >= FLUSH:
                            yield from _fold(held, buckets, ways)
                            held, n = [], 0
            if held:
                yield from _fold(held, buckets, ways)

        return as_batches(_PAYLOAD, rows(), 16)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, parts = None, []
            for b in batches:
                for bucket, done, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if done:
                        if bucket != _SHARED and ways < buckets:  # on to the next hop by its group
                            bucket = bucket * ways // buckets
                        yield bucket, True, data
                        continue
                    if bucket != now:
                        if parts:
                            yield from _fold(parts, buckets, ways, last=True)
                        now, parts = bucket, []
                    parts.append(_unresolved(data))
            if parts:
                yield from _fold(parts, buckets, ways, last=True)

        return as_batches(_PAYLOAD, rows(), 16)

    return _deal(_deal(src.mapInArrow(hash_windows, _DDL), buckets).mapInArrow(match, _DDL), buckets).select("bucket", "data")


def _segments(candidates: DataFrame) -> DataFrame:
    """(key, pos, ref, ref_start, n_windows): runs of windows that follow each other in a document and in its reference.

    A row without a key holds, in ``ref``, a hash that unequal windows of a document share.
    """
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32()), ("n_windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(parts):
            doc, pos, ref, ref_pos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ref, pos, doc))
            doc, pos, ref, ref_pos = doc[order], pos[order], ref[order], ref_pos[order]
            one = np.ones(len(doc), bool)  # a window may be resolved twice; its smallest reference stays
            one[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
            doc, pos, ref, ref_pos = doc[one], pos[one], ref[one], ref_pos[one]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref_pos[1:] != ref_pos[:-1] + 1)
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at].astype(np.int32)), pa.array(ref[at]), pa.array(ref_pos[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(doc))).astype(np.int32))], schema=schema)

        now, parts = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket == _SHARED:
                    h = _unsqueeze(data, 1)[0]
                    no = pa.nulls(len(h), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), no, pa.array(h), no, no], schema=schema)
                    continue
                if bucket != now and parts:
                    yield from join(parts)
                    parts = []
                now = bucket
                parts.append(_resolved(data))
        if parts:
            yield from join(parts)

    return candidates.mapInArrow(run, "key long, pos int, ref long, ref_start int, n_windows int")


class SuffixAutomaton:
    """Of all substrings of the sequences added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matching_statistics(self, sequence) -> Iterator[int]:
        """At each place, the length of the longest substring held that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is not None:
                state = to
                n += 1
            yield n


def statistics(words: list, passages: list[list]) -> np.ndarray:
    """The matching statistics of ``words`` against the automaton of the passages."""
    automaton = SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    return np.fromiter(automaton.matching_statistics(words), np.int64, len(words))


def covered(n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans (from, to) that matching statistics of ``window`` or more cover."""
    out: list[list[int]] = []
    for i in np.flatnonzero(n >= window).tolist():
        a = i - int(n[i]) + 1
        if out and a <= out[-1][1]:
            out[-1][0], out[-1][1] = min(a, out[-1][0]), i + 1
        else:
            out.append([a, i + 1])
    return [(a, b) for a, b in out]


def spans(words: list, passages: list[list], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans (from, to) of ``words`` covered by windows that occur in a passage."""
    return covered(statistics(words, passages), window)


def refuted(words: list[bytes], n: np.ndarray, segments: list[tuple[int, int]], window: int) -> list[int]:
    """Hashes of windows in (position, count) segments whose words are in no passage, by the matching statistics."""
    at = np.unique(np.concatenate([np.arange(p, p + c) for p, c in segments] or [np.empty(0, np.int64)]).astype(np.int64))
    at = at[at + window <= len(words)]
    return [int(window_hashes(words[i : i + window], window).view(np.int64)[0]) for i in at[n[at + window - 1] < window].tolist()]


def _look_again(src: DataFrame, hashes: DataFrame, window: int) -> DataFrame | None:
    """(again_key, more): words of the windows of these hashes that also start in a document with a smaller id, by comparing them whole.

    The hashes reach the workers ``AGAIN`` at a time, one pass over the documents for each; None if there are none.
    """
    spark = src.sparkSession
    hashes = materialise(hashes.distinct(), "again")
    total = hashes.count()
    slices = -(-total // AGAIN)
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary())])
    out = None
    for k in range(slices):
        own = np.sort(np.array([r["h"] for r in hashes.where(F.pmod(F.xxhash64("h"), F.lit(slices)) == k).collect()], np.int64))
        shared = spark.sparkContext.broadcast(own)

        def take(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def rows():
                for b in batches:
                    for key, body in zip(b.column(0).to_pylist(), b.column(1)):
                        words = body.as_py().split()
                        h = window_hashes(words, window).view(np.int64)
                        for i in np.flatnonzero(np.isin(h, shared.value)).tolist():
                            yield key, b" ".join(words[i : i + window])

            return as_batches(schema, rows())

        one = src.where("key is not null").select("key", "body").mapInArrow(take, "key long, words binary")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    taken = materialise(out.distinct(), "windows")
    low = taken.groupBy(F.col("words").alias("same")).agg(F.min("key").alias("low"))
    late = taken.join(low, F.col("words") == F.col("same")).where("key > low")
    return late.groupBy(F.col("key").alias("again_key")).agg(F.collect_set("words").alias("more"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256), with ``keep_text`` also the kept words joined by spaces.

    Words are runs of bytes other than ASCII white space. A row for each input row. Null
    and empty texts have no words; texts shorter than a window lose nothing, very long ones
    are read whole; repeated rows have equal ids and remove nothing from each other; rows
    with a null id neither lose words nor take any away; an empty table gives an empty
    result; other columns do not matter. Rows of one id and different texts are one
    document's; only there, unequal windows of equal hash at different texts may pass for one.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("body"))
    total = src.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    found = materialise(_segments(_candidates(src, window, buckets)), "segments")
    runs = found.where("key is not null")
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = src.repartition(parts, "key")

    wanted = runs.select("ref", "ref_start", "n_windows").distinct().groupBy("ref").agg(F.collect_list(F.struct("ref_start", "n_windows")).alias("wanted"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ref", pa.int64()), ("ref_start", pa.int32()), ("n_windows", pa.int32()), ("passage", pa.binary())])

        def rows():
            for b in batches:
                for k, body, wants in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    words = body.as_py().split()
                    for w in wants.as_py():
                        a, n = w["ref_start"], w["n_windows"]
                        yield k, a, n, b" ".join(words[a : a + n + window - 1])

        return as_batches(schema, rows())

    passages = placed.join(wanted, F.col("key") == F.col("ref")).select("key", "body", "wanted").mapInArrow(take, "ref long, ref_start int, n_windows int, passage binary")
    lists = runs.join(passages, ["ref", "ref_start", "n_windows"]).groupBy(F.col("key").alias("of")).agg(F.collect_set("passage").alias("passages"), F.collect_set(F.struct("pos", "n_windows")).alias("segments"))
    joined = placed.join(lists, F.col("key") == F.col("of"), "left").select("key", "body", "passages", "segments")

    names = ["key", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []), "again"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else []), pa.list_(pa.int64())]
    ddl = "key long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "") + ", again array<long>"

    def row(key, words, gone, again):
        kept, at = [], 0
        for lo, hi in gone:
            kept += words[at:lo]
            at = hi
        kept += words[at:]
        rest = b" ".join(kept)
        return (key, len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "replace")] if keep_text else []), again)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k, body, own, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                    words, gone, again = body.as_py().split(), [], None
                    if own := own.as_py():
                        n = statistics(words, [p.split() for p in own])
                        gone = covered(n, window)
                        again = refuted(words, n, [(r["pos"], r["n_windows"]) for r in runs.as_py()], window) or None
                    yield row(k, words, gone, again)

        return as_batches(pa.schema(list(zip(names, types))), rows())

    judged = materialise(joined.mapInArrow(judge, ddl), "judged")
    hashes = judged.select(F.explode("again").alias("h")).unionByName(found.where("key is null").select(F.col("ref").alias("h")))
    more = _look_again(src, hashes, window)
    if more is None:
        return judged.drop("again")

    def judge_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k, body, own, also in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                    words = body.as_py().split()
                    yield row(k, words, spans(words, [p.split() for p in (*(own.as_py() or ()), *also.as_py())], window), None)

        return as_batches(pa.schema(list(zip(names, types))), rows())

    more = materialise(more, "late")
    changed = joined.join(more, F.col("key") == F.col("again_key")).select("key", "body", "passages", "more").mapInArrow(judge_again, ddl)
    same = judged.join(more, F.col("key") == F.col("again_key"), "left_anti")
    return same.unionByName(changed).drop("again")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
y AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM x),
m AS (SELECT s, min(doc_id) AS low FROM y GROUP BY s),
r AS (SELECT DISTINCT y.doc_id, y.i + k AS p FROM y JOIN m ON y.s = m.s AND m.low < y.doc_id, range({WINDOW}) t(k)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN r ON u.doc_id = r.doc_id AND u.p = r.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
