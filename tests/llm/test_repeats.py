"""Substring dedup by words and by bytes, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from spanwise.llm import substring_dedup, suffix_dedup
from spanwise.llm.substring_dedup import SuffixAutomaton, spans


def word_docs(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "the", "x1", "Ä"]
    passages = [[rng.choice(vocab) for _ in range(rng.randrange(3, 12))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) + str(rng.randrange(50)) for _ in range(rng.randrange(8))]
        rows.append((rng.randrange(10_000) - 50, rng.choice([" ", "\n ", "\t"]).join(w)))
    return [*rows, (rows[0][0], rows[1][1]), rows[2], rows[2], (None, rows[3][1]), (None, rows[3][1]), (77_777, None), (77_778, ""), (77_779, rows[5][1])]


def slow_words(rows, window):
    docs = [(k, (t or "").encode().split()) for k, t in rows]
    low = {}
    for k, w in docs:
        if k is not None:
            for i in range(len(w) - window + 1):
                x = tuple(w[i : i + window])
                low[x] = min(low.get(x, k), k)
    out = []
    for k, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and low[tuple(w[i : i + window])] < k:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(k), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "window", "bucket_bytes"), [(1, 4, 12_000_000), (2, 3, 300), (3, 6, 100)])
def test_words_against_brute_force(spark, monkeypatch, seed, window, bucket_bytes):
    monkeypatch.setattr(substring_dedup, "FLUSH", 40)
    rows = word_docs(seed)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window, bucket_bytes=bucket_bytes).collect()
    assert sorted((str(r["key"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == slow_words(rows, window)


def test_words_kept_text_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["key"]: r["kept"] for r in substring_dedup.remove_repeats(df, window=4, keep_text=True).collect()}
    assert got == {1: "a b c d e f", 2: "x y"}
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_colliding_hashes_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HASH_BITS", 3)
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda w, n: np.arange(max(0, len(w) - n + 1), dtype=np.uint64) % np.uint64(3))
    rows = word_docs(4, 20)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=4).collect()
    truth = {x[0]: x for x in slow_words(rows, 4)}
    assert all(r["n_removed"] <= truth[str(r["key"])][2] or str(r["key"]) == str(rows[0][0]) for r in got)


@pytest.mark.parametrize(("bits", "parts", "fan", "bucket_bytes"), [(1, 1, 1024, 12_000_000), (1, 2, 1024, 12_000_000), (3, 4, 2, 60), (64, 4, 2, 60)])
def test_equal_hashes_lose_no_repeat(spark, monkeypatch, bits, parts, fan, bucket_bytes):
    """Hashes of a few bits collide all the time; the result is still that of brute force, however rows are dealt out."""
    for name, value in (("HASH_BITS", bits), ("FAN", fan), ("FLUSH", 50), ("AGAIN", 3)):
        monkeypatch.setattr(substring_dedup, name, value)
    own = {k: t for k, t in word_docs(7, 20) if k is not None}
    rows = [*own.items(), *list(own.items())[:2], (None, "a b c d e f"), (-99, "q r s t"), (99_998, "u v w x"), (99_999, "u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = substring_dedup.remove_repeats(df, window=4, bucket_bytes=bucket_bytes).collect()
    assert sorted((str(r["key"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == slow_words(rows, 4)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    refs = [[rng.choice("ab") for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 5))]
    text = [rng.choice("abc") for _ in range(60)]
    a = SuffixAutomaton()
    for x in refs:
        a.add(x)
    held = {tuple(x[i:j]) for x in refs for i in range(len(x)) for j in range(i, len(x) + 1)}
    slow = [max(n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in held) for i in range(len(text))]
    assert list(a.matching_statistics(text)) == slow
    covered = {p for i, n in enumerate(slow) if n >= 4 for p in range(i - n + 1, i + 1)}
    assert {p for lo, hi in spans(text, refs, 4) for p in range(lo, hi)} == covered


def byte_docs(seed, length):
    rng = random.Random(seed)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passages = [word(rng.randrange(length // 2, 3 * length)) for _ in range(5)]
    rows = []
    for i in range(40):
        b = b""
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p) // 2)
            b += p[lo : lo + rng.randrange(len(p))] if rng.random() < 0.6 else word(rng.randrange(length))
        rows.append((i, b.decode()))
    runs = [(100, "ab" * length), (101, "ab" * (length - 7)), (102, "z" * (2 * length)), (103, "é" * length)]
    return [*rows, *runs, rows[3], (None, rows[4][1]), (104, None), (105, ""), (106, "x" * (length - 1)), (107, "q" * length)]


def slow_bytes(rows, length):
    docs = [(k, (t or "").encode()) for k, t in rows]
    count = {}
    for _, b in docs:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for k, b in docs:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(k), len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "length", "chunk", "flush"), [(1, 64, 100_000, 500_000), (2, 100, 100_000, 20), (3, 70, 2, 30), (4, 200, 100_000, 500_000)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, length, chunk, flush):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rows = byte_docs(seed, length)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length, bucket_bytes=3000).collect()
    assert sorted((str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow_bytes(rows, length)


@pytest.mark.parametrize(("seed", "crowd"), [(5, 10**9), (6, 10)])
def test_bytes_in_two_hops(spark, monkeypatch, seed, crowd):
    """More buckets than a task deals out to at once."""
    for name, value in (("FAN", 2), ("FLUSH", 30), ("CROWD", crowd)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = byte_docs(seed, 64)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=64, bucket_bytes=400).collect()
    assert sorted((str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow_bytes(rows, 64)
    assert suffix_dedup.ways_of(2) == 2 and suffix_dedup.ways_of(1 << 20) == 1024


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes_in_chunks_of_their_own(spark, monkeypatch, seed):
    """A gram with more contexts than are sorted at once: their offsets are halved."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3)
    monkeypatch.setattr(suffix_dedup, "HELD", 1)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, near = word(60), [word(30) for _ in range(5)]
    rows = [(i, word(40) + rng.choice(near) + passage + rng.choice(near) + word(40)) for i in range(14)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=64).collect()
    assert sorted((str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow_bytes(rows, 64)


@pytest.mark.parametrize("chunk", [3, 8192])
def test_crowded_buckets_by_aggregates(spark, monkeypatch, chunk):
    """Buckets of more anchors than a task settles; some of whose grams have many contexts."""
    for name, value in (("CROWD", 10), ("CHUNK", chunk), ("HELD", 1), ("FLUSH", 25)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(chunk)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, near = word(60), [word(30) for _ in range(4)]
    rows = [*byte_docs(6, 64), *((200 + i, word(40) + rng.choice(near) + passage + rng.choice(near) + word(40)) for i in range(30))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=64, bucket_bytes=3000).collect()
    assert sorted((str(r["key"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == slow_bytes(rows, 64)


def test_bytes_kept_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" + "abcdefghij" * 10), (2, "abcdefghij" * 10 + "y")], "doc_id long, text string")
    got = {r["key"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(df, length=90, keep_bytes=True).collect()}
    assert got == {1: b"x", 2: b"y"}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, length=10)


def test_anchors_of_long_documents(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PART", 257)
    rng = random.Random(3)
    b = bytes(rng.randrange(97, 105) for _ in range(3000))
    p, h = suffix_dedup.anchors(b, 100)
    monkeypatch.setattr(suffix_dedup, "_PART", 1 << 20)
    q, g = suffix_dedup.anchors(b, 100)
    assert p.tolist() == q.tolist() and h.tolist() == g.tolist()
    assert all(any(i <= x <= i + 100 - suffix_dedup.GRAM for x in p.tolist()) for i in range(len(b) - 99))


@pytest.mark.parametrize("shallow", [1, 8, 24, 48])
@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sort(seed, shallow):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(60))) for _ in range(8)]
    strings = [rng.choice(base)[: rng.randrange(61)] + bytes(rng.choice(b"\0ab\xff") for _ in range(rng.randrange(5))) for _ in range(200)] + [b"", b"", b"\0", b"\0\0"]
    order, lcp = suffix_dedup.deep_shallow_sort(strings, shallow)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
    assert lcp.tolist() == [0] + [suffix_dedup.common_prefix(a, b) for a, b in zip(got, got[1:])]
