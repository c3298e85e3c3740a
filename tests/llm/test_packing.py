import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanwise.llm import packing, queries

ROOT = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>x", "a²b 1½ ª", "I'm you'll  \n\n x  ", "日本語 テスト \x1c\x85   a", "<|endoftext|>  \t\t a_b __ 12,3.4 ’s “q”…", "Ǆ İ ſ ŉ", "  ", "\n", "a\r\nb \r\n  c", " x ", "é é", "'S 'd'll'", "x" * 5000, " ".join(map(str, range(3000)))]


@lru_cache
def tokenizer():
    return Tokenizer.from_file(JSON)


def ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_cached_words_give_the_tokenizers_ids(spark):
    fast = packing.encoder(JSON, RANKS)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(fast(t), "<u4").tolist() == ids(t)


def test_added_tokens_are_one_id():
    for encode in (packing.encoder(JSON, RANKS), packing.encoder(JSON)):
        assert np.frombuffer(encode("hello <|endoftext|> world"), "<u4").tolist() == [31373, 220, 50256, 995]


def check_packing(rows, texts, tokens=2048):
    """Pieces cover each document in order, and sequences are gapless and no longer than allowed."""
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["key"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= tokens
    for k, t in texts.items():
        own = [*ids(t or ""), 0]
        at = 0
        p = sorted(pieces[k])
        assert [x[0] for x in p] == list(range(-(-len(own) // tokens)))
        for i, (_, start, n, crc) in enumerate(p):
            assert start == at and (n == tokens or i == 0) and crc == zlib.crc32(np.array(own[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(own)
    return len(seqs), sum(r["length"] for r in rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = queries.pack_documents(docs).collect()
    n, total = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert n <= -(-total // 2048) * 1.02 + 2


def test_edges(spark):
    texts = dict(enumerate([*ODD, None]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(df, JSON, RANKS).collect(), texts)
    assert sorted(map(str, packing.pack(df, JSON).select("key", "piece", "length", "ids_crc32").collect())) == sorted(map(str, packing.pack(df, JSON, RANKS).select("key", "piece", "length", "ids_crc32").collect()))
    twice = packing.pack(df.unionByName(df), JSON, RANKS).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), JSON, RANKS).count() == 0


def test_small_sequences(spark):
    texts = {1: "a b c d e f g h i j k l m", 2: "one two three", 3: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(df, JSON, RANKS, tokens=5, documents=2).collect(), texts, 5)


def slow_best_fit(lengths, caps, w, rule):
    bins, out = [], []
    for n in lengths:
        need = (n, 1, n * n)
        fits = [(i, b) for i, b in enumerate(bins) if all(x >= y for x, y in zip(b, need))]
        if rule == "norm":
            key = lambda ib: sum(v * ((x - y) / c) ** 2 for x, y, c, v in zip(ib[1], need, caps, w))
        else:
            key = lambda ib: -sum(v * x * y / c**2 for x, y, c, v in zip(ib[1], need, caps, w))
        if fits:
            best = min(key(f) for f in fits)
            i = next(i for i, b in fits if key((i, b)) <= best * (1 + 1e-12) + 1e-15 or key((i, b)) == best)
        else:
            bins.append(list(caps))
            i = len(bins) - 1
        out.append(i)
        bins[i] = [x - y for x, y in zip(bins[i], need)]
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(1000, 10_000), (3, 10_000), (50, 3000), (2, 5000)])
def test_vector_capacities_hold(rule, documents, attention):
    rng = np.random.default_rng(documents)
    lengths = np.sort(rng.integers(1, 50, 400))[::-1]
    w = (1.0, 0.3, 0.2)
    bins, offsets = packing.best_fit(lengths, 100, documents, attention, w, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= documents and (own**2).sum() <= attention
        assert sorted(offsets[bins == b].tolist()) == np.concatenate(([0], np.cumsum(own)[:-1])).tolist()
    slow = slow_best_fit(lengths.tolist(), (100, documents, attention), w, rule)
    assert len(set(slow)) == bins.max() + 1


def test_pieces_that_fit_nowhere_are_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([80]), 100, 5, 1000)
    assert len(packing.best_fit(np.array([], np.int64))[0]) == 0


@pytest.mark.parametrize(("n", "expected"), [(1, [1]), (5, [5]), (6, [1, 5]), (10, [5, 5]), (13, [3, 5, 5])])
def test_cutting(n, expected):
    assert [p[2] for p in packing.pieces_of(bytes(4 * n), 5)] == expected
