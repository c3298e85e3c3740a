"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
from array import array
from functools import lru_cache

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from spanwise.llm import byte_bpe, queries

ROOT = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN
ODD = ["", "hello <|endoftext|> world", "a²b 1½ ª", "I'm you'll  \n\n x  ", "日本語 テスト \x1c\x85   a", "a_b __ 12,3.4 ’s “q”…", "Ǆ İ ſ ŉ Āā", "  ", "\n", "a\r\nb \r\n  c", " x ", "é é", "'S 'd'll'", "x" * 50_000, " ".join(map(str, range(3000))), "a\x00b", "😀" * 3000, "▁a <unk> <s> �", " " * 3000 + "end", "퟿\U0010ffff"]


@lru_cache
def library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_round_trip_and_ids(spark, name):
    texts = [*ODD, None] + [r["text"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path(name)
    coded = df.withColumn("ids", byte_bpe.encode("text", path, PATTERN))
    rows = coded.withColumn("back", byte_bpe.decode("ids", path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library(name).encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["back"]) == (texts[r["doc_id"]] or "").encode()


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    rows = queries.op12_byte_bpe(spark, ROOT).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library("byte_bpe_50k.tiktoken").encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_tokens_that_merges_do_not_lead_to():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abcd", b"xyz"]
    own = byte_bpe.Codec(tokens, r"\w+|\s+")
    theirs = tiktoken.Encoding("own", pat_str=r"\w+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert len(own.whole) == 2  # "abcd" and "xyz"
    for text in ("abcd", "xyz", "abcd xyz", "abcde xyzx", "bcd abc", "aabbcc"):
        assert array("i", own.encode([text])[0]).tolist() == theirs.encode_ordinary(text)


def test_model_is_read_by_sentencepiece():
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sp = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialised(tokens))
    assert sp.get_piece_size() == len(tokens) + 1 and sp.unk_id() == len(tokens)
    assert sp.id_to_piece(5000) == byte_bpe.mapped(tokens[5000]) and sp.get_score(5000) == -5000


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    own = byte_bpe.Codec([bytes([b]) for b in range(256)], r"\S+|\s+")
    for i in range(20):
        ids = array("i", own.encode([f"w{i} v{i} {'z' * 100}", None])[0])
        assert bytes(ids.tolist()).decode() == f"w{i} v{i} {'z' * 100}" and len(own.known) <= 5


def test_edges(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "a b", [64]), (1, "a b", None), (2, None, [])], "doc_id long, text string, ids array<int>")
    out = df.withColumn("n", byte_bpe.encode("text", path, PATTERN)).withColumn("b", byte_bpe.decode("ids", path)).collect()
    assert sorted((r["n"], bytes(r["b"])) for r in out) == [([], b""), ([64, 275], b""), ([64, 275], b"a")]
    assert df.limit(0).withColumn("n", byte_bpe.encode("text", path, PATTERN)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.createDataFrame([([50_256],)], "ids array<int>").select(byte_bpe.decode("ids", path)).collect()
    gap = tmp_path / "gap"
    gap.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(gap))
