"""The pipeline's stages, each held against brute force on its own input."""

import sys

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from spanwise.llm import decontam, line_dedup, packing, queries, runtime, stages

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], ROOT).cache())
    return out


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]


def test_columns_stay(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_language_keeps_clean_documents(steps):
    before, after = (set(r["doc_id"] for r in s.collect()) for s in steps[:2])
    assert after <= before and len(after) >= 0.98 * len(before)


def test_lines(steps):
    before, after = steps[1].toPandas(), {r["doc_id"]: r for r in steps[2].collect()}
    documents = before  # noqa: F841  read by DuckDB
    for doc_id, text, *_ in duckdb.sql(line_dedup.ORACLE.replace("SELECT doc_id, CASE", "SELECT doc_id, CASE")).fetchall():
        assert after[doc_id]["text"] == text and after[doc_id]["n_chars"] == len(text)


def groups(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in links:
        label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def five_word_shingles(text):
    w = text.encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_copies(steps):
    """Groups by the exact Jaccard index of five-word shingles, against those of the stage: it keeps one row of each
    group at 0.9, and drops no row but those of a group at 0.7, so its own threshold lies where 0.8 is estimated."""
    rows = sorted((r["doc_id"], five_word_shingles(r["text"])) for r in steps[2].collect())
    kept = {r["doc_id"] for r in steps[3].collect()}
    pairs = [(i, j, x) for i in range(len(rows)) for j in range(i) if (x := jaccard(rows[i][1], rows[j][1])) >= 0.7]
    close, wide = (groups(len(rows), [(i, j) for i, j, x in pairs if x >= least]) for least in (0.9, 0.7))
    assert {k for g, (k, _) in zip(wide, rows) if rows[g][0] == k} <= kept <= {k for g, (k, _) in zip(close, rows) if rows[g][0] == k}
    assert len(kept) < len(rows)


def test_test_items(spark, steps):
    index = decontam.build_indexes(spark.read.parquet(f"{ROOT}/benchmark.parquet"))[0]
    kept = {r["doc_id"] for r in steps[4].collect()}
    assert kept == {r["doc_id"] for r in steps[3].collect() if not index.leaks(r["text"])}


def test_sequences(steps):
    got = steps[5].collect()
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in got) == sum(len(encode(r["text"])) // 4 + 1 for r in steps[4].collect())
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in steps[4].collect()}


def test_run_is_the_stages(spark, steps):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, corpus_pipeline.run(spark, ROOT).select(*cols).collect())) == sorted(map(str, steps[5].select(*cols).collect()))


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "the house and the garden of the town", None, None, 5), (3, "the house and the garden of the town", None, None, 5), (None, "the man and the sea", "en", "s", 3), (4, "12 34", "en", "s", 5), (3, "quite another text that shares nothing", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    train = spark.read.parquet(f"{ROOT}/documents.parquet").unionByName(docs)
    kept = stages.by_language(spark, train, ROOT).where("doc_id is null or doc_id in (1, 2, 3, 4)")
    assert kept.where("lang is null").count() == 0
    for f in (stages.without_boilerplate, stages.without_near_copies, stages.without_benchmark):
        assert f(spark, docs, ROOT).columns == docs.columns and f(spark, docs.limit(0), ROOT).count() == 0
    near = [r["doc_id"] for r in stages.without_near_copies(spark, docs, ROOT).collect()]
    assert near.count(3) == 2 and near.count(None) == 1 and near.count(1) == 1 and 2 not in near
    assert queries.pack_documents(docs).count() == len(rows)


def test_columns_named_like_helpers_stay(spark):
    rows = [(i, "the house and the garden of the town " + chr(97 + i) * 3, "en", "s", 1, "p", 0.5, i, True) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lid_pred string, lid_score double, nc_key long, key boolean")
    for f in (stages.by_language, stages.without_boilerplate, stages.without_near_copies, stages.without_benchmark):
        out = f(spark, docs, ROOT)
        assert out.columns == docs.columns and {(r["lid_pred"], r["lid_score"], r["key"]) for r in out.collect()} == {("p", 0.5, True)}


def test_the_sessions_batch_size_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7777")
    try:
        stages.without_near_copies(spark, spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"), ROOT).collect()
        assert spark.conf.get(key) == "7777"
    finally:
        spark.conf.set(key, before)


def test_batches_of_stages_that_the_caller_runs_are_bounded(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    short, long_ = (spark.range(0, n, 1, 1).selectExpr("id as doc_id", f"repeat('the house and the garden of the town ', {times}) as text", "'en' as lang", "'s' as source", "5L as n_chars") for n, times in ((3000, 1), (48, 25_000)))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        for f in (stages.by_language, stages.without_benchmark):
            for docs in (short, long_):
                for k, v in zip(keys, ("10000", "64m")):
                    spark.conf.set(k, v)
                got = f(spark, docs, ROOT).mapInArrow(sizes, "n long, size long").collect()
                assert sum(r["n"] for r in got) == docs.count()
                assert all(r["n"] <= runtime.TEXT_BATCH_ROWS and r["size"] <= 2 * runtime.TEXT_BATCH_BYTES for r in got)
        for k, v in zip(keys, ("100", "1m")):
            spark.conf.set(k, v)
        assert stages.without_benchmark(spark, short, ROOT).columns == COLUMNS and tuple(map(spark.conf.get, keys)) == ("100", "1m")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_rest_works_without_this(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("spanwise.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "spanwise.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert "gravity_singly" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
