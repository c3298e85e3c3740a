"""Source divergence audit against its SQL and plain counting."""

import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from spanwise.llm import divergence, queries

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def rows_of(df):
    return sorted(tuple(r) for r in df[COLUMNS].itertuples(index=False))


def by_sql(documents):
    return rows_of(duckdb.connect().register("documents", documents).sql(divergence.ORACLE).df())


def by_hand(rows, top=200):
    """The contract in plain Python."""
    docs = defaultdict(Counter)
    groups, each = {}, defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        words, now = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                words += [now] if now else []
                now = ""
            else:
                now += c.lower() if c.isascii() else c
        for w in set(words):
            docs[lang][w] += 1
        each[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for w, n in docs[lang].items() if n >= 3)
        total = sum((each[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: share(each[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if each[lang, s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms[:top])]
    return sorted(out)


def made(seed, n=160):
    rng = random.Random(seed)
    words = ["The", "the", "ÉTÉ", "été", "naïve", "日本", "a", "b1c", "x-y", "Z", "don't", "\x00nul\x00", "ǅ"] + [f"w{chr(97 + i)}" for i in range(20)]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(words, [5 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40))), "12 34 --"])
    return [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), text()) for _ in range(n)] + [("one", "only", "few words"), ("none", "a", "x"), ("none", "b", None)]


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_counting_and_sql(spark, monkeypatch, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    exp = by_hand(rows)
    assert by_sql(pd.DataFrame(rows, columns=["lang", "source", "text"])) == exp
    assert rows_of(divergence.audit(df).toPandas()) == exp
    # Blocks, tables and shards of a few rows each.
    for name, value in (("BLOCK_CHARS", 50), ("HELD", 7), ("SHARD", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(df.repartition(3)).toPandas()) == exp


def test_query_against_sql(spark):
    assert rows_of(queries.op11_divergence(spark, ROOT).toPandas()) == by_sql(pd.read_parquet(f"{ROOT}/documents.parquet"))


def test_top_ties_and_other_columns(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i)}" * 1 for i in range(12) if (i % 2) == (s == "a"))) for s in "ab" for _ in range(3)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, item string, total int")
    got = rows_of(divergence.audit(df, top=2).toPandas())
    assert got == by_hand(rows, 2) and [r[3] for r in got if r[1] == "a" and r[2] == "term"] == ["tb", "td"]
    assert divergence.audit(df.limit(0)).count() == 0 and divergence.audit(df.limit(0)).columns == COLUMNS


def test_a_very_long_text(spark):
    rows = [("en", "a", "word Other " * 400_000), ("en", "b", "word"), ("en", "b", "word other")]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).toPandas()) == by_hand(rows)
