import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import language_id

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    held = language_id.held_out()
    model = language_id.train(docs, ~held)
    got = language_id.identify(docs.withColumn("held", held), model)
    right = got.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and set(model.languages) == {"de", "en", "es", "fr"}
    assert got.where("score < 0 or score > 1 or score is null").count() == 0 and got.count() == docs.count()


def _toy(spark):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * 5 + chr(97 + i % 26), "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_edges(spark):
    toy = _toy(spark)
    model = language_id.train(toy, F.lit(True))
    odd = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (3, "12 34 !?", "r"), (4, "the and of the", "s"), (4, "the and of the", "s"), (None, "der und die", "t"), (6, "und " * 50_000, "u")], "doc_id long, text string, lang_pred string")
    got = language_id.identify(odd, model).orderBy("doc_id", "text").collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[None][0] == "de" and by[6][0] == "de"
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    toy = _toy(spark)
    model = language_id.train(toy.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert model.languages == [] and {r["lang_pred"] for r in language_id.identify(toy, model).collect()} == {"und"}


def test_labels_held_out_are_not_learned(spark):
    toy = _toy(spark).withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert language_id.train(toy, ~language_id.held_out()).languages == ["de", "en"]


def test_sample_is_bounded_and_stable(spark):
    toy = _toy(spark)
    a = language_id.train(toy, F.lit(True), per_language=10)
    b = language_id.train(toy.repartition(7), F.lit(True), per_language=10)
    assert abs(a.weights - b.weights).max() < 1e-5


def slow_bits(text):
    """The features by the definition: n-grams of letters and single blanks, hashed one at a time."""
    out, run = [], [0]
    for c in text.lower():
        if c.isalpha():
            run.append(ord(c))
        elif run[-1]:
            run.append(0)
    if run[-1]:
        run.append(0)
    if not any(run):
        return frozenset()
    h = [c * 2654435761 % 2**32 for c in run]
    for n, bits in enumerate(language_id.GRAM_BITS):
        if n:
            h = [(a * 31 + c) * 2654435761 % 2**32 for a, c in zip(h, run[n:])]
        out += [(x >> (32 - bits)) + int(language_id._STARTS[n]) for x in h]
    return frozenset(out)


def kernel(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_against_plain_kernel_ridge():
    """The folded matrix gives what kernels, landmarks and ridge regression give one value at a time."""
    rng = random.Random(2)
    make = lambda w: " ".join(rng.choice(w) for _ in range(rng.randrange(3, 20)))
    texts = {"a": [make(["the", "and", "of", "Ünder"]) for _ in range(12)], "b": [make(["der", "und", "die"]) for _ in range(20)], "c": [make(["le", "et", "1", "la"]) for _ in range(9)]}
    model = language_id.fit({k: np.array([np.packbits(language_id.presence(t)) for t in v]) for k, v in texts.items()}, landmarks=4, ridge=0.05)
    marks = [slow_bits(t) for k in sorted(texts) for t in texts[k][:4]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    live = values > 1e-6 * values[-1]
    phi = lambda t: np.array([kernel(slow_bits(t), m) for m in marks]) @ (vectors[:, live] / np.sqrt(values[live]))
    gram, goal = 0, 0
    for i, k in enumerate(sorted(texts)):
        for t in texts[k]:
            p = phi(t)
            gram, goal = gram + np.outer(p, p) / len(texts[k]), goal + np.outer(p, np.eye(3)[i]) / len(texts[k])
    ridge = np.linalg.solve(gram + 0.05 * np.trace(gram) / len(gram) * np.eye(len(gram)), goal)
    asked = ["the und", "", "12", "et le la of", "x" * 3000, "der der", None]
    for t, (name, score) in zip(asked, model.score_batch(asked)):
        if not slow_bits(t or ""):
            assert (name, score) == ("und", 0.0)
            continue
        own = phi(t) @ ridge
        assert name == "abc"[int(own.argmax())] and score == pytest.approx(min(1, max(0, own.max())), abs=1e-4)


def test_landmarks_and_labels_are_bounded(spark, monkeypatch):
    toy = _toy(spark)
    monkeypatch.setattr(language_id, "MAX_LANDMARKS", 6)
    model = language_id.train(toy, F.lit(True))
    assert {r["lang"]: r["lang_pred"] for r in language_id.identify(toy, model).collect()} == {"de": "de", "en": "en"}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.train(toy, F.lit(True))


def test_rows_of_one_id_do_not_depend_on_their_order(spark):
    rows = [(1, f"the and of {i}" + "xyz"[i % 3] * i, "en") for i in range(40)] + [(2, f"der und die {i}", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (language_id.train(x, F.lit(True), per_language=8) for x in (df, df.orderBy(F.desc("text")).repartition(5)))
    assert abs(a.weights - b.weights).max() < 1e-6
