import math
import random

import pytest

from spanwise.llm import decontam
from spanwise.llm.decontam import Index

ROOT = "/root/testdata/sf0.01"


def items(rng, n, vocab=60):
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % vocab}" for _ in range(rng.randrange(3, 30))) + ("\nanswer " + f"z{i % 7} q" if i % 2 else "")) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.6, 0.9])
def test_wand_finds_all_above_the_threshold(block, threshold):
    rng = random.Random(block)
    index = Index(items(rng, 150), block)
    for _ in range(40):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(1, 40)))
        slow = {}
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t]):
                slow[i] = slow.get(i, 0) + x
        expected = {i: s for i, s in slow.items() if s >= threshold - 1e-9}
        got = dict(index.retrieve(terms, threshold))
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_an_item_scores_one_against_itself():
    index = Index(items(random.Random(3), 50))
    for i, (item, text) in enumerate(zip(index.ids, [t for _, t in items(random.Random(3), 50)])):
        assert index.leaks(text)[item][0] == pytest.approx(1)


def test_leaks_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    bench = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    got = {(r["key"], r["item_id"]) for r in decontam.find_leaks(docs, decontam.build_indexes(bench)).collect()}
    flat = lambda t: b" %s " % b" ".join(decontam.words(t))
    test = [(r["item_id"], flat(r["text"])) for r in bench.collect()]
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in test if t in flat(r["text"])}
    assert exact and got >= exact
    # What is more than the exact ones holds at least OVERLAP of an item's shingles.
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, i in got - exact:
        q = decontam.shingles(dict(test)[i].split())
        assert len(q & decontam.shingles(decontam.words(texts[k]))) >= 0.7 * len(q)


def slow_leaks(text, items_, threshold=decontam.THRESHOLD, overlap=decontam.OVERLAP):
    """Every item of a length class against every passage of a document, scored word by word."""
    kept = [(i, t, decontam.words(t)) for i, t in sorted(set(items_))]
    mean = sum(len(w) for _, _, w in kept) / len(kept)
    df = {t: sum(t in w for _, _, w in kept) for _, _, x in kept for t in x}
    weight = lambda t, w: math.log(1 + (len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (decontam.K1 + 1) / (w.count(t) + decontam.K1 * (1 - decontam.B + decontam.B * len(w) / mean))
    longest = {}
    for _, _, w in kept:
        c = math.ceil(math.log2(max(len(w), 32)))
        longest[c] = max(longest.get(c, 32), len(w))
    found, own = set(), decontam.words(text)
    for i, t, w in kept:
        stride = longest[math.ceil(math.log2(max(len(w), 32)))]
        parts = decontam.question_and_answer(t)
        for at in range(0, max(1, len(own) - stride), stride):
            passage = own[at : at + 2 * stride]
            score = sum(weight(x, w) for x in set(w) & set(passage)) / sum(weight(x, w) for x in set(w))
            held = decontam.shingles(passage)
            whole = lambda p: not p or (len(p & held) / len(p) >= overlap if len(next(iter(p))) == decontam.SHINGLE else b" %s " % b" ".join(next(iter(p))) in b" %s " % b" ".join(passage))
            if score >= threshold - 1e-9 and all(whole(decontam.shingles(decontam.words(x))) for x in parts):
                found.add(i)
    return found


def test_equal_to_a_scan_of_every_item(spark):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    test = [(i, " ".join(word() for _ in range(rng.choice([2, 4, 12, 30, 40, 90, 200]))) + ("\nthe " + word() + " " + word() if i % 3 == 0 else "")) for i in range(70)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(5)):
            own += [word() for _ in range(rng.randrange(60))]
            w = rng.choice(test)[1].split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                w[rng.randrange(len(w))] = "changed"
            own += w[: rng.choice([len(w), len(w), len(w) - 2])]
        docs.append((d, " ".join(own)))
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), decontam.build_indexes(spark.createDataFrame(test, "item_id long, text string"))).collect()
    slow = {(d, i) for d, t in docs for i in slow_leaks(t, test)}
    assert {(r["key"], r["item_id"]) for r in got} == slow and len(got) == len(slow) > 20


def test_one_long_item_does_not_lengthen_the_passages_of_others():
    rng = random.Random(5)
    index = decontam.Indexes([*items(rng, 30), (999, " ".join(f"long{i}" for i in range(3000)))])
    assert [p.longest for p in index.parts][-1] == 3000 and max(p.longest for p in index.parts[:-1]) <= 64
    text = " ".join(f"long{i}" for i in range(3000))
    assert set(index.leaks(f"{NOISE} {text} {NOISE}")) == {999}


QA = [(1, "What is the name of the small river that runs behind the old mill near the town\nit is called the winding brook by all"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, "short one")]
NOISE = " ".join(f"noise{i}" for i in range(500))


def test_rules():
    index = Index(QA)
    q, a = QA[0][1].split("\n")
    assert set(index.leaks(f"{NOISE} {q.upper()}, {a}! {NOISE}")) == {1}
    assert index.leaks(f"{NOISE} {q} {NOISE}") == {}  # the question without its answer
    assert index.leaks(f"{a} {NOISE}") == {}
    assert set(index.leaks(f"{NOISE} {QA[1][1]}")) == {2}
    assert index.leaks(" ".join(reversed(QA[1][1].split()))) == {}  # the words, but not their order
    assert set(index.leaks(f"{NOISE} a short one {NOISE}")) == {3}
    assert index.leaks("one short") == {}
    changed = QA[0][1].replace("winding", "other").replace("small", "little")
    assert index.leaks(changed) == {} or min(index.leaks(changed)[1][1:]) >= decontam.OVERLAP
    for at in range(0, 300, 7):  # wherever passages are cut
        assert set(index.leaks(" ".join(NOISE.split()[:at]) + " " + QA[1][1] + " " + NOISE)) == {2}


def test_edges(spark):
    index = decontam.build_indexes(spark.createDataFrame([*QA, (2, QA[1][1]), (None, "x y"), (4, None), (5, "?!")], "item_id long, text string"))
    rows = [(1, None), (2, ""), (3, "?"), (4, QA[1][1]), (4, QA[1][1]), (None, QA[1][1]), (5, (NOISE + " ") * 50 + QA[1][1])]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, dc_text string")
    got = [(r["key"], r["item_id"]) for r in decontam.find_leaks(docs, index).collect()]
    assert sorted(got, key=str) == [(4, 2), (4, 2), (5, 2), (None, 2)]
    kept = decontam.drop_contaminated(docs, index)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontam.find_leaks(docs.limit(0), index).count() == 0
    none = decontam.build_indexes(spark.createDataFrame([], "item_id long, text string"))
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.drop_contaminated(docs, none).count() == len(rows)


def test_several_indexes_find_the_same(spark):
    rng = random.Random(9)
    bench = spark.createDataFrame(items(rng, 40, 5000), "item_id long, text string")
    docs = spark.createDataFrame([(r["item_id"], f"{NOISE} {r['text']} {NOISE}") for r in bench.collect()], "doc_id long, text string")
    many = decontam.build_indexes(bench, index_chars=500)
    assert len(many) > 2
    pairs = lambda ix: {(r["key"], r["item_id"]) for r in decontam.find_leaks(docs, ix).collect()}
    assert pairs(many) >= {(i, i) for i in range(40)} and pairs(decontam.build_indexes(bench)) >= {(i, i) for i in range(40)}
