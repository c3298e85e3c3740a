"""Near copies at a wide radius: sketches, cells and whole results."""

import random

import numpy as np
import pytest

from spanwise.llm import near_copies
from spanwise.llm.components import components


def distance(a, b):
    return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())


def test_fingerprints_by_the_definition():
    text = b"One two THREE four five six seven eight one two three four five"
    words = text.lower().split()
    h = [near_copies.xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)]
    bits = 0
    for j, odd in enumerate(near_copies._ODD.tolist()):
        mixed = [(y := x * odd % 2**64) ^ (y >> 32) for x in h]
        for b in range(64):
            if 2 * sum(x >> b & 1 for x in mixed) > len(h):
                bits |= 1 << (64 * j + b)
    fp, bands = near_copies.sketch(text)
    assert int.from_bytes(fp, "little") == bits and len(bands) == near_copies.BANDS
    assert near_copies.sketch(b" \n") == near_copies.sketch(b"") and near_copies.sketch(b"A b") == near_copies.sketch(b"a  B")
    assert near_copies.sketch(b"x " * 4000)[0] == near_copies.sketch(b"x x x x x")[0]


def test_the_radius_tells_similar_texts():
    rng = random.Random(3)
    for _ in range(150):
        w = [f"w{rng.randrange(9000)}" for _ in range(200)]
        u = list(w)
        for _ in range(rng.randrange(20)):
            u[rng.randrange(200)] = f"other{rng.randrange(9000)}"
        a, b = " ".join(w).encode(), " ".join(u).encode()
        x, y = (set(near_copies.shingle_hashes(t).tolist()) for t in (a, b))
        jaccard = len(x & y) / len(x | y)
        (f, p), (g, q) = near_copies.sketch(a), near_copies.sketch(b)
        if jaccard >= 0.88:
            assert distance(f, g) <= near_copies.radius_of(0.8) and set(p) & set(q)
        if jaccard <= 0.7:
            assert distance(f, g) > near_copies.radius_of(0.8)


def slow_groups(cells, fps, radius):
    label = {i: i for i in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for own in cells.values():
        for i in own:
            for j in own:
                if i < j and distance(fps[i], fps[j]) <= radius:
                    label[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in fps}


@pytest.mark.parametrize(("tile", "shared"), [(4096, 256), (5, 2), (3, 1), (8, 0)])
def test_any_tiling_gives_the_groups_of_all_links(spark, tile, shared):
    rng = random.Random(tile)
    fps, cells = {}, {c: [] for c in range(6)}
    for g in range(14):
        x = bytearray(rng.randbytes(near_copies.BITS // 8))
        for _ in range(rng.choice([1, 2, 9])):
            for _ in range(rng.randrange(40)):  # chains: members drift apart
                x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
            i = len(fps)
            fps[i] = bytes(x)
            for c in rng.sample(range(6), rng.choice([1, 2, 3])):
                cells[c].append(i)
    df = spark.createDataFrame([(c, i, bytearray(fps[i])) for c, own in cells.items() for i in own], "cell long, id long, fp binary").repartition(3)
    got = {r["node"]: r["root"] for r in components(near_copies.cell_links(df, 25, tile, shared)).collect()}
    assert {i: got.get(i, i) for i in fps} == slow_groups(cells, fps, 25)


def test_a_large_group_gives_few_links(spark):
    rng = random.Random(1)
    base = rng.randbytes(near_copies.BITS // 8)
    rows = []
    for i in range(300):
        x = bytearray(base)
        x[i % len(x)] ^= 1 << rng.randrange(8)
        rows.append((7, i, x))
    links = near_copies.cell_links(spark.createDataFrame(rows, "cell long, id long, fp binary"), 30, 20, 12)
    assert links.count() < 6 * 300 and components(links).count() == 300


def variants(rng, n):
    """Pairs of texts of every similarity around the bound, and what their index is."""
    rows = []
    for g in range(n):
        w = [f"w{rng.randrange(30_000)}" for _ in range(rng.randrange(40, 200))]
        u = list(w)
        for _ in range(rng.randrange(1, max(2, len(w) // 30))):
            u[rng.randrange(len(u))] = f"o{rng.randrange(30_000)}"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(u))]
    return rows


def test_links_are_those_of_the_exact_index(spark):
    rng = random.Random(12)
    rows = variants(rng, 400)
    shingles = [set(near_copies.shingle_hashes(t.encode()).tolist()) for _, t in rows]
    close = {2 * g: len(shingles[2 * g] & shingles[2 * g + 1]) / len(shingles[2 * g] | shingles[2 * g + 1]) for g in range(400)}
    assert sum(0.75 <= x < 0.8 for x in close.values()) > 10 < sum(0.8 <= x < 0.85 for x in close.values())
    got = {r["key"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    merged = {k for k in close if got[k + 1] == k}
    assert not {k for k in merged if close[k] < 0.8}
    above = {k for k, x in close.items() if x >= 0.8}
    assert len(merged) >= 0.98 * len(above)


def test_texts_of_one_template(spark):
    """All share most words and no pair is similar enough; small tiles, so that the rest is compared too."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for j in rng.sample(range(120), 5):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 250, 10)]
    shingles = {k: set(near_copies.shingle_hashes(t.encode()).tolist()) for k, t in rows}
    pairs = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    label = {k: k for k in shingles}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(find(a), find(b))] = min(find(a), find(b))
    exp = {k: find(k) for k in shingles}
    assert len(set(exp.values())) > 100
    for tile in (near_copies.TILE, 40):
        got = {r["key"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
        wrong = {k for k in got if got[k] != exp[k]}
        assert not {k for k in got if k >= 1000 and got[k] != got[k - 1000]} and len(wrong) <= 0.02 * len(exp)


def test_no_link_is_left_out(spark):
    """Repeats move a fingerprint and not a set, so no tile proposes these pairs; nor all those of one template."""
    rng = random.Random(3)
    rows = []
    for g in range(30):
        w = [f"w{rng.randrange(30_000)}" for _ in range(100)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w) + f" r{g}" * 900)]
    base = [f"t{i}" for i in range(120)]
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(120), 3):
            w[j] = f"x{rng.randrange(3)}"
        rows.append((1000 + i, " ".join(w)))
    shingles = {k: set(near_copies.shingle_hashes(t.encode()).tolist()) for k, t in rows}
    label = {k: k for k in shingles}
    for _ in label:
        before = dict(label)
        for a in shingles:
            for b in shingles:
                if a < b and label[a] != label[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert all(label[2 * g + 1] == 2 * g for g in range(30)) and len({x for x in label.values() if x >= 1000}) > 1
    got = {r["key"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), tile=40).collect()}
    assert got == label


def test_edges(spark):
    long = "the quick brown fox jumps over a lazy dog and then some more words follow it here " * 8
    rows = [(5, None), (3, ""), (4, " "), (9, "One two"), (8, "one  TWO"), (7, "one three"), (11, long), (10, long + "end"), (12, long), (12, long), (None, long), (None, "alone in the world with no key"), (20, "word " * 200_000), (21, "word " * 190_000)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r["key"], r["component"]) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (9, 8), (8, 8), (7, 7), (11, 10), (10, 10), (12, 10), (12, 10), (None, 10), (None, None), (20, 20), (21, 20)], key=str)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """Long texts of which three hold one passage: it is rare and so among the first shingles, yet no set of two goes to a join."""
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    rows = [(3 * g + k, " ".join([*(f"w{rng.randrange(10**7)}" for _ in range(3000)), passages[g]])) for g in range(8) for k in range(3)]
    rows.append((100, rows[0][1] + " one more"))
    seen, real = [], near_copies.rest_of_links
    monkeypatch.setattr(near_copies, "rest_of_links", lambda *a: seen.append(out := real(*a)) or out)
    got = {r["key"]: r["component"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k == 100 else k for k, _ in rows}
    assert [x.count() for x in seen] == [0]


def test_bounds_lose_no_pair(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows, none = [], (np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in [*range(1, 40), *rng.integers(40, 9000, 60).tolist()]:
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for lost, more in [(0, n // 4), (n // 5, 0), (n // 9, n // 9), (n // 3, n // 3)]:
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[lost:]], rng.integers(0, 1 << 63, more, np.uint64))))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            met = len(np.intersect1d(near_copies.first_shingles(a, 0.8, none), near_copies.first_shingles(b, 0.8, none)))
            fine = [near_copies.fine_parities(x).tolist() for x in (a, b)]
            rows.append((len(a), len(b), both, either, met, *fine))
    df = spark.createDataFrame(rows, "a long, b long, both long, either long, met long, fa array<long>, fb array<long>")
    differ = near_copies.fine_difference(F.col("fa"), F.col("fb"))
    least, may = near_copies.least_met(F.col("a"), F.col("b"), 0.8), near_copies.may_be_alike(differ, F.col("a"), F.col("b"), 0.8)
    out = df.select("a", "both", "either", "met", least.alias("least"), differ.alias("differ"), may.alias("may")).collect()
    alike = [r for r in out if 5 * r["both"] >= 4 * r["either"]]
    assert len(alike) > 200 and all(r["met"] >= r["least"] >= 1 and r["may"] for r in alike)
    assert all(r["differ"] <= r["either"] - r["both"] for r in out)
    assert not any(r["may"] for r in out if 2 * r["both"] < 1.1 * r["either"] and r["a"] > 400)


def test_texts_that_are_not_wanted_are_not_shuffled(spark):
    rows = spark.createDataFrame([(k, b"x") for k in [*range(2000), None]], "key long, body binary")
    wanted = spark.createDataFrame([(5,), (1999,), (5,), (None,), (7777,)], "low long")
    got = [r["key"] for r in near_copies.likely(rows, "key", wanted, "low").collect()]
    assert {5, 1999, None} <= set(got) and len(got) < 6
    assert len(near_copies.likely(rows, "key", wanted, "low", 64).collect()) < 300
    assert near_copies.likely(rows, "key", wanted.limit(0), "low").count() == 0


def test_sets_that_share_a_shingle_but_are_not_alike_do_not_pair(spark):
    """300 sets of 100 hashes share one; two of them share 95. Only these pair, once for each shared first shingle."""
    rng = np.random.default_rng(3)
    sets = [np.append(rng.integers(1, 1 << 62, 99, np.uint64), np.uint64(7)) for _ in range(300)]
    sets[1] = np.concatenate((sets[0][5:], rng.integers(1, 1 << 62, 5, np.uint64)))
    nodes = spark.createDataFrame([(i, near_copies.parities(s).tolist()) for i, s in enumerate(sets)], "id long, odd array<long>")
    met = spark.createDataFrame([(i, i, len(s), 7) for i, s in enumerate(sets)] + [(i, i, 100, 8) for i in (0, 1)], "id long, root long, size long, h long")
    assert list(map(tuple, near_copies.meetings(met, nodes, 0.8).collect())) == [(0, 1, 100, 100)] * 2
