import random

import pytest
import xxhash

from spanwise.llm import simhash
from spanwise.llm.components import components


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [(k, slow_fingerprint(t)) for k, t in rows]
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                label[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted((-1 if k is None else k, f"{fp:016x}", low.get(find(i))) for i, (k, fp) in enumerate(fps))


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Ärger", "X", "THE"]
    rows = []
    for i in range(60):
        t = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 80, 300]))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(t)))
        if len(t) > 50:
            for c in range(3):
                u = list(t)
                u[rng.randrange(len(u))] = "changed"
                rows.append((i * 3 + 1000 * (c + 1), " ".join(u)))
    return [*rows, (500, None), (501, ""), (502, " \n "), (7, "one two three four"), (7, "one two three four"), (None, "one two three four"), (8, " nbsp stays")]


@pytest.mark.parametrize("text", ["", None, " ", "One", "one TWO", "a b c", "a b c d", "Ä ß X Y z", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_components(df).collect()
    assert sorted((-1 if r["key"] is None else r["key"], r["fingerprint"], r["component"]) for r in got) == slow_components(rows)


@pytest.mark.parametrize(("segments", "tile"), [(1, 8192), (2, 7), (4, 3), (8, 50), (16, 8192)])
def test_any_tiling_gives_the_same_groups(spark, segments, tile):
    rng = random.Random(segments)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, (1 << 64) - 1}
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                label[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fingerprint long")
    links = simhash.near_links(df, segments=segments, tile=tile)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    group = lambda f: root.get(signed(f), signed(f))
    mine, theirs = {}, {}
    for f in fps:
        mine.setdefault(group(f), set()).add(f)
        theirs.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (7, 6), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_near_copies_gives_few_links(spark):
    base = random.Random(1).getrandbits(63)
    near = {base ^ (1 << i) for i in range(60)} | {base}
    df = spark.createDataFrame([(f,) for f in near], "fingerprint long")
    assert simhash.near_links(df, segments=1).count() < 3 * len(near)
