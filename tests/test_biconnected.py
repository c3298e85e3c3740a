"""Cut nodes and regions against removing each node in turn."""

import random

import pytest

from spanwise.operators import biconnected


def brute(edges, gates=None):
    """{(gate, entry): nodes} of every part that a gate cuts off; gates are all cut nodes unless given."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for g in near:
        left, parts = set(near[g]), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x] - {g}
            left -= seen
            parts.append(seen)
        if len(parts) > 1 if gates is None else g in gates:
            out |= {(g, min(p & near[g])): p for p in parts}
    return out


def check(spark, edges, protected=(), gates=None):
    df = spark.createDataFrame(edges, "u long, v long")
    held = spark.createDataFrame([(p,) for p in protected], "node long")
    layers = spark.createDataFrame([(n, n * 0.5) for n in {x for e in edges for x in e if x is not None}] or [(0, 0.0)], "node long, w double")
    found = biconnected.blocks(df, held, layers, ["w"])
    parts = biconnected.regions(found, None if gates is None else spark.createDataFrame([(g,) for g in gates], "node long"), ["w"])
    got = {(r["gate"], r["entry"]): (r["n"], r["protected"], r["w"]) for r in parts.collect()}
    exp = brute(edges, gates)
    assert got == {k: (len(p), len(p & set(protected)), pytest.approx(sum(p) * 0.5)) for k, p in exp.items()}
    nodes = {}
    for r in biconnected.region_nodes(found, parts).collect():
        nodes.setdefault((r["gate"], r["entry"]), []).append(r["node"])
    assert {k: sorted(x) for k, x in nodes.items()} == {k: sorted(p) for k, p in exp.items()}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range([58, 110][seed])]
    edges += [(100 + i, 100 + rng.randrange(i)) for i in range(1, 25)] + [(200, 201), (201, 202), (202, 200), (202, 203)]
    check(spark, edges, rng.sample(range(n), 3) + [105])


def test_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(30)]
    loop = [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(203, 300), (300, 301)]
    check(spark, chain + star + loop + [(5, 5), (None, 3), (7, None), (41, 40), (40, 41)], [20, 100, 205, 999])


def test_given_gates_need_not_cut(spark):
    check(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], [1], gates=[1, 3, 5, 77])


def test_empty(spark):
    none = spark.createDataFrame([], "u long, v long")
    found = biconnected.blocks(none, spark.createDataFrame([], "node long"))
    assert biconnected.regions(found).count() == 0 and biconnected.region_nodes(found, biconnected.regions(found)).count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    n, calls = 700, []

    def cut(df):
        from spanwise.sources.sinks import cut_lineage

        calls.append(1)
        return cut_lineage(df)

    chain = spark.range(n).select(F_hash("id").alias("u"), F_hash("id", 1).alias("v"))
    found = biconnected.blocks(chain, spark.createDataFrame([], "node long"), cut=cut)
    parts = biconnected.regions(found)
    assert parts.count() == 2 * (n - 1) and parts.agg({"n": "sum"}).first()[0] == (n - 1) * n
    assert len(calls) < 120


def F_hash(column, add=0):
    """Node names in no order along the chain."""
    from pyspark.sql import functions as F

    return ((F.col(column) + add) * 7919) % 1_000_003


def test_small_components_are_searched_in_tasks(spark):
    from spanwise.sources.sinks import cut_lineage

    rng, calls = random.Random(5), []
    edges = [(100 * c + rng.randrange(9), 100 * c + rng.randrange(9)) for c in range(30) for _ in range(10)] + [(9000 + i, 9001 + i) for i in range(40)]
    df, held = spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(3,), (9020,)], "node long")
    layers = df.selectExpr("u as node", "v * 0.5d as w")
    parts = []
    for small in (100_000, 15):  # with 15 the chain goes by rounds
        found = biconnected.blocks(df, held, layers, ["w"], cut=lambda x: calls.append(1) or cut_lineage(x), small=small)
        assert small == 15 or len(calls) < 10
        parts.append(sorted((r["gate"], r["entry"], r["n"], r["protected"], round(r["w"], 6)) for r in biconnected.regions(found, sums=["w"]).collect()))
    assert parts[0] == parts[1] and {p[:2] for p in parts[0]} == set(brute(edges))


def members_of(ways, protected):
    """(edges, members) of ways, lists of nodes that are paths, or cycles if they end where they began."""
    edges = [(w, a, b) for w, way in enumerate(ways) for a, b in zip(way, way[1:])]
    return edges, [(w, n, n in protected and w % 2 == 0) for w, way in enumerate(ways) for n in way]


def wanted(edges, held):
    return {k: p for k, p in brute([e[1:] for e in edges]).items() if not p & held}


@pytest.mark.parametrize("small", [100_000, 12, 0])
def test_unprotected_nodes_of_ways(spark, small):
    rng = random.Random(11)
    ways = [[60 * c + rng.randrange(45) for _ in range(rng.randrange(1, 5))] for c in range(8) for _ in range(14)]
    ways += [[1000 + i for i in range(9)], [1003, 1003], [1008, 1000], [1008, 1020, 1021], [2000, *range(2001, 2030)]]
    ways += [[3000, 3000 + i] for i in range(1, 20)] + [[4000, 4001, 4002, 4000], [4002, 4003], [4003, 4004, 4005, 4003], [5000]]
    edges, members = members_of(ways, {5, 17, 61, 130, 200, 310, 311, 1004, 3000, 5000, 4004})
    held = {n for _, n, p in members if p}
    found = biconnected.unprotected_nodes(spark.createDataFrame(edges, "way long, u long, v long"), spark.createDataFrame([*members, (3, None, True)], "way long, node long, protected boolean"), small=small)
    got = {}
    for r in found.collect():
        got.setdefault((r["gate"], r["entry"]), []).append(r["node"])
    assert {k: sorted(p) for k, p in got.items()} == {k: sorted(p) for k, p in wanted(edges, held).items()}


def test_unprotected_nodes_of_nothing(spark):
    none = spark.createDataFrame([], "way long, u long, v long"), spark.createDataFrame([], "way long, node long, protected boolean")
    assert biconnected.unprotected_nodes(*none).count() == 0


def test_a_long_chain_and_a_hub_in_one_task():
    chain = {i: {i - 1, i + 1} - {-1, 400} for i in range(400)}
    assert sum(len(p) for _, _, p in biconnected._cut_off(chain, set())) == 398 * 399
    assert [(g, e) for g, e, _ in biconnected._cut_off(chain, {200})] and sum(len(p) for *_, p in biconnected._cut_off(chain, {200})) == sum(range(1, 200)) + sum(range(1, 199)) + 399
    star = {0: set(range(1, 20_001))} | {i: {0} for i in range(1, 20_001)}
    assert len(list(biconnected._cut_off(star, {7}))) == 19_999


def test_nodes_of_regions_are_not_shuffled(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["cut_region_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
