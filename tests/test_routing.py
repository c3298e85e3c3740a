"""Shortest paths by rounds against searches from each source."""

import heapq
import math
import random
from hashlib import md5

import pytest

from spanwise.operators import routing


def search(edges, src):
    """{node: (dist, links)}, of equal edges that of the least link."""
    dist, heap = {}, [(0.0, src)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d
            for u, v, c, _ in edges:
                if u == n and v not in dist:
                    heapq.heappush(heap, (d + c, v))
    back = {v: min((link, u) for u, w, c, link in edges if w == v and u in dist and dist[u] + c == dist[v]) for v in dist if v != src}
    out = {}
    for n in sorted(dist, key=dist.get):
        out[n] = (dist[n], [] if n == src else [*out[back[n][1]][1], back[n][0]])
    return out


def graph(seed, n=25, m=70):
    rng = random.Random(seed)
    return [(a, b, float(rng.randint(1, 6)), i) for i, (a, b) in enumerate((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]


@pytest.mark.parametrize("seed", range(2))
def test_paths(spark, seed):
    e = graph(seed) + [(100 + i, 101 + i, 1.0, 1000 + i) for i in range(30)]
    pairs = [(s, t) for s in (0, 3, 7) for t in range(25)] + [(100, 130), (100, 105), (130, 100), (0, 0), (0, 5), (555, 0)]
    df = spark.createDataFrame([*e, (None, 3, 1.0, 9), (3, 3, -1.0, 8)], "u long, v long, cost double, link_id long")
    got = {(r["src"], r["dst"]): (r["dist"], r["links"]) for r in routing.paths(df, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    exp = {}
    for s, t in set(pairs):
        found = search([x for x in e], s)
        if t in found:
            exp[s, t] = found[t]
    assert got == exp and len(got[100, 130][1]) == 30


def test_costs_must_be_positive(spark):
    for c in (0.0, -1.0, None, math.nan):
        with pytest.raises(ValueError):
            routing.paths(spark.createDataFrame([(1, 2, c, 1)], "u long, v long, cost double, link_id long"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    none = spark.createDataFrame([], "u long, v long, cost double, link_id long")
    assert routing.paths(none, spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def drawn(k, link, seed=42):
    a, b = (int(md5(f"{k}|{link}|{x}|{seed}".encode()).hexdigest()[:12], 16) / 2**48 for x in "ab")
    return math.sqrt(-2 * math.log(1 - a)) * math.cos(2 * math.pi * b)


def incidence(e, pairs, passes, variation, sigma, most):
    hits, cost = {}, {x[3]: x[2] for x in e}
    for k in range(passes):
        moved = [(u, v, c * math.exp(variation * drawn(k, i) * sigma / (sigma + variation * c)), i) for u, v, c, i in e]
        for s, t in pairs:
            found = search(moved, s)
            if t in found and t != s:
                links = found[t][1] if len(found[t][1]) <= most else search(e, s)[t][1]
                for i in links:
                    hits[s, t, i] = hits.get((s, t, i), 0) + 1
    dist = {}
    for (s, t, i), n in hits.items():
        dist[s, t] = dist.get((s, t), 0) + n * cost[i] / passes
    return {k: (n / passes, pytest.approx(dist[k[:2]])) for k, n in hits.items()}


@pytest.mark.parametrize(("variation", "most"), [(0.5, 120), (0.5, 2), (0.0, 120)])
def test_passes(spark, variation, most):
    e = graph(5, 15, 45)
    pairs = [(s, t) for s in (0, 1) for t in range(15)]
    df = spark.createDataFrame(e, "u long, v long, cost double, link_id long")
    got = routing.probit_incidence(df, spark.createDataFrame(pairs, "src long, dst long"), 3, variation, 4.0, most)
    assert {(r["src"], r["dst"], r["link"]): (r["weight"], r["dist"]) for r in got.collect()} == incidence(e, pairs, 3, variation, 4.0, most)


def test_edges_out_of_reach_are_left_out(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, 0), (3, 2, 1.0, 1), (3, 4, 2.0, 2), (8, 9, 1.0, 3), (9, 10, 1.0, 4)], "u long, v long, cost double, link_id long")
    starts = spark.createDataFrame([(2,), (3,), (50,)], "src long")
    kept = routing.within_reach(edges, starts)
    assert sorted(r["link_id"] for r in kept.collect()) == [0, 1, 2]
    found = lambda e: sorted(map(tuple, routing.distances(routing.clean_edges(e), starts).collect()))
    assert found(kept) == found(edges) == [(2, 2, 0.0), (3, 2, 1.0), (3, 3, 0.0), (3, 4, 2.0), (50, 50, 0.0)]
