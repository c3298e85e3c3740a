"""Connected components of a table of edges, in DataFrame operations.

Alternating large-star and small-star rounds: each connects every node's neighbours with
the smallest of them, until the edges are stars around each component's smallest node.
The number of rounds grows with the logarithm of the edges. A round is two minima by node
(with map-side partial minima) and joins with them, so no node's neighbours are gathered;
joins on a hub are left to adaptive skew splitting. Each round is written to the shared
folder, which cuts the lineage, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    joined = both.join(low, F.col("a") == F.col("n"))
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (long columns a and b) and the smallest node of its component.

    Loops and repeated edges don't matter; edges with a null are left out; no edges give
    an empty table. Raises RuntimeError if it has not settled in MAX_ROUNDS rounds.
    """
    e = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        last, e = e, materialise(_star(_star(e, True), False), "edges")
        discard(last)
        # A sum of hashes tells whether the edges changed, in one aggregate without sorting.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
