"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to ``DIMENSIONS`` numbers by one fixed Gaussian (2-stable) matrix.
The squared projected distance of two vectors, over their squared distance, is then
chi-square distributed with that many degrees of freedom. A kd-tree holds the projections
of a block of vectors; for a query, projected neighbours come in order of distance and are
verified by their exact distance, until the chi-square test holds: a vector as near as the
k-th best so far would have been projected nearer than the next one with probability
``CONFIDENCE``. So work follows the data, and no number of candidates is fixed.

Rows are dealt out to blocks of about ``BLOCK`` vectors, each indexed whole by one task.
Blocks are regions of the projected space, cut by the upper levels of a kd-tree over a
bounded sample of vectors; a region with more rows, such as one that holds very many equal
vectors, is split by id. The sample also gives each query an upper bound of its k-th
distance, and by the same chi-square test the query goes to the regions that can hold one
as near, and to no others. A block and a stream of queries bound a task's memory. The k best
of each block are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_batches, materialise

DIMENSIONS = 8
CONFIDENCE = 0.95
LEAF = 128
BLOCK = 8192
#: Vectors in the sample that cuts the regions, at least and at most, and regions at most. Beyond
#: REGIONS * BLOCK vectors a block grows, up to MAX_BLOCK, before regions are split by id.
SAMPLE, MAX_SAMPLE = 4096, 16384
REGIONS = 4096
MAX_BLOCK = 65536
K = 10
SEED = 20240229


def projection(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed matrix of standard normal numbers for vectors of ``size`` components."""
    return np.random.default_rng([SEED, size]).standard_normal((size, dimensions))


def chi_square_cdf(x: float, dimensions: int) -> float:
    """P(X <= x) for an even number of degrees of freedom, in closed form."""
    if x <= 0:
        return 0.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dimensions // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_quantile(p: float, dimensions: int) -> float:
    lo, hi = 0.0, 10_000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dimensions) < p else (lo, mid)
    return hi


class KdTree:
    """A balanced kd-tree over projected points; nodes keep their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        if len(points):
            self._build(0, len(points), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        own = self.points[self.order[a:b]]
        at = len(self.span)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.span.append((a, b))
        self.children.append(None)
        if b - a > leaf:
            axis = int((self.high[at] - self.low[at]).argmax())
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            self.children[at] = (self._build(a, a + mid, leaf), self._build(a + mid, b, leaf))
        return at

    def _gap(self, node: int, q: np.ndarray) -> float:
        d = np.maximum(self.low[node] - q, 0) + np.maximum(q - self.high[node], 0)
        return float(d @ d)

    def incremental(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Positions of points in batches, each with the least squared distance of all points not yet given."""
        heap = [(self._gap(0, q), 0)] if self.span else []
        while heap:
            _, node = heapq.heappop(heap)
            if (two := self.children[node]) is not None:
                for c in two:
                    heapq.heappush(heap, (self._gap(c, q), c))
                continue
            a, b = self.span[node]
            yield self.order[a:b], heap[0][0] if heap else math.inf


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero or has a null or non-finite component."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


class Block:
    """An index of vectors of one size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE):
        self.ids, self.vectors = ids, vectors
        self.matrix = projection(vectors.shape[1], dimensions)
        self.tree = KdTree(vectors @ self.matrix)
        self.limit = chi_square_quantile(confidence, dimensions)

    def nearest(self, query_id: int, query: np.ndarray, k: int = K, bound: float = math.inf) -> list[tuple[float, int]]:
        """(distance, id) of the ``k`` nearest found, those of equal distance by id; rows of the query's own id are left out.

        ``bound`` is an upper bound of the k-th distance that is known already.
        """
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        for at, rest in self.tree.incremental(query @ self.matrix):
            d = self.vectors[at] - query
            d = np.sqrt((d * d).sum(axis=1))
            i = self.ids[at]
            own = i != query_id
            best_d, best_i = np.concatenate((best_d, d[own])), np.concatenate((best_i, i[own]))
            if len(best_d) > k:
                keep = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[keep], best_i[keep]
            # Equal distances count, so ties at distance zero are all seen.
            worst = min(bound, float(best_d.max()) if len(best_d) == k else math.inf)
            if rest > self.limit * worst**2:
                break
        order = np.lexsort((best_i, best_d))
        return [(float(best_d[j]), int(best_i[j])) for j in order]


class Regions:
    """Half-open boxes that cut the projected space, from a sample of it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, n: int, dimensions: int, confidence: float):
        self.matrix = projection(vectors.shape[1], dimensions)
        self.vectors, self.ids = vectors, ids
        self.limit = chi_square_quantile(confidence, dimensions)
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut and children; a leaf has axis -1 and its number
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self._cut(vectors @ self.matrix, n, np.full(dimensions, -np.inf), np.full(dimensions, np.inf))

    def _cut(self, points: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(len(low))
        axis = int(spread.argmax())
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        below = points[:, axis] < cut
        if n < 2 or spread[axis] <= 0 or not below.any():
            self.nodes[at] = (-1, 0.0, len(self.low), 0)
            self.low.append(low)
            self.high.append(high)
            return at
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = cut
        a = self._cut(points[below], n // 2, low, left)
        b = self._cut(points[~below], n - n // 2, right, high)
        self.nodes[at] = (axis, cut, a, b)
        return at

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        points = vectors @ self.matrix
        out = np.empty(len(points), np.int32)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            axis, cut, a, b = self.nodes[at]
            if axis < 0:
                out[rows] = a
            elif len(rows):
                below = points[rows, axis] < cut
                stack += [(a, rows[below]), (b, rows[~below])]
        return out

    def reach(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Regions that may hold one of the ``k`` nearest, and an upper bound of the k-th distance."""
        d = np.sqrt(((self.vectors - query) ** 2).sum(axis=1))[self.ids != query_id]
        bound = float(np.partition(d, k - 1)[k - 1]) if len(d) >= k else math.inf
        q = query @ self.matrix
        gap = np.maximum(np.array(self.low) - q, 0) + np.maximum(q - np.array(self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= self.limit * bound**2), bound


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_size(batch: pa.RecordBatch, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of a batch by the size of their vectors."""
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, batch.take(pa.array(rows))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): each query's ``k`` nearest vectors but its own id, by Euclidean distance.

    Null, empty and zero vectors and those with a null or non-finite component take no part
    on either side, nor do null ids. A query meets vectors of its own size only. With fewer
    than ``k`` candidates all are returned; equal distances go by the smaller id; repeated
    rows of a candidate count as one, as do repeated rows of a query. Queries of one id and
    different vectors are ranked each by itself; candidates of one id and different vectors
    may take a rank each. ``dimensions`` must be even. Other columns do not matter. An empty
    table on either side gives an empty result.
    """
    if dimensions % 2 or dimensions < 2:
        raise ValueError("dimensions must be even")
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        ok = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
        return df.where(ok).select(F.col(key).cast("long").alias("id"), v.alias("v"))

    held, asked = clean(vectors), clean(queries).dropDuplicates(["id", "v"])
    total = held.count()
    block = min(max(block, math.ceil(total / REGIONS)), max(block, MAX_BLOCK))
    n_sample = min(MAX_SAMPLE, max(SAMPLE, 8 * math.ceil(total / block)))
    sample: dict[int, dict[int, list[float]]] = {}
    for r in held.orderBy(F.xxhash64("id"), "id").limit(n_sample).collect():
        sample.setdefault(len(r["v"]), {}).setdefault(r["id"], r["v"])
    size = sum(map(len, sample.values()))
    regions = {d: Regions(np.array(list(x.values())), np.array(list(x), np.int64), min(REGIONS, math.ceil(total / block * len(x) / size)), dimensions, confidence) for d, x in sample.items()}
    shared = spark.sparkContext.broadcast(regions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, part in _by_size(b, np.diff(b.column(1).offsets.to_numpy())):
                own = shared.value.get(dim)
                at = own.of(_matrix(part.column(1), dim)) if own else np.zeros(len(rows), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), dim, np.int32)), pa.array(at)], names=["id", "v", "dim", "region"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, part in _by_size(b, np.diff(b.column(1).offsets.to_numpy())):
                own = shared.value.get(dim)
                for at in range(0, len(rows), 256):
                    some = part.slice(at, 256)
                    goals = [own.reach(i, q, k) if own else (np.zeros(1, np.int64), math.inf) for i, q in zip(some.column(0).to_pylist(), _matrix(some.column(1), dim))]
                    out = some.take(pa.array(np.repeat(np.arange(len(goals)), [len(g) for g, _ in goals])))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, dim, np.int32)), pa.array(np.concatenate([g for g, _ in goals]).astype(np.int32)), pa.array(np.repeat([x for _, x in goals], [len(g) for g, _ in goals]))], names=["id", "v", "which", "dim", "region", "bound"])

    asked = asked.withColumn("which", F.xxhash64("v"))  # tells queries of one id apart
    data = materialise(held.mapInArrow(place, "id long, v array<double>, dim int, region int"), "vectors")
    # At most REGIONS rows for each size of vector.
    parts = data.groupBy("dim", "region").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    aimed = asked.mapInArrow(aim, "id long, v array<double>, which long, dim int, region int, bound double").join(parts, ["dim", "region"])
    rows_ = data.join(parts, ["dim", "region"]).select("dim", "region", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("double").alias("bound"), "id", "v", F.lit(0).cast("long").alias("which"))
    spread = aimed.select("dim", "region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "bound", "id", "v", "which")
    n_tasks = max(1, math.ceil(total / block))
    dealt = rows_.unionByName(spread).repartition(n_tasks, "dim", "region", "part").sortWithinPartitions("dim", "region", "part", F.col("bound").isNotNull(), "id")
    schema = pa.schema([("query_id", pa.int64()), ("which", pa.int64()), ("vec", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, ids, blocks, index = None, [], [], None
            for b in batches:
                dim, region, part = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                bound, ident, lists, which = b.column(3).to_pylist(), b.column(4).to_numpy(zero_copy_only=False), b.column(5), b.column(6).to_pylist()
                is_query = np.array([x is not None for x in bound])
                cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(region) != 0) | (np.diff(part) != 0) | np.diff(is_query)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(dim)]):
                    if hi == lo:
                        continue
                    if (dim[lo], region[lo], part[lo]) != now:
                        now, ids, blocks, index = (dim[lo], region[lo], part[lo]), [], [], None
                    x = _matrix(lists.slice(lo, hi - lo), int(dim[lo]))
                    if not is_query[lo]:
                        ids.append(ident[lo:hi])
                        blocks.append(x)
                        continue
                    if index is None and ids:
                        all_ids, all_rows = np.concatenate(ids), np.concatenate(blocks)
                        first = np.arange(len(all_ids))
                        if len(np.unique(all_ids)) < len(all_ids):
                            bytes_ = np.column_stack((all_ids.view(np.uint8).reshape(len(all_ids), 8), np.ascontiguousarray(all_rows).view(np.uint8).reshape(len(all_ids), -1)))
                            _, first = np.unique(bytes_, axis=0, return_index=True)
                        index = Block(all_ids[first], all_rows[first], dimensions, confidence)
                    if index is not None:
                        for q, v, most, w in zip(ident[lo:hi].tolist(), x, bound[lo:hi], which[lo:hi]):
                            for d, i in index.nearest(q, v, k, most):
                                yield q, w, i, d

        return as_batches(schema, rows())

    found = dealt.mapInArrow(run, "query_id long, which long, vec long, score double")
    # A row for each query, block and neighbour: k for each block, merged by a sorted list of the k best.
    best = found.groupBy("query_id", "which").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec").alias(key), F.col("x.score").alias("score"))
