"""Embedding whitening by a one-sided Jacobi decomposition of a tall table's triangular factor.

Vectors are first put on a grid (``floor(scale * entry)``, whole numbers), and the fit sees
each different grid vector once, so that copies do not weigh. Sums are exact. Each task then
centres its rows and folds them, a block at a time, into one triangular factor R by QR;
a tree of tasks stacks FAN factors at a time and folds again until one d x d factor is left,
whose Gram matrix is that of all centred rows. No covariance is ever formed: plane rotations
make R's columns orthogonal on the driver, their lengths are the standard deviations (times
the root of n), to full relative accuracy, and the accumulated rotations are the components.

What reaches the driver is d sums, one d x d factor and k x k products; a task holds one
block and one factor. The one shuffle that grows with the input is that of the different
vectors, pre-aggregated where they are read, so a vector that a third of all rows share is
one row of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, fresh, materialise

SCALE = 256
COMPONENTS = 4
#: Rows folded into a factor at a time, and factors that a task of the tree stacks.
BLOCK = 4096
FAN = 8
#: Relative size of a product of two columns that counts as orthogonal, and sweeps at most.
ORTHOGONAL, SWEEPS = 1e-15, 60


@dataclass
class Whitening:
    """n different vectors with sums ``sums`` (exact); ``directions`` (d x d) has a unit component in each column, by falling ``deviation``."""

    n: int
    sums: list[int]
    directions: np.ndarray
    deviation: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def kept(self, k: int) -> np.ndarray:
        """Which of the first ``k`` components vary at all, beyond rounding."""
        return self.deviation[:k] > self.deviation[0] * len(self.sums) * np.finfo(float).eps

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows on the grid as ``k`` whitened coordinates; not a number where a component does not vary."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.kept(k), (x - self.mean) @ self.directions[:, :k] / self.deviation[:k], np.nan)

    def explained(self) -> np.ndarray:
        """Each component's share of the whole variance."""
        e = self.deviation**2
        return e / e.sum() if e.sum() > 0 else np.full(len(e), np.nan)


def on_grid(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, grid): rows whose vector is present, not empty, and has only present, finite entries whose grid value is a long."""
    v = F.col(vector).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= float(2**63))
    (grid,) = fresh(vectors.select(key), "grid")
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd)).select(key, F.transform(v, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias(grid))


def _rows(column: pa.ListArray, dtype=np.int64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    if len(x) and float(np.abs(x.astype(float)).max()) * len(x) >= 2.0**62:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def _triangle(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if held is None else np.vstack((held, rows)), mode="r")


def _factor(df: DataFrame, centre: np.ndarray | None) -> DataFrame:
    """One factor for each task: the rows of the only column of ``df``, less ``centre``, folded block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = None, [], 0
        for b in batches:
            x = _rows(b.column(0), float)
            x = x if centre is None else x - centre
            for at in range(0, len(x), BLOCK):
                held.append(x[at : at + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    r, held, n = _triangle(r, np.vstack(held)), [], 0
        if n:
            r = _triangle(r, np.vstack(held))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["row"])

    return df.mapInArrow(run, "row array<double>")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V, lengths): rotations V (d x d) that make the columns of ``r @ V`` orthogonal, and these columns' lengths, falling.

    Columns are paired by a round robin, so that each round turns d/2 separate pairs at once.
    """
    d = r.shape[1]
    a, v = np.ascontiguousarray(r.T, dtype=float), np.eye(d)
    ring = np.arange(d + d % 2)  # one place stays empty where d is odd
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            ap, aq = a[p], a[q]
            alpha, beta, gamma = (ap * ap).sum(axis=1), (aq * aq).sum(axis=1), (ap * aq).sum(axis=1)
            todo = np.abs(gamma) > ORTHOGONAL * np.sqrt(alpha * beta)
            if todo.any():
                turned = True
                p, q, ap, aq = p[todo], q[todo], ap[todo], aq[todo]
                with np.errstate(over="ignore"):  # an infinite one turns by nothing
                    zeta = (beta[todo] - alpha[todo]) / (2 * gamma[todo])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                c, s = c[:, None], s[:, None]
                a[p], a[q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[p], v[q]
                v[p], v[q] = c * vp - s * vq, s * vp + c * vq
            ring = np.concatenate((ring[:1], np.roll(ring[1:], 1)))
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    return v[order].T, lengths[order]


def fit(points: DataFrame) -> Whitening | None:
    """The whitening of a materialised table whose only column holds vectors on the grid, each once; None if it is empty.

    Vectors must be of one length; ValueError if they are not.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            sizes = np.diff(b.column(0).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                x = _rows(b.column(0).take(pa.array(np.flatnonzero(sizes == d))))
                n, s = found.get(d, (0, 0))
                found[d] = (n + len(x), s + _exact_sums(x))
        rows = [(d, i, n, Decimal(int(v))) for d, (n, s) in found.items() for i, v in enumerate(s)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], names=["d", "i", "n", "s"])

    ddl = "d int, i int, n long, s decimal(38,0)"
    totals = points.mapInArrow(sums, ddl).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("d", "i").collect()
    if not totals:
        return None
    if len({t["d"] for t in totals}) > 1:
        raise ValueError(f"vectors of {sorted({t['d'] for t in totals})} entries; all must be equally long")
    n, total = totals[0]["n"], [int(t["s"]) for t in totals]
    d = len(total)
    centre = np.array([s / n for s in total])
    r = materialise(_factor(points, centre), "factors")
    # A task of the tree gets FAN factors of d rows; a factor of fewer rows than columns is stacked like any other.
    while (rows := r.count()) > FAN * d:
        smaller = materialise(_factor(r.repartition(-(-rows // (FAN * d))), None), "factors")
        discard(r)
        r = smaller
    last = np.array([x["row"] for x in _factor(r.repartition(1), None).collect()], float).reshape(-1, d)
    discard(r)
    directions, lengths = jacobi(last)
    return Whitening(n, total, directions, lengths / np.sqrt(n))


def identity_error(points: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest absolute entry of the whitened points' covariance less the identity, over the components that vary; None if none does."""
    kept = np.flatnonzero(model.kept(k))
    if not len(kept):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept) + 1, len(kept) + 1))
        for b in batches:
            w = model.whiten(_rows(b.column(0)), k)[:, kept]
            w = np.column_stack((w, np.ones(len(w))))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    sums = points.mapInArrow(products, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    m = np.array([x["v"] for x in sums]).reshape(len(kept) + 1, -1) / model.n
    mean = m[-1, :-1]
    return float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(len(kept))).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n x - S)^2 for each row, exact; None where that is beyond a long."""
    most = n * float(np.abs(x.astype(float)).max()) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in out]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each vector's first ``components`` whitened coordinates.

    Vectors that are null, empty, or hold a null or non-finite entry (or one whose grid value is
    no long) take no part. The rest must be of one length. Null keys and repeated rows stay,
    each with rows of its own, while the fit counts equal vectors once. A vector of fewer
    entries than ``components`` has as many components as entries. Where a component does
    not vary, as with a single vector, ``whitened`` is null and the identity error leaves it
    out; ``explained`` is null if nothing varies at all. A deviation beyond a long is null. Equal
    variances may come in any order. An empty table gives an empty result; other columns do
    not matter, whatever their names.
    """
    rows = on_grid(vectors, key, vector, scale)
    grid = rows.columns[-1]
    points = materialise(rows.select(grid).distinct(), "points")
    model = fit(points)
    kind = rows.schema[key].dataType.simpleString()
    ddl = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], ddl + ", identity_error double")
    k = min(components, len(model.sums))
    error = identity_error(points, model, k)
    discard(points)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        share = [None if np.isnan(v) else float(v) for v in model.explained()[:k]]
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b.column(1))
            m, w = len(x), model.whiten(x, k).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array([v for v in _deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(share * m, pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, ddl).withColumn("identity_error", F.lit(error).cast("double"))
