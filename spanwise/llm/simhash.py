"""SimHash near-dedup by tiled exact comparison.

Every text gets a 64-bit fingerprint. Equal fingerprints are folded first, by one
aggregate. The distinct ones fall into cells by the population counts of their
``segments`` parts of 64/segments bits; two fingerprints within ``radius`` bits have
counts that differ by ``radius`` in sum at most, so a tile of one cell is compared only
with tiles of cells that near, and all other pairs of tiles are skipped. Each fingerprint
goes to its own cell and to the near cells of larger number; there numpy compares tiles by
exclusive-or and bit counts, exactly. More segments mean smaller cells and fewer
comparisons for more copies of a row: their number follows the number of fingerprints.

A cell of more than ``tile`` fingerprints is dealt out as pairs of its tiles, so no task
holds more than one tile and a block of visitors. A tile pair emits a spanning forest of
its links and not the links, so a large group of near copies gives as many rows as it has
members for each tile pair. Components of those forests are found by ``components``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .runtime import as_batches, fresh, materialise, utf8

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a tile.
TILE = 8192


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, ``shingle`` words to a shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), SEED)]
    else:
        flat = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
        hashes = [h(flat[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1 :])]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text`` and with the fingerprint as a signed long. Null and wordless texts get 0."""
    keep = [c for c in docs.columns if c not in (text, out)]
    (t,) = fresh(docs, "sh_text")
    src = docs.select(*(F.col(f"`{c}`") for c in keep), utf8(text).alias(t))
    schema = T.StructType([*(f for f in src.schema.fields if f.name in keep), T.StructField(out, T.LongType())])

    def run(batches):
        for b in batches:
            fp = [_signed(fingerprint(x.as_py(), shingle)) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp, pa.int64())], names=[*keep, out])

    return src.mapInArrow(run, schema)


def _near_cells(segments: int, radius: int) -> list[tuple[int, ...]]:
    """The differences of counts within ``radius`` in sum whose first non-zero one is positive."""
    out = []

    def grow(head: tuple[int, ...], left: int):
        if len(head) == segments:
            if next((x for x in head if x), 0) > 0:
                out.append(head)
            return
        for d in range(-left, left + 1):
            grow((*head, d), left - abs(d))

    grow((), radius)
    return out


def choose_segments(n: int) -> int:
    """Parts that a fingerprint is counted in, for ``n`` distinct ones: cells stay near a tile's size."""
    return 4 if n < 20_000_000 else 8 if n < 20_000_000_000 else 16


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over all links between tiles ``a`` and ``b``, or within ``a``.

    Blocks of the tiles tell which fingerprints have a link at all; a search over those
    then visits each once, so a tile of near copies costs no more than one without links.
    """
    linked = []
    for at in range(0, len(a), 32):
        rows = a[at : at + 32]
        right = a[at:] if b is None else b
        near = np.bitwise_count(rows[:, None] ^ right[None, :]) <= radius
        if b is None:
            np.fill_diagonal(near, False)
        if near.any():
            linked += [rows[near.any(axis=1)], right[near.any(axis=0)]]
    if not linked:
        return
    rest = np.unique(np.concatenate(linked))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                stack.extend(found)
                yield from ((int(x), int(y)) for y in found)


def near_links(distinct: DataFrame, fp: str = "fingerprint", radius: int = RADIUS, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints whose components are those of all links within ``radius`` bits."""
    n = distinct.count() if segments is None else 0
    s = segments or choose_segments(n)
    width = 64 // s
    mask = (1 << width) - 1
    base = width + 1 + 2 * radius
    src = distinct.select(F.col(fp).cast("long").alias("fp"))
    digits = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(_signed(mask)).cast("long"))) for i in range(s)]
    number = F.lit(0).cast("long")
    for d in digits:
        number = number * base + (d + radius)
    cells = src.select("fp", number.alias("cell"))
    steps = []
    for diff in _near_cells(s, radius):
        step = 0
        for d in diff:
            step = step * base + d
        steps.append(step)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).select(F.col("cell").alias("home"), F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    visits = cells.select("fp", F.explode(F.array(*(F.lit(x).cast("long") for x in [0, *sorted(steps)]))).alias("step"), "cell").select("fp", (F.col("cell") + F.col("step")).alias("home"), (F.col("step") == 0).alias("own"))
    placed = visits.join(sizes, "home").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # A resident's tile meets the later tiles of its cell; a visitor meets every tile of the cell.
    unit = F.when(F.col("own"), F.concat(F.array(F.struct(F.col("tile").alias("t"), F.lit(True).alias("home"))), F.transform(F.sequence(F.lit(0), F.col("tile")), lambda t: F.struct(t.alias("t"), F.lit(False).alias("home"))))).otherwise(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("t"), F.lit(False).alias("home"))))
    dealt = placed.select("fp", F.col("home").alias("cell"), "tile", "own", F.explode(unit).alias("u")).where(F.col("u.home") | ~F.col("own") | (F.col("u.t") < F.col("tile"))).select("cell", F.col("u.t").alias("tile"), (~F.col("u.home")).alias("visitor"), "fp")
    dealt = dealt.repartition(F.col("cell"), F.col("tile")).sortWithinPartitions("cell", "tile", "visitor", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, home = None, []
            for b in batches:
                cell, tl, vis, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                f = f.astype(np.int64).view(np.uint64)
                cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(tl) != 0) | (np.diff(vis.astype(np.int8)) != 0)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(f)]):
                    if hi == lo:
                        continue
                    key = (cell[lo], tl[lo])
                    if key != now:
                        if now is not None:
                            yield from _forest(np.concatenate(home), None, radius) if home else ()
                        now, home = key, []
                    if vis[lo]:
                        if home:
                            yield from _forest(f[lo:hi], np.concatenate(home), radius)
                    else:
                        home.append(f[lo:hi])
            if home:
                yield from _forest(np.concatenate(home), None, radius)

        signed = ((_signed(x), _signed(y)) for x, y in rows())
        return as_batches(schema, signed)

    return dealt.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, component): ``fingerprint`` as 16 lowercase hexadecimal digits, ``component`` the
    smallest key reachable over links of ``radius`` or fewer differing bits, a row's own included.

    One result row for each input row. Null, empty and wordless texts have fingerprint 0 and
    link like any other; very long ones are read whole, their shingles summed some at a time;
    repeated rows have equal fingerprints; other columns do not matter; null keys stay and never name a component unless all are null;
    an empty table gives an empty result. ``key`` must be of an integer type.
    """
    fps = materialise(fingerprints(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text", "fp", shingle), "fingerprints")
    folded = materialise(fps.groupBy("fp").agg(F.min("key").alias("low")), "folded")
    comp = components(near_links(folded, "fp", radius))
    roots = folded.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = roots.groupBy("root").agg(F.min("low").alias("component"))
    labels = roots.join(lows, "root").select("fp", "component")
    return fps.join(labels, "fp").select("key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")
