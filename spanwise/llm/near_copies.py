"""Near copies: SimHash tiles propose links, sets of shingles decide on them.

Two texts whose sets of five-word shingles have a Jaccard index of 0.8 differ in some 15 % of
the bits of their SimHash. Within so many bits population counts of parts tell no tiles
apart, so tiles are gathered otherwise: each text has ``BANDS`` hashes of ``ROWS`` min-hashes
of its shingles, and texts that share one lie in a cell (a pair of Jaccard 0.8 shares none
with probability 0.0004). In a cell fingerprints of ``BITS`` bits are compared exactly by
exclusive-or and bit counts, skipping those whose population counts differ beyond the radius.

The bits only estimate the index, to within some 0.03, so they propose and do not decide.
Within a near radius (the index is hardly below 0.8) a spanning forest is proposed; between there and
a far radius (the index is hardly above it) each text's ``NEAREST`` nearest texts of other trees; and
each text's nearest one of all. Every proposed pair is then decided by the exact index of its
sets of shingles, by joins, for the texts that have a pair at all. So nothing below the bound
is merged.

What the proposals leave out is found exactly (``rest_of_links``). In one order of all shingles, two sets of that
index share one of their first ones, as many as either may lack and one more. So sets of different groups
that share such a shingle are paired, those go that share too few of them for that index (``least_met``) or of which sizes or
parities show that more shingles differ than may, and the exact index decides again. The order puts shingles that are frequent in a sample of the texts last; it settles how many pairs
are looked at, and not which are found. Groups of one shingle's sets cost no pairs.

Texts of equal sets are folded first. A cell of more than ``TILE`` fingerprints is cut into
tiles that all hold some ``SHARED`` fingerprints of the cell in common, through which the
members of a large group meet. What is not in the cell's largest group then is the rest; it
is compared with the whole cell, in tiles of ``REST`` fingerprints. Any near link that was missed has an end in the rest,
so the groups are those of all near links, and a cell full of near copies costs no pairs of tiles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import as_batches, discard, fresh, materialise, utf8

SHINGLE = 5
SIMILARITY = 0.8
BITS = 1024
BANDS, ROWS = 20, 5
TILE = 4096
REST = 65536
SHARED = 256
#: How far below and above the wanted index an estimate may lie, and nearest texts of other trees that are proposed.
MARGIN = 0.06
NEAREST = 3
#: Texts whose shingles are counted for the order, or that share of all if these are more, so that what is not frequent is in a bounded
#: number of texts; in how many of them a shingle is frequent, and so many at most.
ORDER_TEXTS, ORDER_SHARE, FREQUENT, MOST_FREQUENT = 8192, 1 / 32, 4, 200_000
#: Words of parities that go with each first shingle, folded: sets of up to some thousand hashes that are not alike differ in enough of them.
MEETING_WORDS = 8
#: Bits that tell which texts may be wanted again.
FILTER_BITS = 1 << 24
SEED = 42

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_MIN = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits expected of two texts with equal numbers of shingles and that Jaccard index."""
    return math.floor(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, repeats included; A-Z are lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(flat, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    return np.fromiter((h(flat[a:b], SEED) for a, b in zip(itertools.chain((0,), (e + 1 for e in ends)), ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1)


def sketch(text: bytes, shingle: int = SHINGLE) -> tuple[bytes, list[int]]:
    """(fingerprint, bands). A wordless text has the fingerprint zero and bands of its own kind."""
    return sketch_of(shingle_hashes(text, shingle))


def sketch_of(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """``sketch`` of a text's hashes."""
    if not len(hashes):
        return bytes(BITS // 8), list(range(BANDS))
    total = np.zeros(BITS, np.int64)
    low = np.full(len(_MIN), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 255):  # so many bits add up in a byte
        part = hashes[at : at + 255]
        x = part[:, None] * _ODD
        x ^= x >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        np.minimum(low, (_MIN[:, None] * part).min(axis=1), out=low)
    bands = low.view(np.uint8).reshape(BANDS, ROWS * 8)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def digest(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The set of shingles, in order, and its 128-bit hash."""
    own = np.unique(hashes)
    return own, xxhash.xxh3_128_digest(own.tobytes(), SEED)


def first_shingles(own: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a set its rarest shingles by (hashes, counts), so many that each set of that index with it shares one of them."""
    hashes, counts = frequent
    seen = np.zeros(len(own), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        seen = np.where(hashes[at] == own, counts[at], 0)
    return own[np.lexsort((own, seen))][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def least_met(size_a: Column, size_b: Column, similarity: float) -> Column:
    """How many first shingles two sets of these sizes and that index share at least.

    They share ``both`` shingles or more. The k-th of these in the order has all later ones behind it in either set, so it
    stands at ``size - both + k`` at the latest, which is among the first ones up to this k.
    """
    both = F.ceil(F.lit(similarity / (1 + similarity)) * (size_a + size_b) - F.lit(1e-6))
    return both - F.ceil(F.lit(similarity) * F.greatest(size_a, size_b) - F.lit(1e-9)) + 1


def parities(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Of ``bits`` parts of all hashes, whether a set has an odd number in each: two sets differ by as many hashes at least as parts."""
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1, bitorder="little").view(np.int64)


def fine_parities(own: np.ndarray) -> np.ndarray:
    """``parities`` in twice as many parts as the set has hashes, or more: large sets that are not alike differ in those too."""
    return parities(own, 1 << max(BITS - 1, 2 * len(own) - 1).bit_length())


def fine_difference(a: Column, b: Column) -> Column:
    """In how many parts two ``fine_parities`` differ; the longer one is folded, as its parts are parts of the shorter one's."""
    words = F.least(F.size(a), F.size(b))

    def folded(x: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(x) - 1, words), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(x, k)))

    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda acc, i: acc + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))


def may_be_alike(differ: Column, size_a: Column, size_b: Column, similarity: float) -> Column:
    """Whether sets of these sizes that differ by so many hashes at least may have that index."""
    like = F.least(size_a, size_b) >= F.lit(similarity) * F.greatest(size_a, size_b) - F.lit(1e-9)
    return like & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (size_a + size_b) + F.lit(1e-6))


def _distances(fps: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ x).sum(axis=1, dtype=np.int64)


def forest(ids: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over all links among these fingerprints; each is visited once."""
    counts = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.lexsort((ids, counts))  # so that those of a like population count lie together
    ids, fps, counts = ids[order], fps[order], counts[order]
    while len(ids):
        # From the smallest id, so that cells of the same texts have the same links.
        first = int(ids.argmin())
        stack = [(ids[first], fps[first], counts[first])]
        ids, fps, counts = np.delete(ids, first), np.delete(fps, first, axis=0), np.delete(counts, first)
        while stack and len(ids):
            i, x, n = stack.pop()
            lo, hi = np.searchsorted(counts, (n - radius, n + radius + 1))
            near = lo + np.flatnonzero(np.bitwise_count(fps[lo:hi] ^ x).sum(axis=1, dtype=np.int64) <= radius)
            if len(near):
                stack += list(zip(ids[near], fps[near], counts[near]))
                yield from ((int(i), int(j)) for j in ids[near])
                keep = np.ones(len(ids), bool)
                keep[near] = False
                ids, fps, counts = ids[keep], fps[keep], counts[keep]


def outside(ids: np.ndarray, fps: np.ndarray, links: list[tuple[int, int]], far: int, nearest: int = NEAREST) -> Iterator[tuple[int, int]]:
    """Each text's nearest one, and its nearest ones of other trees of ``links``, all within ``far``."""
    place = {int(i): k for k, i in enumerate(ids)}
    tree = np.arange(len(ids))
    for i, j in links:  # a forest, whose links come from each tree's root outwards
        tree[place[j]] = tree[place[i]]
    counts = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.lexsort((ids, counts))
    sorted_counts = counts[order]
    for k in range(len(ids)):
        lo, hi = np.searchsorted(sorted_counts, (counts[k] - far, counts[k] + far + 1))
        near = order[lo:hi]
        d = _distances(fps[near], fps[k])
        d[near == k] = far + 1
        near, d = near[d <= far], d[d <= far]
        if not len(near):
            continue
        yield int(ids[k]), int(ids[near[np.lexsort((ids[near], d))[0]]])
        other = tree[near] != tree[k]
        near, d = near[other], d[other]
        for m in near[np.lexsort((ids[near], d))[:nearest]].tolist():
            yield int(ids[k]), int(ids[m])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where rows of equal columns begin and end."""
    n = len(columns[0])
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1 if n > 1 else []
    yield from zip([0, *cuts], [*cuts, n])


def _link_tiles(batches: Iterator[pa.RecordBatch], radius: int, far: int | None) -> Iterator[pa.RecordBatch]:
    """(cell, tile, id, fp) rows, sorted, to links within each tile, and with ``far`` to proposals beyond the radius."""

    def rows():
        now, held = None, []

        def flush():
            ids, fps = np.concatenate([i for i, _ in held]), np.concatenate([f for _, f in held])
            links = list(forest(ids, fps, radius))
            yield from links
            if far is not None:
                yield from outside(ids, fps, links, far)

        for b in batches:
            if not b.num_rows:
                continue
            cell, tile, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = _matrix(b.column(3))
            for lo, hi in _runs(cell, tile):
                if (cell[lo], tile[lo]) != now:
                    if held:
                        yield from flush()
                    now, held = (cell[lo], tile[lo]), []
                held.append((ids[lo:hi], fps[lo:hi]))
        if held:
            yield from flush()

    return as_batches(_LINKS, rows())


def _link_rest(batches: Iterator[pa.RecordBatch], radius: int, far: int | None) -> Iterator[pa.RecordBatch]:
    """(cell, tile, visitor, id, root, fp) rows, sorted: links of each of a tile's own rows to one visitor of each group
    within the radius, and with ``far`` to its nearest visitors of other groups."""

    def rows():
        now, held, home, best = None, [], None, None

        def proposals():
            if best is not None:
                for i, (d, who) in zip(home[0].tolist(), zip(*best)):
                    yield from ((i, int(w)) for x, w in zip(d, who) if x <= far)

        for b in batches:
            if not b.num_rows:
                continue
            cell, tile, visitor, ids, roots = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            fps = _matrix(b.column(5))
            for lo, hi in _runs(cell, tile, visitor.astype(np.int8)):
                if (cell[lo], tile[lo]) != now:
                    yield from proposals()
                    now, held, home, best = (cell[lo], tile[lo]), [], None, None
                if not visitor[lo]:
                    held.append((ids[lo:hi], roots[lo:hi], fps[lo:hi]))
                    continue
                if home is None:
                    home = tuple(np.concatenate(x) for x in zip(*held))
                    best = (np.full((len(home[0]), NEAREST), BITS + 1), np.zeros((len(home[0]), NEAREST), np.int64)) if far is not None else None
                for k, (i, r, x) in enumerate(zip(*home)):
                    d = _distances(fps[lo:hi], x)
                    other = roots[lo:hi] != r
                    near = np.flatnonzero((d <= radius) & other)
                    first = np.unique(roots[lo:hi][near], return_index=True)[1]
                    yield from ((int(i), int(j)) for j in ids[lo:hi][near[first]])
                    if best is not None and len(some := np.flatnonzero(other & (d <= far) & (d < best[0][k, -1]))):
                        all_d, all_i = np.concatenate((best[0][k], d[some])), np.concatenate((best[1][k], ids[lo:hi][some]))
                        order = np.lexsort((all_i, all_d))[:NEAREST]
                        best[0][k], best[1][k] = all_d[order], all_i[order]
        yield from proposals()

    return as_batches(_LINKS, rows())


def cell_links(members: DataFrame, radius: int, tile: int = TILE, shared: int = SHARED, far: int | None = None, rest: int = REST) -> DataFrame:
    """Links (a, b) among (cell, id, fp) rows, whose components are those of all links of ``radius`` bits within cells.

    With ``far``, pairs of up to so many bits are added: each row's nearest ones, a few for each row and tile.
    """
    sizes = members.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    placed = members.join(sizes, F.col("cell") == F.col("of"))
    draw = F.xxhash64("id", "cell")
    every = (F.col("tiles") > 1) & (F.pmod(draw, F.col("size")) < shared)
    at = F.when(every, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64(draw), F.col("tiles")).cast("int")))
    dealt = placed.select("cell", F.explode(at).alias("tile"), "id", "fp").repartition("cell", "tile").sortWithinPartitions("cell", "tile")
    links = materialise(dealt.mapInArrow(lambda x: _link_tiles(x, radius, far), "a long, b long"), "links")
    hot = placed.where("tiles > 1").select("cell", "id", "fp")
    if not hot.limit(1).count():
        return links
    groups = components(links).withColumnRenamed("node", "n")
    labelled = materialise(hot.join(groups, F.col("id") == F.col("n"), "left").select("cell", "id", F.coalesce("root", "id").alias("root"), "fp"), "labelled")
    main = labelled.groupBy("cell", "root").agg(F.count("*").alias("size")).groupBy(F.col("cell").alias("of")).agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("total"))
    rest_tiles = main.where("total > top.size").select("of", F.col("top.root").alias("top"), F.ceil((F.col("total") - F.col("top.size")) / max(rest, tile)).cast("int").alias("tiles"))
    seen = labelled.join(rest_tiles, F.col("cell") == F.col("of"))
    own = seen.where(F.col("root") != F.col("top")).select("cell", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), F.lit(False).alias("visitor"), "id", "root", "fp")
    all_ = seen.select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("visitor"), "id", "root", "fp")
    late = own.unionByName(all_).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "visitor")
    return links.unionByName(late.mapInArrow(lambda x: _link_rest(x, radius, far), "a long, b long"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(key, component): ``component`` is the smallest key of the row's group of near copies, its own if it has none.

    Texts link whose sets of shingles have a Jaccard index of ``similarity`` or more. A row for each
    input row. Null, empty and wordless texts are copies of each other; texts of fewer words
    than a shingle are near copies of equal ones only; very long ones are read whole; repeated
    rows are copies; null keys stay and name a group only if all its keys are null; an empty
    table gives an empty result; other columns do not matter. ``key`` must be an integer.
    """
    src = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("body"))
    schema = pa.schema([("key", pa.int64()), ("fp", pa.binary()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("size", pa.int64()), ("odd", pa.list_(pa.int64())), ("first", pa.list_(pa.int64()))])
    frequent = src.sparkSession.sparkContext.broadcast(frequent_shingles(src, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                    hashes = shingle_hashes(t.as_py(), shingle)
                    fp, bands = sketch_of(hashes)
                    own, name = digest(hashes)
                    yield k, fp, name, bands, len(own), parities(own), first_shingles(own, similarity, frequent.value).view(np.int64)

        return as_batches(schema, rows(), 1024)

    sketches = materialise(src.mapInArrow(run, "key long, fp binary, digest binary, bands array<long>, size long, odd array<long>, first array<long>"), "sketches")
    folded = sketches.groupBy("digest").agg(F.min("key").alias("low"), F.min("bands").alias("bands"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("odd").alias("odd"))
    nodes = materialise(folded.select(F.monotonically_increasing_id().alias("id"), "digest", "fp", "low", "bands", "size", "odd"), "nodes")
    # Cells of one member have no links; fingerprints go to the others only.
    places = nodes.select("id", F.explode("bands").alias("cell"))
    several = places.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of")
    kept = places.join(several, F.col("cell") == F.col("of"), "left_semi")
    members = materialise(kept.join(nodes.select(F.col("id").alias("i"), "fp"), F.col("id") == F.col("i")).select("cell", "id", "fp"), "members")
    near, far = radius_of(min(1.0, similarity + MARGIN)), radius_of(max(0.0, similarity - MARGIN))
    proposed = cell_links(members, near, tile, far=far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = decided(src, nodes, materialise(proposed, "proposed"), similarity, shingle)
    discard(members)
    more = rest_of_links(sketches, nodes, components(links), similarity)
    groups = components(links.unionByName(decided(src, nodes, more, similarity, shingle)))
    roots = nodes.join(groups, F.col("id") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "id").alias("root"))
    lows = roots.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    labels = roots.join(lows, F.col("root") == F.col("r")).select("digest", "component")
    return sketches.join(labels, "digest").select("key", "component")


def frequent_shingles(src: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), sorted, of shingles that are frequent in some of the texts (key, body)."""
    share = max(ORDER_TEXTS / max(src.count(), ORDER_TEXTS), ORDER_SHARE)
    some = src.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((digest(shingle_hashes(t.as_py(), shingle))[0].view(np.int64),) for b in batches for t in b.column(0))
        return as_batches(pa.schema([("set", pa.list_(pa.int64()))]), rows, 256)

    counts = some.distinct().mapInArrow(run, "set array<long>").select(F.explode("set").alias("h")).groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["count"].to_numpy(np.int64)[order]


def rest_of_links(sketches: DataFrame, nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different groups (node, root), among them all of that index."""
    placed = nodes.join(groups, F.col("id") == F.col("node"), "left").select(F.col("digest").alias("d"), "low", "id", F.coalesce("root", "id").alias("root"), "size")
    # Any row of a node has its shingles; rows of one key and text are few.
    one_each = sketches.select("key", "digest", "first").join(placed, (F.col("digest") == F.col("d")) & F.col("key").eqNullSafe(F.col("low")))
    own = one_each.select("id", "root", "size", F.explode("first").alias("h"))
    same = Window.partitionBy("h")
    met = materialise(own.withColumn("_low", F.min("root").over(same)).withColumn("_high", F.max("root").over(same)).where("_low < _high").drop("_low", "_high"), "met")
    met_by = meetings(met, nodes, similarity).groupBy("id_a", "id_b", "size_a", "size_b").agg(F.count("*").alias("met"))
    pairs = met_by.where(F.col("met") >= least_met(F.col("size_a"), F.col("size_b"), similarity)).select("id_a", "id_b")
    a, b = (nodes.select(F.col("id").alias(f"id_{c}"), F.col("size").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    differ = sum((F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    may = may_be_alike(differ, F.col("n_a"), F.col("n_b"), similarity)
    more = materialise(pairs.join(a, "id_a").join(b, "id_b").where(may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "more")
    discard(met)
    return more


def meetings(met: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of (id, root, size, h) rows the pairs (id_a, id_b, size_a, size_b) of different roots, a row for each h that both have.

    Pairs that sizes or ``MEETING_WORDS`` words of parities show to be below that index are left out as they meet.
    """
    words = BITS // 64
    folds = [reduce(Column.bitwiseXOR, (F.get("odd", F.lit(i)) for i in range(w, words, MEETING_WORDS))).alias(f"odd{w}") for w in range(MEETING_WORDS)]
    seen = met.join(nodes.select(F.col("id").alias("n"), *folds), F.col("id") == F.col("n")).drop("n")
    one, other = (seen.select("h", *(F.col(k).alias(f"{k}_{c}") for k in seen.columns if k != "h")) for c in "ab")
    differ = sum((F.bit_count(F.col(f"odd{w}_a").bitwiseXOR(F.col(f"odd{w}_b"))) for w in range(MEETING_WORDS)), F.lit(0))
    may = may_be_alike(differ, F.col("size_a"), F.col("size_b"), similarity)
    return one.join(other, "h").where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & may).select("id_a", "id_b", "size_a", "size_b")


def decided(src: DataFrame, nodes: DataFrame, proposed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Of the proposed links (a, b) between nodes (id, digest, low) those whose sets of shingles are that similar.

    Sets are made again from the texts (key, body) of the nodes that have a link, one text for each; the other texts
    are not shuffled.
    """
    linked = proposed.select(F.col("a").alias("n")).unionByName(proposed.select(F.col("b").alias("n"))).distinct()
    wanted = nodes.join(linked, F.col("id") == F.col("n"), "left_semi").select("id", F.col("digest").alias("own"), "low")
    wanted = materialise(wanted, "wanted")
    texts = likely(src, "key", wanted, "low").join(wanted, F.col("key").eqNullSafe(F.col("low"))).select("id", "own", "body")
    schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64())), ("fine", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, own, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    found, name = digest(shingle_hashes(t.as_py(), shingle))
                    if name == own:  # another text of the same key otherwise
                        yield i, found.view(np.int64), fine_parities(found)

        return as_batches(schema, rows(), 256)

    sets = materialise(texts.mapInArrow(run, "id long, set array<long>, fine array<long>").dropDuplicates(["id"]), "sets")
    # Whole sets go only to the pairs whose parities allow for the index.
    one, other = (sets.select(F.col("id").alias(f"i{c}"), F.col("fine").alias(f"f{c}"), F.size("set").alias(f"n{c}")) for c in "ab")
    close = proposed.join(one, F.col("a") == F.col("ia")).join(other, F.col("b") == F.col("ib"))
    close = materialise(close.where(may_be_alike(fine_difference(F.col("fa"), F.col("fb")), F.col("na"), F.col("nb"), similarity)).select("a", "b"), "close")
    one, other = (sets.select(F.col("id").alias(f"i{c}"), F.col("set").alias(f"s{c}")) for c in "ab")
    both = close.join(one, F.col("a") == F.col("ia")).join(other, F.col("b") == F.col("ib"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = materialise(both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "decided")
    discard(sets)
    discard(wanted)
    return links


def likely(rows: DataFrame, key: str, wanted: DataFrame, low: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be one of ``low``: all that are, and few others, so that a join after it moves few texts.

    A broadcast of ``bits`` bits, in words of 64, holds one bit for each hash that occurs; nulls count as a value.
    """
    word, bit = fresh(rows, "_word", "_bits")
    slot = {k: F.pmod(F.xxhash64(k), F.lit(bits)) for k in (key, low)}
    one = {k: F.call_function("shiftleft", F.lit(1).cast("long"), (slot[k] % 64).cast("int")) for k in slot}
    held = wanted.groupBy(F.floor(slot[low] / 64).alias(word)).agg(F.bit_or(one[low]).alias(bit))
    return rows.join(F.broadcast(held), F.floor(slot[key] / 64) == F.col(word)).where(F.col(bit).bitwiseAND(one[key]) != 0).select(*rows.columns)
