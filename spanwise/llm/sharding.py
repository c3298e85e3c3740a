"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Each shard has its own permutation of the slots of a table of prime size: an offset and
a step from its name's hash. The shards take turns; each claims the next slot of its
permutation that is free, until all are claimed. So shards own equal numbers of slots to
within one, and adding or losing a shard moves few slots. A key is placed by the shard at
``hash(key) mod size``: the table has ``size`` rows whatever the input, so its broadcast
is bounded by a parameter, and placement is a lookup without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import fresh

N_SHARDS = 16
TABLE_SIZE = 2039
#: A table beyond this is refused: it is broadcast.
MAX_TABLE = 1_000_003


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that owns each slot. ``size`` must be prime, and 1 to MAX_TABLE."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be non-empty and distinct")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE}")
    at = [_digest(f"{s}:offset") % size for s in shards]
    step = [_digest(f"{s}:skip") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % size
        owner[at[i]] = i
    return owner


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of MD5 over its text, modulo the table's size. Null is a key like any other."""
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) as a plan of built-in functions over one literal."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def assign_shards(df: DataFrame, keys: list[str], shards: list[str] | None = None, size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard", spread: list[str] | None = None, spread_ways: int = 8) -> DataFrame:
    """``df`` with the slot and the shard of each row; every row stays.

    Equal keys share a shard. If one key may hold a large part of the rows, name columns
    in ``spread``: their hash splits each key over up to ``spread_ways`` shards.
    Null keys are placed together; repeated rows get the same shard; an empty table stays
    empty; columns of ``df`` named like the results are replaced, all others stay, whatever their names;
    very long keys are hashed whole.
    """
    shards = shards or [f"shard-{i}" for i in range(N_SHARDS)]
    parts = [F.col(k) for k in keys]
    if spread:
        parts.append(F.pmod(F.xxhash64(*(F.col(c) for c in spread)), F.lit(spread_ways)))
    s, t, here = fresh(df, "place_slot", "place_shard", "place_slot_of")
    table = table_frame(df.sparkSession, shards, size).toDF(s, t)
    out = df.withColumn(here, slot_of(*parts, size=size)).join(F.broadcast(table), F.col(here) == F.col(s))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot.lower(), shard.lower())), F.col(s).alias(slot), F.col(t).alias(shard))


ORACLE = f"""
WITH RECURSIVE s AS (
  SELECT CAST(i AS INT) AS i, ('0x' || substr(md5('shard-' || i || ':offset'), 1, 15))::BIGINT % {TABLE_SIZE} AS o,
    ('0x' || substr(md5('shard-' || i || ':skip'), 1, 15))::BIGINT % {TABLE_SIZE - 1} + 1 AS k FROM range({N_SHARDS}) r(i)),
p AS (SELECT i, list(CAST((o + j * k) % {TABLE_SIZE} AS INT) ORDER BY j) AS slots FROM s, range({TABLE_SIZE}) q(j) GROUP BY i),
f AS (
  SELECT 0 AS turn, CAST(repeat('0', {TABLE_SIZE}) AS BIT) AS taken, -1 AS slot
  UNION ALL
  SELECT turn + 1, set_bit(taken, m, 1), m
  FROM (SELECT f.turn, f.taken, list_filter(p.slots, lambda x: get_bit(f.taken, x) = 0)[1] AS m FROM f JOIN p ON p.i = f.turn % {N_SHARDS}
        WHERE f.turn < {TABLE_SIZE}))
SELECT d.doc_id, CAST(f.slot AS BIGINT) AS slot, CAST((f.turn - 1) % {N_SHARDS} AS INT) AS shard
FROM documents d JOIN f ON f.turn > 0 AND f.slot = ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 15))::BIGINT % {TABLE_SIZE}
"""
