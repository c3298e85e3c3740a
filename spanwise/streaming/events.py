"""Structured Streaming forms of the observation pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import day_type


def read_events(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A file stream: what has been read once is not read again."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def dedupe(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Each key once among rows that arrive within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def hourly(stream: DataFrame, ts: str, by: Sequence[str], value: Column, delay: str | None = "1 hour") -> DataFrame:
    """(by, slot, day_type, hour, n, total) by tumbling hour."""
    if delay and stream.isStreaming:
        stream = stream.withWatermark(ts, delay)
    w = F.window(ts, "1 hour")
    out = stream.groupBy(*by, w.alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    start = F.col("_w.start")
    return out.select(*by, start.alias("slot"), day_type(start).alias("day_type"), F.hour(start).alias("hour"), "n", "total")


def sessions(stream: DataFrame, ts: str, by: Sequence[str], gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """(by, start, end, n): runs of events no further apart than the gap."""
    if delay and stream.isStreaming:
        stream = stream.withWatermark(ts, delay)
    w = F.session_window(ts, gap)
    return stream.groupBy(*by, w.alias("_w")).agg(F.count("*").alias("n")).select(*by, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def thin(stream: DataFrame, ts: str, by: Sequence[str], every: str = "20 seconds", delay: str | None = "10 minutes") -> DataFrame:
    """The first row of each key in each interval."""
    if delay and stream.isStreaming:
        stream = stream.withWatermark(ts, delay)
    rest = [c for c in stream.columns if c not in by]
    return stream.groupBy(*by, F.window(ts, every)).agg(F.min_by(F.struct(*rest), F.col(ts)).alias("_r")).select(*by, "_r.*")


def recent_fix(events: DataFrame, fixes: DataFrame, key: str, ts: str, fix_ts: str, within: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Each event with the latest fix of its key within the time before it, null if there is none.

    On streams a join with bounded state, then the latest of each event's fixes, in append mode: an
    event comes out when the watermark has passed it. Equal event rows come out as often as they came in.
    """
    f = fixes.select(F.col(key).alias("_fix_key"), F.col(fix_ts).alias("_fix_ts"), F.struct(*fixes.columns).alias("_fix"))
    if events.isStreaming:
        events, f = events.withWatermark(ts, delay), f.withWatermark("_fix_ts", delay)
    f = f.dropDuplicates(["_fix_key", "_fix_ts", "_fix"])
    joined = events.join(f, F.expr(f"`{key}` = _fix_key and _fix_ts <= `{ts}` and _fix_ts >= `{ts}` - interval {within}"), "leftOuter")
    # With each fix once, an event that came n times has n rows for each of its fixes.
    times = F.count("*") / F.greatest(F.size(F.collect_set(F.struct("_fix_ts", "_fix"))), F.lit(1))
    each = joined.groupBy(*events.columns).agg(F.max_by("_fix", F.struct("_fix_ts", F.to_json("_fix"))).alias("fix"), F.max(F.when(F.col("_fix").isNull(), 1)).alias("_none"), times.cast("int").alias("_times"), F.count("*").cast("int").alias("_rows"))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_none") == 1, F.col("_rows")).otherwise(F.col("_times"))))).drop("_copy", "_none", "_times", "_rows")


def run_to_path(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain what is there now into the table at ``path``, and return that table.

    In complete mode each batch is the whole result and replaces it; in append mode each adds
    its rows, under its number, so a repeated batch replaces itself. ValueError for other modes.
    """
    if mode not in ("complete", "append"):
        raise ValueError("mode must be complete or append")

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


#: Fixed value: seconds between two kept fixes at least.
GAP_S = 20


def thin_exact(stream: DataFrame, ts: str, by: Sequence[str], order: Sequence[str] = (), gap_s: float = GAP_S, delay: str = "10 minutes") -> DataFrame:
    """Rows of a stream of which no two of one key are less than ``gap_s`` apart, over batches too.

    A row is kept if it is that long after the last kept row of its key; rows of a batch come in the
    order of ``ts`` and ``order``, batches in the order of their arrival, so what comes late, before the last kept
    row, goes. Null times and keys go. A key's state is one time; a timer clears it when the watermark, ``delay``
    behind the latest time seen, has passed it by the gap, as any row that may still come is then kept anyway. A key has one
    timer at a time, which is set on when it expires before that. A task holds one key's rows of one batch, as rows, since keys
    of a batch have few. The state is kept by RocksDB, which this sets for the stream to come.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    gap, columns = int(gap_s * 1_000_000), stream.columns
    micros = "_micros"
    while micros in columns:
        micros = f"_{micros}"
    kept = [micros if c == ts else c for c in columns]

    def place(row) -> tuple:
        """Where a row comes in its batch; nulls and NaN last."""
        return row[micros], *((True, 0) if row[c] is None or row[c] != row[c] else (False, row[c]) for c in order)

    class Thinner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, timed boolean")

        def handleInputRows(self, key, rows, timerValues):
            before, timed = self.last.get() or (None, False)
            last, out = before, []
            for row in sorted(rows, key=place):
                if last is None or row[micros] >= last + gap:
                    out.append(Row(**{c: row[c] for c in kept}))
                    last = row[micros]
            if out:
                if not timed:
                    self.handle.registerTimer((last + gap) // 1000 + 1)
                self.last.update((last, True))
            return iter(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            due = (self.last.get()[0] + gap) // 1000 + 1
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            else:
                self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Times go through Python as microseconds, so that no zone's clock changes matter.
    present = stream.dropna(subset=[ts, *by]).withWatermark(ts, delay).withColumn(micros, F.unix_micros(F.col(ts).cast("timestamp")))
    schema = T.StructType([T.StructField(micros, T.LongType()) if f.name == ts else f for f in stream.schema])
    thinned = present.groupBy(*by).transformWithState(Thinner(), schema, "Append", "EventTime")
    return thinned.select(*(F.timestamp_micros(micros).cast(stream.schema[ts].dataType).alias(ts) if c == ts else F.col(c) for c in columns))


#: Buckets that a keyed table is cut into; a batch writes those that it touches. Versions of the table that stay readable.
BUCKETS, KEPT_VERSIONS = 64, 2


def upsert_sink(stream: DataFrame, path: str, keys: Sequence[str], version: str, checkpoint: str, buckets: int = BUCKETS, kept: int = KEPT_VERSIONS):
    """Write each batch into a keyed table: new rows win, others stay. A repeated batch gives the same table.

    The table is cut into buckets by the keys' hash. A batch writes anew the buckets that it touches, one
    file each, and then a manifest of which version of each bucket is current. The manifest appears by a
    rename, so readers see a batch whole or not at all, and a batch that failed before it is done
    again over the same version. Only the last ``kept`` manifests and what they name stay, so files are bounded by
    buckets and not by batches.
    """

    def one(batch: DataFrame, n: int) -> None:
        _upsert(batch, n, path, keys, version, buckets, kept)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _upsert(batch: DataFrame, n: int, path: str, keys: Sequence[str], version: str, buckets: int, kept: int) -> None:
    from ..operators.relational import upsert

    spark = batch.sparkSession
    done = _manifests(spark, path)
    before = {k: v for k, v in done.items() if k < n}
    if n in done:
        return
    current = _read_manifest(spark, path, max(before)) if before else {}
    new = batch.withColumn(version, F.lit(n)).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # numbers of buckets
    old = [(b, current[b]) for b in touched if b in current]
    if old:
        new = upsert(_read_buckets(spark, path, old).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), new, keys)
    new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/version={n}")
    _write_manifest(spark, path, n, current | dict.fromkeys(touched, n))
    _expire(spark, path, kept)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _manifests(spark: SparkSession, path: str) -> dict[int, str]:
    """Batch numbers with a manifest."""
    return {int(f): f for f in _listed(spark, f"{path}/manifest") if f.isdigit()}


def _read_manifest(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """The current version of each bucket as of batch ``n``."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").json(f"{path}/manifest/{n:020d}").collect()}


def _write_manifest(spark: SparkSession, path: str, n: int, current: dict[int, int]) -> None:
    made = f"{path}/making/{n:020d}"
    spark.createDataFrame(sorted(current.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(made)
    fs, at = _files(spark, made)
    fs.mkdirs(_files(spark, f"{path}/manifest")[1])
    if not fs.rename(at, _files(spark, f"{path}/manifest/{n:020d}")[1]):
        raise RuntimeError(f"manifest {n} could not be put in place")


def _expire(spark: SparkSession, path: str, kept: int) -> None:
    """Delete manifests but the last ``kept``, and buckets' versions that none of these names."""
    every = sorted(_manifests(spark, path))
    for n in every[:-kept]:
        fs, at = _files(spark, f"{path}/manifest/{n:020d}")
        fs.delete(at, True)
    named = {(b, v) for n in every[-kept:] for b, v in _read_manifest(spark, path, n).items()}
    for folder in _listed(spark, f"{path}/data"):
        v = int(folder.split("=")[1])
        own = [int(x.split("=")[1]) for x in _listed(spark, f"{path}/data/{folder}") if x.startswith("_bucket=")]
        gone = [b for b in own if (b, v) not in named]
        for at in [f"{path}/data/{folder}"] if len(gone) == len(own) else [f"{path}/data/{folder}/_bucket={b}" for b in gone]:
            fs, where = _files(spark, at)
            fs.delete(where, True)


def _read_buckets(spark: SparkSession, path: str, held: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/data/version={v}/_bucket={b}" for b, v in held))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_sink`` keeps at ``path``, as of its last whole batch; ValueError if there is none."""
    done = _manifests(spark, path)
    current = _read_manifest(spark, path, max(done)) if done else {}
    if not current:
        raise ValueError(f"{path}: no batch with rows is there yet")
    return _read_buckets(spark, path, sorted(current.items()))
