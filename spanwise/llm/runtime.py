"""Shared plumbing: scratch tables in the cluster's shared folder, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch, and its bytes unless one row alone has more; keeps the memory of executors and Python workers bounded.
TEXT_BATCH_ROWS = 1024
TEXT_BATCH_BYTES = 8 << 20
_ROWS_KEY, _BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a temporary folder is
    set in local mode (tests); on a cluster that is an error, since executors would
    not see each other's files.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spanwise-")
            atexit.register(__import__("shutil").rmtree, base, True)
        _roots[app] = f"{base.rstrip('/')}/spanwise-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; at the end of the driver, a session that is gone already leaves it."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway may have closed
        pass


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """From now on the session's Arrow batches hold ``TEXT_BATCH_ROWS`` rows and ``TEXT_BATCH_BYTES`` bytes at most; its settings before.

    Spark reads these settings when a plan runs, not when it is made, so a stage that returns
    a table for its caller to run leaves them set. Smaller settings of the session stay.
    """
    own = {key: spark.conf.get(key) for key in (_ROWS_KEY, _BYTES_KEY)}
    if not 0 < int(own[_ROWS_KEY]) <= TEXT_BATCH_ROWS:
        spark.conf.set(_ROWS_KEY, str(TEXT_BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own[_BYTES_KEY]) > TEXT_BATCH_BYTES:
        spark.conf.set(_BYTES_KEY, str(TEXT_BATCH_BYTES))
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation. While it
    is written, Arrow batches are bounded (``bound_batches``). The session's own settings are put back.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    own = bound_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    spark = df.sparkSession
    root = shared_root(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in path:
            _remove(spark, path)


def utf8(column: str):
    """A text column as UTF-8 bytes, null as empty; a cast that costs nothing in the JVM."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def as_batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, ignoring case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
