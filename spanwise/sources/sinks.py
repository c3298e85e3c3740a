"""Sinks: overwrite, append, patches, GeoJSON, caches with a signature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import repeats_signature


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Whole-table write; the committer shows it only when it is complete."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("quote", '"').option("escape", '"')
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def append_json(df: DataFrame, path: str) -> None:
    write_table(df, path, "json", "append")


def write_columns_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV of just these columns, in this order."""
    write_table(df.select(*columns), path, "csv")


def rewrite_columns(df: DataFrame, new: DataFrame, keys: Sequence[str], path: str, fmt: str = "csv") -> None:
    """``df`` with the columns of ``new`` replaced or added by key, written to another path."""
    fresh = [c for c in new.columns if c not in keys]
    write_table(df.drop(*fresh).join(new, list(keys), "left"), path, fmt)


def geojson(df: DataFrame, ring: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature for each row, as a JSON text."""
    line = F.transform(F.col(ring), lambda p: F.array(p["x"], p["y"]))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(line).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables, nodes and edges."""
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graphml(nodes: DataFrame, edges: DataFrame, node: str = "node", u: str = "u", v: str = "v") -> DataFrame:
    """(part, line): the lines of a GraphML file, to be written in order of the parts; attributes are all other columns."""
    def safe(c):
        out = F.col(c).cast("string")
        for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(x), F.lit(y))
        return out

    def data(df, ends, kind):
        cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{kind}_{c}">'), safe(c), F.lit("</data>"))) for c in df.columns if c not in ends]
        return F.concat_ws("", *cells) if cells else F.lit("")

    keys = [f'<key id="{kind}_{c}" for="{name}" attr.name="{c}" attr.type="string"/>' for kind, name, df, ends in (("n", "node", nodes, (node,)), ("e", "edge", edges, (u, v))) for c in df.columns if c not in ends]
    spark = nodes.sparkSession
    fixed = lambda part, lines: spark.range(1).select(F.lit(part).alias("part"), F.explode(F.array(*map(F.lit, lines))).alias("line"))
    head = fixed(0, ['<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join([*keys, '<graph edgedefault="directed">'])])
    body = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), safe(node), F.lit('">'), data(nodes, (node,), "n"), F.lit("</node>")).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), safe(u), F.lit('" target="'), safe(v), F.lit('">'), data(edges, (u, v), "e"), F.lit("</edge>")).alias("line"))
    return head.unionByName(body).unionByName(links).unionByName(fixed(3, ["</graph>\n</graphml>"]))


def write_cache(df: DataFrame, path: str, inputs: DataFrame) -> None:
    """A Parquet table beside the signature of what it was made from."""
    write_table(df, f"{path}/data")
    df.sparkSession.createDataFrame([(repeats_signature(inputs),)], "signature string").write.mode("overwrite").parquet(f"{path}/signature")


def read_cache(spark: SparkSession, path: str, inputs: DataFrame) -> DataFrame:
    """The cached table; ValueError if its inputs have changed."""
    stamp = spark.read.parquet(f"{path}/signature").first()["signature"]
    if stamp != repeats_signature(inputs):
        raise ValueError(f"{path} is stale: its inputs have changed")
    return spark.read.parquet(f"{path}/data")


_folders: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is; a session that is gone already leaves it."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the gateway may have closed
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below this application's folder in ``spark.checkpoint.dir``, which goes when the driver ends.

    In local mode it lies below a temporary folder where that is unset.
    """
    import atexit
    import shutil
    import tempfile
    import uuid

    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spanwise-")
            atexit.register(shutil.rmtree, base, True)
        _folders[app] = f"{base.rstrip('/')}/spanwise-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the ``cut`` of iterative operators."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that no later plan reads. Only what ``cut_lineage`` itself returned is deleted; others are left alone."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            _remove(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are done.

    It does so when the driver's JVM collects them, which a large heap puts off for long; this asks for it.
    """
    spark._jvm.System.gc()
