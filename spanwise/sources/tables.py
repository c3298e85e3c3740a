"""Scans: tables with a catalogue and guards, events, JSON lines, XML, GeoJSON, cubes, profiles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("session_id", "session_label", "session_mode")]
    + [T.StructField(n, T.TimestampType()) for n in ("session_start", "session_end")]
    + [T.StructField("event_type", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("direction", "directionMode")]
    + [T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), T.StructField("gps_accuracy_m", T.IntegerType())]
)
SKELETON_SCHEMA = "od_id string, route_idx int, leg_type string, len_band int, g_dur double, g_dist double, conf double, coverage double, valid boolean, length_by_bucket map<string,double>, unbucketed_m double, n_signals int, turns array<struct<angle:double,degree:int,uturn:boolean>>"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, years: Sequence[int] | None = None, year_col: str = "SurveyYear") -> DataFrame:
    """A Parquet scan of the columns and years asked for; both reach the reader. The year column is read if it filters."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col(year_col).isin(*years))
    return df.select(*columns) if columns else df


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None, years: Sequence[int] | None = None, max_rows: int | None = None, whole: bool = False, year_col: str = "SurveyYear") -> DataFrame:
    """``scan`` for reports: a whole table, unpruned and unfiltered, must be asked for by name."""
    if columns is None and years is None and max_rows is None and not whole:
        raise ValueError("name columns, years or a row limit, or pass whole=True")
    df = scan(spark, path, columns, years, year_col)
    return df if max_rows is None else df.limit(max_rows)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, bytes) of the files below a folder, largest first, through Spark's own file systems."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]*)?$", 1)
    return files.select("path", name.alias("name"), F.col("length").alias("bytes")).orderBy(F.desc("bytes"), "path")


def resolve(names: Sequence[str], wanted: str) -> str:
    """The name itself, or the only one that begins with it; ValueError if none or several."""
    hits = [n for n in names if n == wanted] or [n for n in names if n.startswith(wanted)]
    if len(hits) != 1:
        raise ValueError(f"{wanted} names {len(hits)} tables")
    return hits[0]


def variables(columns: DataFrame, descriptions: DataFrame, table_name: str | None = None) -> DataFrame:
    """(variable, description) of columns, by the table's own description or else any table's."""
    d = descriptions.select(F.col("variable"), "description", F.lower("table").alias("_t"))
    own = d.where(F.col("_t") == F.lit((table_name or "").lower())).groupBy("variable").agg(F.min("description").alias("own"))
    any_ = d.groupBy("variable").agg(F.min_by("description", "_t").alias("any"))
    return columns.join(own, "variable", "left").join(any_, "variable", "left").select("variable", F.coalesce("own", "any").alias("description"))


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Observation logs with the file that each row is from."""
    return spark.read.schema(EVENT_SCHEMA).option("header", "true").csv(path).withColumn("source_file", F.input_file_name())


def profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """An hourly profile with the hour as a number."""
    from ..functions.scalar import hour_of_clock

    return spark.read.option("header", "true").csv(path).withColumn("hour", hour_of_clock(F.col("hour")))


def code_counts_csv(spark: SparkSession, path: str) -> DataFrame:
    """(code, label, count) by position; rows without a number are left out."""
    raw = spark.read.schema("code string, label string, n string").csv(path)
    return raw.select("code", "label", F.regexp_replace("n", ",", "").try_cast("double").alias("count")).where("count is not null")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a malformed line, such as a cut last one, is dropped, or with ``strict`` raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def keyed_json_lines(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str) -> DataFrame:
    """JSON lines of repeated keys: the last by ``order`` of each."""
    from ..operators.relational import last_per_key

    return last_per_key(json_lines(spark, path, schema), keys, [F.col(order)])


def xml_elements(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """Elements of an XML stream, split over tasks."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    return xml_elements(spark, path, "node", "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags())


def osm_ways(spark: SparkSession, path: str) -> DataFrame:
    return xml_elements(spark, path, "way", "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), _tags())


def _tags():
    return F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")


def ways_touching(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with any of the nodes (id)."""
    hit = ways.select("id", F.explode("refs").alias("ref")).join(nodes.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()
    return ways.join(hit, "id", "left_semi")


def closed_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tags, ring) of ways of four nodes or more that end where they begin, with all their places."""
    closed = ways.where((F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    p = closed.select("id", F.posexplode("refs").alias("pos", "ref")).join(nodes.select(F.col("id").alias("ref"), F.col("lon").alias("x"), F.col("lat").alias("y")), "ref")
    rings = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("r"))
    return closed.join(rings, "id").select("id", "tags", F.transform("r", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, tags, lon, lat): each way as the mean of its nodes."""
    p = ways.select("id", F.explode(F.array_distinct("refs")).alias("ref")).join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    return ways.select("id", "tags").join(p.groupBy("id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")), "id")


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A row for each polygon part of a GeoJSON file's features: properties, part, ring."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features").alias("f"))
    poly = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")).otherwise(F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")))
    parts = f.select("f.properties.*", F.posexplode(poly).alias("part", "rings"))
    return parts.select(*[c for c in parts.columns if c != "rings"], F.transform(F.element_at("rings", 1), lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))).alias("ring"))


def dissolve(areas: DataFrame, parent: str, sums: Sequence[str], ring: str = "ring") -> DataFrame:
    """Parents with summed columns and all their areas' rings; for containment no union of shapes is needed."""
    return areas.groupBy(parent).agg(*(F.sum(c).alias(c) for c in sums), F.collect_list(ring).alias("rings"))


def graphml_edges(spark: SparkSession, path: str, attribute: str) -> DataFrame:
    """(u, v, value) of a GraphML file's edges, with the attribute that its header names, null where an edge has none."""
    keys = xml_elements(spark, path, "key", "_id string, `_attr.name` string, _for string").where((F.col("`_attr.name`") == attribute) & (F.coalesce("_for", F.lit("edge")) == "edge")).select(F.col("_id").alias("id"))
    edges = xml_elements(spark, path, "edge", "_source string, _target string, data array<struct<_key:string,_VALUE:string>>")
    held = edges.crossJoin(F.broadcast(keys.limit(1)))
    return held.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.try_element_at(F.filter(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda x: x["_key"] == F.col("id")), F.lit(1))["_VALUE"].alias("value"))


def history_entry(history: DataFrame, prefix: str | None = None, key: str = "id", order: str = "line") -> DataFrame:
    """(entry, previous): the last entry of a run history, or the last whose id begins with ``prefix``, and the one before it.

    Reading the result raises an error if none matches.
    """
    row = F.struct(*history.columns)
    chosen = history.where(F.lit(True) if prefix is None else F.col(key).startswith(prefix)).agg(F.max(order).alias("_at"))
    upto = history.join(F.broadcast(chosen), F.col(order) <= F.col("_at"))
    # The two greatest of the order, without ranking the whole history.
    two = upto.agg(F.max_by(row, order).alias("entry"), F.max_by(F.when(F.col(order) < F.col("_at"), row), F.when(F.col(order) < F.col("_at"), F.col(order))).alias("previous"))
    return two.select(F.when(F.col("entry").isNull(), F.raise_error(F.lit("no entry matches"))).otherwise(F.col("entry")).alias("entry"), "previous")


def jsonstat(spark: SparkSession, path: str, sizes: Sequence[int]) -> DataFrame:
    """(index, value) of a JSON-stat file's cells."""
    from ..operators.relational import jsonstat_cells

    raw = spark.read.option("multiLine", "true").schema("value array<double>").json(path)
    return raw.select(F.explode(jsonstat_cells(F.col("value"), sizes)).alias("c")).select("c.*")


def repeats_signature(df: DataFrame, *columns: str) -> str:
    """An order-free signature of a table's rows: what a cache is stamped with, and checked against."""
    h = F.xxhash64(*(F.col(c) for c in (columns or df.columns))).cast("decimal(38,0)")
    n, s = df.agg(F.count("*"), F.sum(h)).first()
    return f"{n}:{s}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON file's rows, or None with a warning if it is absent."""
    if not exists(spark, path):
        warnings.warn(f"{path} is absent", stacklevel=2)
        return None
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def generation_rates(spark: SparkSession, path: str, level_path: str) -> DataFrame | None:
    """(component, rate): trips a head a day, times the island's level; None without rates, a level of 1 without a level file."""
    rates = optional_json(spark, path, "rates map<string,double>")
    if rates is None:
        return None
    level = optional_json(spark, level_path, "m_island double")
    one = spark.range(1).select(F.lit(1.0).alias("m"))
    m = one if level is None else level.select(F.coalesce("m_island", F.lit(1.0)).alias("m"))
    return rates.select(F.explode("rates").alias("component", "rate")).crossJoin(F.broadcast(m)).select("component", (F.col("rate") * F.col("m")).alias("rate"))


def base_speeds(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, kmh) that were measured; no rows, with a warning, if the file is absent, so that base speeds by class are used."""
    held = optional_json(spark, path, "speeds map<string,struct<harmonic_kmh:double>>")
    if held is None:
        return spark.createDataFrame([], "bucket string, kmh double")
    return held.select(F.explode("speeds").alias("bucket", "s")).select("bucket", F.col("s.harmonic_kmh").alias("kmh")).where("kmh > 0")
