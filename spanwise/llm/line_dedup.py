"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host if the share of the host's pages that contain it
exceeds ``max_ratio`` and at least ``min_pages`` pages contain it.

Plan: each page yields its distinct line hashes; one aggregate by (host, hash), whose
map-side partial sums absorb very common lines and a host with a third of all rows;
a join with the host totals keeps the boilerplate. On one host at most
``mean distinct lines per page / max_ratio`` lines can pass, so the list for a host is
bounded by the pages' length and not by their number. The lists go back to the pages
by a broadcast if their counted number is small, else by a join on the host that
adaptive execution splits where a host is hot.

Lines are compared by the 64-bit hash of the line without outer spaces. A wrong drop
needs a collision with one of a host's few boilerplate lines: for 10,000 of them and
10^9 lines on that host, a chance below 10^-6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fresh, materialise

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Most (host, line) pairs that are broadcast; beyond it the lists are joined by a shuffle.
BROADCAST_LINES = 100_000


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, n_pages, n_host_pages) of each boilerplate line. Blank lines never count."""
    src = pages.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    counts = src.select("host", F.explode(keys).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = src.groupBy("host").agg(F.count("*").alias("n_host_pages")).withColumnRenamed("host", "h")
    return counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_pages") > max_ratio * F.col("n_host_pages")).drop("h")


def drop_boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text``; every row stays.

    ``counts`` names two more columns, lines before and lines removed, which replace columns of those names.
    Null text stays null (0 lines) and counts as a page of its host; a null host is a
    host of its own; an empty text is one blank line; repeated rows are separate pages;
    a page whose lines all go has the empty text. Other columns pass through unchanged;
    very long texts are split whole, in the JVM.
    """
    bad = materialise(boilerplate_lines(pages, host, text, max_ratio, min_pages).select("host", "line_hash"), "boilerplate")
    b_host, b_list, hit = fresh(pages, "bp_host", "bp_lines", "bp_hits")
    lists = bad.groupBy(F.col("host").alias(b_host)).agg(F.collect_list("line_hash").alias(b_list))
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        lists = F.broadcast(lists)
    joined = pages.join(lists, F.col(host).eqNullSafe(F.col(b_host)), "left")
    body = F.col(text).cast("string")
    # The page's own boilerplate first: a hash intersection, so that the test of each line scans a short list.
    joined = joined.withColumn(hit, F.when(F.col(b_list).isNotNull() & body.isNotNull(), F.array_intersect(F.col(b_list), F.transform(_lines(body), _key))))
    lines = _lines(body)
    any_hit = F.coalesce(F.size(hit) > 0, F.lit(False))
    kept = F.when(any_hit, F.filter(lines, lambda x: ~F.array_contains(F.col(hit), _key(x)))).otherwise(lines)
    replaced = {c.lower() for c in counts or ()}
    out = [F.col(f"`{c}`") if c != text else F.when(any_hit, F.concat_ws("\n", kept)).otherwise(body).alias(text) for c in pages.columns if c.lower() not in replaced]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)


ORACLE = f"""
WITH l AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
c AS (SELECT source, line, count(*) AS k FROM l WHERE line <> '' GROUP BY source, line HAVING count(*) >= {MIN_PAGES}),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE k > {MAX_RATIO}e0 * n GROUP BY c.source),
k AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls, coalesce(b.bad, []) AS bad FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
f AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(bad, trim(x))) AS keep FROM k)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(keep, chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(keep), 0) AS BIGINT) AS n_removed
FROM f
"""
