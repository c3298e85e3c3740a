"""Divergence of each source's words from its language's other sources, by DuckDB on shards.

Spark deals the work out and merges it; DuckDB does the counting in each task.

1. Tasks take the texts in bounded blocks, and DuckDB splits and counts them by
   (lang, source, term): occurrences and documents. Only these counts go on.
2. Counts are dealt out by a hash of (lang, term) to shards. A shard folds what comes in as it
   comes in; a term of a language is whole there, so the shard can tell which terms the
   language keeps, and writes their counts by source and for the language.
3. Spark sums the totals: occurrences by group, terms and occurrences by language. Shards then
   give each count its smoothed share and, by a join of a term's sources with each other,
   each pair's partial sum over the terms that both sources have. What a source has alone is
   summed by its different shares (a table of group and share), so that no shard ever
   writes a row for a term that a source lacks.
4. Spark merges the pairs' sums and ranks; of the terms each task ranks its own first, so
   that a group's last ranking sees ``top`` rows of each task at most.

All arithmetic is on whole numbers: 128 bits in DuckDB, decimals where Spark sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, materialise

#: A term is a run of letters: ASCII ones and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCUMENTS = 3
UNIT = 1_000_000_000
TOP = 200
#: Characters of text that DuckDB counts at a time, different counts that a task holds before it passes them on, and counts of one shard.
BLOCK_CHARS = 16_000_000
HELD = 1_000_000
SHARD = 250_000
#: Partial counts that a shard reads.
READ = 20_000_000
#: One slice of so many is counted to size the shards; results do not depend on it.
SLICES = 64


def _duckdb():
    """A database in a task: one thread, in memory, bounded."""
    import duckdb

    con = duckdb.connect()
    for setting in ("threads = 1", "memory_limit = '1GB'", "temp_directory = ''", "preserve_insertion_order = false"):
        con.execute(f"SET {setting}").fetchall()
    return con


def _do(con, sql: str, *values) -> list[tuple]:
    """A statement run to its end, as the next one demands."""
    return con.execute(sql, values).fetchall()


#: Groups go by numbers in a task, as numbers are counted faster than names.
_COUNTS = "CREATE TABLE g (lang VARCHAR, source VARCHAR, g INTEGER); CREATE TABLE c (g INTEGER, term VARCHAR, n BIGINT, docs BIGINT)"
_ENROL = """INSERT INTO g SELECT lang, source, (SELECT count(*) FROM g) + row_number() OVER () FROM (SELECT lang, source FROM block EXCEPT SELECT lang, source FROM g)"""
_FOLD = "CREATE OR REPLACE TABLE c AS SELECT g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM c GROUP BY ALL"
_SPLIT = f"""INSERT INTO c SELECT g, term, sum(n), count(*) FROM (SELECT g, term, doc, count(*) AS n FROM (
SELECT g, doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM block JOIN g USING (lang, source)) GROUP BY ALL) GROUP BY ALL"""
_NAMED = "SELECT lang, source, term, n, docs FROM c JOIN g USING (g)"
_DDL = "lang string, source string, term string, n long, docs long"


def _held(con) -> int:
    return _do(con, "SELECT count(*) FROM c")[0][0]


def _count(block_chars: int, most: int):
    """(lang, source, text) to partial counts of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        _do(con, _COUNTS)
        held: list[pa.RecordBatch] = []
        size = folded = 0
        for b in batches:
            at = 0
            for i, n in enumerate(pc.utf8_length(b.column("text")).to_pylist()):
                size += n
                if size < block_chars:
                    continue
                held.append(b.slice(at, i + 1 - at))
                at, size = i + 1, 0
                _split(con, held)
                if _held(con) > folded + most:
                    _do(con, _FOLD)
                    folded = _held(con)
                if folded > most:
                    yield from con.sql(_NAMED).to_arrow_reader(65536)
                    _do(con, "DELETE FROM c")
                    folded = 0
            held.append(b.slice(at))
        _split(con, held)
        _do(con, _FOLD)
        yield from con.sql(_NAMED).to_arrow_reader(65536)
        con.close()

    return run


def _split(con, held: list[pa.RecordBatch]) -> None:
    """Counts of the batches held, which are let go."""
    if held:
        block = pa.Table.from_batches(held)
        con.register("block", block.append_column("doc", pa.array(range(len(block)), pa.int64())))
        _do(con, _ENROL)
        _do(con, _SPLIT)
        con.unregister("block")
        held.clear()


#: Rows that a shard takes in at a time.
TAKEN = 250_000


def _taken(con, batches: Iterator[pa.RecordBatch]) -> Iterator[None]:
    """Batches as the view ``block`` of some TAKEN rows at a time."""
    held, n = [], 0

    def show():
        con.register("block", pa.Table.from_batches(held))
        yield
        con.unregister("block")

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TAKEN:
            yield from show()
            held, n = [], 0
    if held:
        yield from show()


def _keep(least: int):
    """Partial counts of whole shards to the counts of kept terms; a null source stands for the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        _do(con, "CREATE TABLE c (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        folded = 0
        for _ in _taken(con, batches):
            _do(con, "INSERT INTO c SELECT * FROM block")
            if _held(con) > 2 * folded + HELD:
                _do(con, "CREATE OR REPLACE TABLE c AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM c GROUP BY ALL")
                folded = _held(con)
        _do(con, "CREATE TABLE g AS SELECT lang, source, row_number() OVER () AS g, dense_rank() OVER (ORDER BY lang) AS l FROM (SELECT DISTINCT lang, source FROM c)")
        _do(con, "CREATE TABLE f AS SELECT l, g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM c JOIN g USING (lang, source) GROUP BY ALL")
        _do(con, "CREATE TABLE k AS SELECT l, term, sum(n)::BIGINT AS n FROM f GROUP BY ALL HAVING sum(docs) >= ?", least)
        own = "SELECT lang, source, term, f.n FROM f SEMI JOIN k USING (l, term) JOIN g USING (g)"
        whole = "SELECT lang, NULL, term, n FROM k JOIN (SELECT DISTINCT lang, l FROM g) USING (l)"
        yield from con.sql(f"{own} UNION ALL {whole}").to_arrow_reader(65536)
        con.close()

    return run


# p of a count with the group's total and the language's number of terms, and f of two shares.
_P = f"(1 + {UNIT}::HUGEINT * ({{n}} + 1) // (total::HUGEINT + terms))::BIGINT"
_F = "(({p} - {q}) * ({p} - {q}) // {q})"
#: A term's sources with each other: what the pair's sum gains over the sums of each source against an absent term.
_PAIRS = f"""SELECT a.lang, a.source, b.source AS item,
sum({_F.format(p="a.p", q="b.p")}::HUGEINT - {_F.format(p="a.p", q="b.p0")} - {_F.format(p="a.p0", q="b.p")} + {_F.format(p="a.p0", q="b.p0")})::DECIMAL(38,0) AS value
FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
_TERMS = f"""SELECT s.lang, s.source, s.term AS item, {_F.format(p="s.p", q="l.p")} AS value FROM s JOIN l USING (lang, term) WHERE s.p > l.p
QUALIFY row_number() OVER (PARTITION BY s.lang, s.source ORDER BY value DESC, item) <= {{top}}"""
_SHARES = "SELECT lang, source, p AS item, count(*)::DECIMAL(38,0) AS value FROM s GROUP BY ALL"


def _shards(top: int):
    """Kept counts with their totals to (part, lang, source, item, value): partial pair sums, best terms, and numbers of terms by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        _do(con, "CREATE TABLE t (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, total DECIMAL(38,0), terms BIGINT)")
        for _ in _taken(con, batches):
            _do(con, "INSERT INTO t SELECT * FROM block")
        _do(con, f"CREATE TABLE l AS SELECT lang, term, {_P.format(n='n')} AS p FROM t WHERE source IS NULL")
        _do(con, f"CREATE TABLE s AS SELECT lang, source, term, {_P.format(n='n')} AS p, {_P.format(n='0')} AS p0 FROM t WHERE source IS NOT NULL")
        for part, sql in (("pair", _PAIRS), ("term", _TERMS.format(top=top)), ("share", _SHARES)):
            yield from con.sql(f"SELECT '{part}' AS part, lang, source, item::VARCHAR AS item, value::DECIMAL(38,0) AS value FROM ({sql})").to_arrow_reader(65536)
        con.close()

    return run


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from each other one, and by which terms.

    Null text, lang and source count as ''. Part ``pair`` has a row for each ordered pair of
    a language's sources, ``value`` the sum over the language's kept terms (those in ``least``
    of its documents) of floor((p - q)^2 / q), where p and q are the two sources' smoothed
    shares in billionths; 0 where no term is kept. Part ``term`` has the ``top`` terms that the
    source has more often than its language does. Ties go by the item's bytes. A source
    without texts or terms is a group like any other, a language of one source has no pairs,
    repeated rows are separate documents, very long texts are counted whole, an empty table gives
    an empty result, and other columns do not matter, whatever their names.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    src = docs.select(*named)
    counts = materialise(src.mapInArrow(_count(BLOCK_CHARS, HELD), _DDL), "counts")
    # A shard folds what comes in, so its size is that of its different counts; a slice by hash tells their number.
    slice_of = counts.where(F.pmod(F.xxhash64("lang", "source", "term"), F.lit(SLICES)) == 0).select("lang", "source", "term").distinct().count()
    shards = max(1, math.ceil(slice_of * SLICES / SHARD), math.ceil(counts.count() / READ))
    kept = materialise(counts.repartition(shards, "lang", "term").mapInArrow(_keep(least), "lang string, source string, term string, n long"), "kept")
    discard(counts)
    # A row for each language, and for each group; null is the language itself.
    whole = kept.where("source is null").groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))
    sums = kept.where("source is not null").groupBy("lang", "source").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.count("*").alias("own"))
    groups = src.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(whole.select("lang", "terms"), "lang", "left")
    groups = materialise(groups.select("lang", "source", F.coalesce("total", F.lit(0).cast("decimal(38,0)")).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("own", F.lit(0)).alias("own")), "groups")
    totals = groups.select("lang", F.col("source").alias("g"), "total", "terms").unionByName(whole.select("lang", F.lit(None).cast("string").alias("g"), "total", "terms"))
    with_totals = kept.join(totals.withColumnRenamed("lang", "tl"), (F.col("lang") == F.col("tl")) & F.col("source").eqNullSafe(F.col("g"))).select("lang", "source", "term", "n", "total", "terms")
    found = with_totals.repartition(shards, "lang", "term").mapInArrow(_shards(top), "part string, lang string, source string, item string, value decimal(38,0)")
    # Terms keep only each task's best; sums go on as they are and are small: pairs of sources and different shares, for each shard.
    found = materialise(found, "found")

    whole_number = lambda c: c.cast("decimal(38,0)")
    f = lambda p, q: F.expr(f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))")
    absent = F.expr(f"1 + cast({UNIT} div (total + terms) as long)")
    held = groups.where("terms > 0").select("lang", "source", absent.alias("p0"), "terms", "own")
    other = held.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("theirs"))
    shares = found.where("part = 'share'").groupBy("lang", "source", F.col("item").cast("long").alias("p")).agg(F.sum("value").alias("k"))
    alone = shares.join(other, "lang").where(F.col("source") != F.col("item"))
    # What a source has against a source without it, and the other way round.
    forth = alone.select("lang", "source", "item", whole_number(F.col("k") * f("p", "q0")).alias("value"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), whole_number(F.col("k") * f("q0", "p")).alias("value"))
    neither = held.join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", whole_number(F.expr("terms - own - theirs") * f("p0", "q0")).alias("value"))
    nothing = groups.where("terms = 0").select("lang", "source").join(groups.where("terms = 0").select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("decimal(38,0)"))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = both.unionByName(forth).unionByName(back).unionByName(neither).unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    best = lambda *by: Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item")
    words = found.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    if shards > 64:  # one more level, so that a group's last ranking sees the best of few
        words = words.withColumn("_b", F.pmod(F.xxhash64("item"), F.lit(math.isqrt(shards)))).withColumn("_r", F.row_number().over(best("_b"))).where(F.col("_r") <= top).drop("_b", "_r")
    ranked = words.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best())).unionByName(ranked.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
share AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, CAST(1 + {UNIT}::HUGEINT * (coalesce(own.n, 0) + 1) // (size.total + v.v) AS HUGEINT) AS p,
  CAST(1 + {UNIT}::HUGEINT * (kept.n + 1) // (v.total + v.v) AS HUGEINT) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN size USING (lang, source) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM share WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}
"""
