"""Pipeline stages: operators applied to a table of documents, whose decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language_id, line_dedup, near_copies, queries
from .runtime import bound_batches, fresh

#: Texts whose best language scores below this are junk; short clean texts score from about 0.33.
REJECT_BELOW = 0.2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null, letterless and unrecognisable texts go. ``lang`` stays as it is, but a null one is filled.

    The session's Arrow batches stay bounded from here on, as the caller runs the plan.
    """
    bound_batches(spark)
    model = language_id.train(docs, ~language_id.held_out())
    pred, score = fresh(docs, "lid_pred", "lid_score")
    judged = language_id.identify(docs, model, pred=pred, score=score)
    kept = judged.where((F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= REJECT_BELOW))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their sites' boilerplate lines; ``n_chars`` is counted anew."""
    return line_dedup.drop_boilerplate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8), that with the smallest doc_id.

    Rows with a null doc_id stay. Where the smallest doc_id names rows of several texts, one
    row of each text stays; of rows with equal doc_id and text, that with the smallest of the other columns.
    """
    named = docs.where("doc_id is not null")
    key, first_ = fresh(docs, "nc_key", "nc_first")
    first = near_copies.near_copies(named).where("key = component").groupBy(F.col("key").alias(key)).agg((F.count("*") > 1).alias(first_))
    joined = docs.join(first, F.col("doc_id") == F.col(key))
    once = joined.where(~F.col(first_)).select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Only doc_ids of several rows are grouped.
    many = joined.where(first_).groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias(first_)).select("doc_id", "text", f"{first_}.*")
    return once.unionByName(many.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no test item. The session's Arrow batches stay bounded, as in ``by_language``."""
    bound_batches(spark)
    return decontam.drop_contaminated(docs, decontam.build_indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, a row for each piece of a document."""
    return queries.pack_documents(docs).withColumnRenamed("key", "doc_id")
