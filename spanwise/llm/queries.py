"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, decontam, divergence, html_extract, language_id, line_dedup, packing, runtime, sharding, simhash, substring_dedup, suffix_dedup, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs, counts=("n_lines", "n_removed")).select("doc_id", "text", "n_lines", "n_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.held_out()
    model = language_id.train(docs, ~held)
    return language_id.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing under the public byte-level vocabulary."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = decontam.build_indexes(_table(spark, sf_dir, "benchmark"))
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), indexes).withColumnRenamed("key", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = _table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode("text", ranks, pattern).alias("ids"))
    both = coded.select("doc_id", "ids", byte_bpe.decode("ids", ranks).alias("decoded"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    # Written, as small Arrow batches are in force while it is: a batch holds texts, ids and decoded texts at once.
    return runtime.materialise(both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "tokens")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_simhash, op4_substring, op5_ann, op6_packing, op7_suffix, op8_html, op9_decontamination, op10_sharding, op11_divergence, op12_byte_bpe, op13_whitening)}
ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op4_substring": substring_dedup.ORACLE, "op10_sharding": sharding.ORACLE, "op11_divergence": divergence.ORACLE}
