"""The queries of this subpackage, each over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docparity.llm import knn, minhash, packing, pieces, pii, quality, token_counts, url_filter, warc, word_lm


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_docs(spark, sf_dir))


def op4_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all vectors to every one whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0")).withColumn("distance", F.round("distance", 6))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_docs(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.decode(pieces.encode(_docs(spark, sf_dir)))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lm.own_scores(_docs(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.expr(url_filter.FETCH_TIME).alias("fetch_time"))
    entries = spark.createDataFrame(url_filter.example_entries(), "list string, kind string, key string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    return url_filter.url_verdicts(captures, entries)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_counts, op3_pii, op4_warc_zst, op5_exact_top_k,
        op6_minhash_near_dedup, op7_quality_rules, op8_sentencepiece, op9_lm_scoring, op10_url_filter,
    )
}
ORACLES: dict[str, str] = {
    "op4_warc_zst": "SELECT page_id, url, html FROM pages",
    "op5_exact_top_k": knn.top_k_sql(),
    "op6_minhash_near_dedup": minhash.near_duplicates_sql(),
    "op7_quality_rules": quality.report_sql(),
    "op10_url_filter": url_filter.verdicts_sql(),
}
