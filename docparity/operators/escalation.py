"""Escalation across alternative extractors: thresholds, staged stop, best attempt, page merge, pipeline benchmarks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULTS = {"overall": 0.70, "content": 0.75, "table": 0.65, "figure": 0.70}
BY_CATEGORY = {
    "academic_paper": (0.75, 0.80, 0.75, 0.75), "plot_visualization": (0.80, 0.70, 0.80, 0.90), "technical_documentation": (0.75, 0.80, 0.70, 0.70),
    "blog_post": (0.65, 0.70, 0.60, 0.60), "news_article": (0.65, 0.70, 0.60, 0.60),
}
STAGES = ("pymupdf", "marker", "docling", "vlm")
PRESETS = {"fast": "pymupdf", "balanced": "marker", "quality": "docling", "full": "vlm"}


def thresholds(spark: SparkSession) -> DataFrame:
    """A handful of rows, so every join with it is a broadcast."""
    return spark.createDataFrame([(k, *v) for k, v in BY_CATEGORY.items()], "category string, min_overall double, min_content double, min_table double, min_figure double")


def with_thresholds(df: DataFrame, category: str = "category") -> DataFrame:
    t = thresholds(df.sparkSession).withColumnRenamed("category", "__dp_category")
    joined = df.join(F.broadcast(t), F.col(category) == F.col("__dp_category"), "left").drop("__dp_category")
    return joined.withColumns({f"min_{k}": F.coalesce(f"min_{k}", F.lit(v)) for k, v in DEFAULTS.items()})


def should_escalate(**scores: Column) -> Column:
    """True if any score is below its minimum; null scores never escalate. Needs the ``min_*`` columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(s < F.col(f"min_{k}"), F.lit(False)) for k, s in scores.items()])


def stages_up_to(level: str | None) -> tuple[str, ...]:
    """Extractors up to a level, inclusive; an unknown level leaves all."""
    return STAGES[: STAGES.index(level) + 1] if level in STAGES else STAGES


def reached(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts a staged run would have made: none after the first successful one that need not escalate. Needs ``stage``, ``success``, ``escalate``."""
    before = W.partitionBy(*keys).orderBy("stage").rowsBetween(W.unboundedPreceding, -1)
    done = F.max(F.when(F.col("success") & ~F.col("escalate"), 1).otherwise(0)).over(before)
    return attempts.withColumn("__dp_done", F.coalesce(done, F.lit(0))).where("__dp_done = 0").drop("__dp_done")


def run_staged(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], passed: Callable[[DataFrame], Column], keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Run extractors in order, each only on documents that none before has satisfied (anti-join on ``doc_id``).

    ``keep`` may cut the lineage of a stage's attempts, for example by a
    checkpoint; without it a stage is planned again for the next one's anti-join.
    """
    left, out = docs, None
    for i, (name, extract) in enumerate(stages):
        attempt = keep(extract(left).withColumn("stage", F.lit(i)).withColumn("parser", F.lit(name)))
        out = attempt if out is None else out.unionByName(attempt)
        left = left.join(attempt.where(passed(attempt)).select("doc_id"), "doc_id", "left_anti")
    return out


def best_attempt(attempts: DataFrame, keys: list[str], score: str = "overall") -> DataFrame:
    """The successful attempt with the best score, the earlier stage of equal ones; documents with none are marked failed."""
    best = F.max_by(F.struct(*[c for c in attempts.columns if c not in keys]), F.struct(F.col(score), -F.col("stage")))
    picked = attempts.where("success").groupBy(*keys).agg(best.alias("b"))
    tried = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"))
    return tried.join(picked, keys, "left").select(*keys, "attempts", F.when(F.col("b").isNull(), "all parsers failed").alias("error"), "b.*")


def hybrid_used(enabled: Column, bad_pages: Column, needs_full: Column, has_vlm: Column) -> Column:
    return enabled & (bad_pages > 0) & ~needs_full & has_vlm


def worst_pages(pages: DataFrame, k: int) -> DataFrame:
    """The k pages with the lowest score of each document, all if there are no more."""
    w = W.partitionBy("doc_id").orderBy("overall_score", "page")
    return pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_pages(base: DataFrame, replacement: DataFrame) -> DataFrame:
    """Elements of ``base`` on pages that ``replacement`` has none for, then those of ``replacement`` in page order. Elements without page stay."""
    pages = replacement.where("page is not null").select("doc_id", "page").distinct()
    kept = base.join(pages, ["doc_id", "page"], "left_anti").withColumn("part", F.lit(0))
    w = W.partitionBy("doc_id").orderBy("part", F.when(F.col("part") == 1, F.col("page")), "seq")
    return kept.unionByName(replacement.withColumn("part", F.lit(1))).withColumn("seq", F.row_number().over(w)).drop("part")


# --- pipeline benchmarks ---


def pipeline_metrics(elements: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a run (doc_id, pipeline, success, time_seconds, error): counts and text length of what it extracted; zeros if it failed."""
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}s")
    made = elements.groupBy("doc_id", "pipeline").agg(kind("element"), kind("table"), kind("figure"), kind("link"), F.sum(F.when(F.col("kind") == "element", F.length("content"))).alias("text_length"))
    out = runs.join(made, ["doc_id", "pipeline"], "left")
    zero = lambda c: F.when(F.col("success"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return out.select(
        "doc_id", "pipeline", "success", F.bround(F.when(F.col("success"), F.col("time_seconds")).otherwise(0.0), 3).alias("time_seconds"),
        *[zero(c) for c in ("elements", "tables", "figures", "links", "text_length")], F.when(~F.col("success"), F.col("error")).alias("error"),
        (F.col("pipeline") == "docling").alias("uses_local_model"), F.col("pipeline").isin("marker", "docling").alias("uses_gpu"),
    )


def winners(metrics: DataFrame) -> DataFrame:
    """(doc_id, fastest, most_content) over successful runs, of equals the first in pipeline order (``ord``); "none" without success."""
    ok = F.col("success")
    name = lambda key: F.coalesce(F.min_by(F.when(ok, F.col("pipeline")), F.when(ok, key)), F.lit("none"))
    return metrics.groupBy("doc_id").agg(name(F.struct("time_seconds", "ord")).alias("fastest"), name(F.struct(-F.col("text_length"), F.col("ord"))).alias("most_content"))


def win_counts(won: DataFrame) -> DataFrame:
    """(fastest, wins) by wins, then by first appearance (least doc_id)."""
    return won.groupBy("fastest").agg(F.count("*").alias("wins"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("wins"), "first_doc")


def compare_pipelines(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Two pipelines side by side for each document; ``speed_ratio`` is b's time over a's, 0 where a took none."""
    side = lambda p, s: metrics.where(F.col("pipeline") == p).select("doc_id", *[F.col(c).alias(f"{c}_{s}") for c in ("time_seconds", "elements", "text_length")])
    ratio = F.coalesce(F.bround(F.try_divide("time_seconds_b", "time_seconds_a"), 2), F.lit(0.0))
    return side(a, "a").join(side(b, "b"), "doc_id").withColumn("speed_ratio", ratio)
