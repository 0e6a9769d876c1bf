"""Reports: aggregates in Spark, one row formatted on the driver."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.schemas import QUALITIES


def comparison_summary(results: DataFrame) -> DataFrame:
    """One row: totals, ``passed`` (no poor or failed result), mean, least and largest score, counts by quality. ``results``: score, match_quality."""
    return results.agg(
        F.count("*").alias("total_comparisons"), F.coalesce(F.bool_and(~F.col("match_quality").isin("poor", "failed")), F.lit(True)).alias("passed"),
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        *[F.count_if(F.col("match_quality") == q).alias(f"n_{q}") for q in QUALITIES],
    )


def visual_summary(results: DataFrame) -> DataFrame:
    """``results``: similarity_score, passed."""
    return results.agg(
        F.count("*").alias("total_visual_comparisons"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("visual_passed"), F.avg("similarity_score").alias("avg_visual_similarity"),
        F.avg(F.col("passed").cast("int")).alias("visual_pass_rate"),
    )


def summary(results: DataFrame, visual: DataFrame | None = None) -> DataFrame:
    """Both grains in one row; the columns of a grain without rows are null, its total 0."""
    v = visual_summary(visual) if visual is not None else results.sparkSession.sql(
        "select 0L as total_visual_comparisons, true as visual_passed, cast(null as double) as avg_visual_similarity, cast(null as double) as visual_pass_rate")
    both = comparison_summary(results).crossJoin(F.broadcast(v))  # one row each
    return both.withColumn("passed", F.col("passed") & F.col("visual_passed")).drop("visual_passed")


def by_group(results: DataFrame, *keys: str) -> DataFrame:
    """Counts and mean scores by quality, and over all qualities, for each group: one pass for all grains."""
    return results.rollup(*keys, "match_quality").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.grouping_id().alias("grain"))


# --- one row to text ---


def as_dict(row, name: str, at: datetime, warnings: list[str] | None = None) -> dict:
    """What the formats are made of; keys of a grain without rows are left out."""
    r = row.asDict()
    s: dict = {"total_comparisons": r["total_comparisons"], "total_visual_comparisons": r["total_visual_comparisons"], "passed": r["passed"], "timestamp": at.isoformat()}
    if r["total_comparisons"]:
        s |= {k: r[k] for k in ("avg_score", "min_score", "max_score")}
        s["quality_distribution"] = {q: r[f"n_{q}"] for q in QUALITIES if r[f"n_{q}"]}
    if r["total_visual_comparisons"]:
        s |= {k: r[k] for k in ("avg_visual_similarity", "visual_pass_rate")}
    return {"test_name": name, "timestamp": at.isoformat(), "passed": r["passed"], "summary": s, "errors": [], "warnings": warnings or []}


def _facts(d: dict) -> list[tuple[str, str]]:
    s = d["summary"]
    out = [("Result", "PASSED" if d["passed"] else "FAILED"), ("Comparisons", str(s["total_comparisons"]))]
    if "avg_score" in s:
        out += [("Average score", f"{s['avg_score']:.2%}"), ("Score range", f"{s['min_score']:.2%} to {s['max_score']:.2%}")]
    if "visual_pass_rate" in s:
        out += [("Visual comparisons", str(s["total_visual_comparisons"])), ("Visual pass rate", f"{s['visual_pass_rate']:.2%}"), ("Average SSIM", f"{s['avg_visual_similarity']:.4f}")]
    return out


def formatted(d: dict, kind: str = "text") -> str:
    """``text``, ``json`` or ``markdown``; anything else is an error, HTML included."""
    if kind == "json":
        return json.dumps(d, indent=2)
    qualities = list(d["summary"].get("quality_distribution", {}).items())
    if kind == "text":
        lines = [d["test_name"], d["timestamp"], *[f"{k}: {v}" for k, v in _facts(d)], *[f"  {q}: {n}" for q, n in qualities], *[f"warning: {w}" for w in d["warnings"]]]
    elif kind == "markdown":
        lines = [f"# {d['test_name']}", "", d["timestamp"], "", *[f"- **{k}:** {v}" for k, v in _facts(d)]]
        if qualities:
            lines += ["", "| quality | count |", "|---|---|", *[f"| {q} | {n} |" for q, n in qualities]]
        if d["warnings"]:
            lines += ["", *[f"- {w}" for w in d["warnings"]]]
    else:
        raise ValueError(f"unknown format {kind}")
    return "\n".join(lines) + "\n"


def pipeline_report(metrics: DataFrame, won: DataFrame, kind: str = "text") -> DataFrame:
    """(doc_id, report): a text, markdown or JSON report for each document, built as an expression, so it scales with the documents.

    ``metrics`` as from :func:`docparity.operators.escalation.pipeline_metrics` with ``ord``; ``won`` from ``winners``.
    """
    c = F.col
    if kind == "json":
        row = F.to_json(F.struct("pipeline", "success", "time_seconds", "elements", "tables", "figures", "links", "text_length", "uses_local_model", "uses_gpu", "error"), {"ignoreNullFields": "false"})
    elif kind == "markdown":
        n = lambda x: F.when(c("success"), c(x).cast("string")).otherwise("-")
        row = F.concat(F.lit("| "), F.concat_ws(" | ", "pipeline", F.when(c("success"), "ok").otherwise("failed"), *[n(x) for x in ("time_seconds", "elements", "tables", "figures", "text_length")]), F.lit(" |"))
    elif kind == "text":
        row = F.when(c("success"), F.format_string("%s: %ss, %d elements, %d tables, %d figures, %d links, %d characters", c("pipeline"), c("time_seconds").cast("string"), "elements", "tables", "figures", "links", "text_length")).otherwise(F.concat("pipeline", F.lit(": failed: "), F.coalesce("error", F.lit(""))))
    else:
        raise ValueError(f"unknown format {kind}")
    rows = metrics.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", row.alias("r")))), lambda x: x["r"]).alias("rows")).join(won, "doc_id")
    if kind == "json":
        body = F.concat(F.lit('{"pipelines":['), F.concat_ws(",", "rows"), F.lit('],"fastest":"'), "fastest", F.lit('","most_content":"'), "most_content", F.lit('"}'))
    elif kind == "markdown":
        head = "| pipeline | status | time (s) | content | tables | figures | text length |\n|---|---|---|---|---|---|---|\n"
        body = F.concat(F.lit(head), F.concat_ws("\n", "rows"), F.lit("\n\n- **Fastest:** "), "fastest", F.lit("\n- **Most content:** "), "most_content")
    else:
        body = F.concat(F.concat_ws("\n", "rows"), F.lit("\nfastest: "), "fastest", F.lit("\nmost content: "), "most_content")
    return rows.select("doc_id", body.alias("report"))


def batch_summary(counts: list[tuple[str, int]], total: int) -> str:
    """Markdown of :func:`docparity.operators.escalation.win_counts`, a row for each pipeline."""
    return "\n".join([f"# {total} documents", "", "## Fastest", "", *[f"- **{p}:** {n}" for p, n in counts]]) + "\n"
