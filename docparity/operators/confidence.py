"""Extraction confidence: page grain, then document grain.

Text is reduced to counts before anything is grouped, so only numbers are
shuffled: one row a page after the map-side combine, keyed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.functions import geometry as G
from docparity.functions import text as T

PAGE_NEEDS_SECOND_PASS = 0.65
TABLE_IS_WEAK = 0.60
PAGE_WIDTH = 600.0
COLUMN_VARIANCE = 0.02


def table_scores(table_rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, page, score) from (doc_id, table_no, page, cells); a table without rows is one row with null cells."""
    cells = F.col("cells")
    empty = F.size(F.filter(cells, lambda c: c.isNull() | (T.strip(c) == ""))).cast("long")
    per_row = table_rows.select("doc_id", "table_no", "page", cells.isNotNull().cast("long").alias("is_row"), F.size(cells).alias("width"), F.when(cells.isNotNull(), empty).alias("empty"))
    per_width = per_row.groupBy("doc_id", "table_no", "page", "width").agg(F.sum("is_row").alias("rows"), F.sum(F.when(F.col("is_row") == 1, F.col("width"))).alias("cells"), F.sum("empty").alias("empty"))
    t = per_width.groupBy("doc_id", "table_no", "page").agg(F.sum("rows").alias("rows"), F.max("rows").alias("modal"), F.sum("cells").alias("cells"), F.sum("empty").alias("empty"))
    share = F.col("modal") / F.greatest("rows", F.lit(1))
    blank = F.coalesce(F.try_divide("empty", "cells"), F.lit(0.0))
    score = T.clamp(1.0 - F.when(share < 0.8, 0.3).otherwise(0.0) - F.when(blank > 0.5, 0.3).when(blank > 0.3, 0.15).otherwise(0.0) - F.when(F.col("rows") < 2, 0.1).otherwise(0.0))
    return t.select("doc_id", "table_no", "page", F.when(F.col("rows") == 0, 0.3).otherwise(score).alias("score"))


def figure_score(caption: Column, label: Column, width: Column, height: Column) -> Column:
    missing = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0.1).otherwise(0.0)
    return 1.0 - missing(caption) - missing(label) - F.when((width <= 0) | (height <= 0), 0.3).otherwise(0.0)


def page_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, page) with summed text counts, boxes and layout facts. ``elements``: doc_id, seq, type, content, page, x, y, width, height."""
    counts = T.element_counts(F.col("content"))
    narrow = elements.select(
        "doc_id", F.coalesce("page", F.lit(1)).alias("page"), "type", *[v.alias(k) for k, v in counts.items()],
        F.when(F.col("x").isNotNull(), F.struct("seq", "x", "y", "width", "height")).alias("box"),
        F.length(T.strip(F.coalesce("content", F.lit("")))).cast("long").alias("stripped"),
    )
    return narrow.groupBy("doc_id", "page").agg(
        *[F.sum(k).alias(k) for k in T.ADDITIVE], F.sum("stripped").alias("stripped"), F.count_if(F.col("type") == "heading").alias("headings"),
        F.sort_array(F.collect_list("box")).alias("boxes"), F.coalesce(F.var_samp("box.x"), F.lit(0.0)).alias("x_variance"),
    )


def has_overlap(boxes: Column) -> Column:
    """Whether any two boxes overlap or touch; stops at the first pair."""
    return F.exists(boxes, lambda a: F.exists(boxes, lambda b: (a["seq"] < b["seq"]) & G.touches(a, b)))


def page_confidence(elements: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Page scores and issues. ``tables``: doc_id, page, score; ``figures``: doc_id, page, score. Both are null where a page has none.

    A document's pages are those of its elements; tables and figures elsewhere are not attached.
    """
    p = page_counts(elements)
    t = tables.where("page is not null").groupBy("doc_id", "page").agg(F.avg("score").alias("table_score"))
    f = figures.where("page is not null").groupBy("doc_id", "page").agg(F.avg("score").alias("figure_score"))
    ratios = T.text_ratios({k: F.col(k) for k in T.ADDITIVE})
    p = p.join(t, ["doc_id", "page"], "left").join(f, ["doc_id", "page"], "left")
    p = p.select(
        "*", *[v.alias(k) for k, v in ratios.items()],
        (F.col("x_variance") / (PAGE_WIDTH * PAGE_WIDTH) > COLUMN_VARIANCE).alias("multi_column"), has_overlap(F.col("boxes")).alias("overlapping"),
    )
    p = p.withColumn("text_score", T.text_score({k: F.col(k) for k in ratios}))
    p = p.withColumn("layout_score", T.clamp(1.0 - F.when(F.col("multi_column"), 0.2).otherwise(0.0) - F.when(F.col("overlapping"), 0.3).otherwise(0.0)))
    p = p.withColumn("overall_score", T.mean_of(F.col("text_score"), F.col("layout_score"), F.col("table_score"), F.col("figure_score")))
    issues = F.array_compact(F.array(
        F.when(F.col("text_score") < PAGE_NEEDS_SECOND_PASS, "low text quality"), F.when(F.col("multi_column"), "multi-column layout"),
        F.when(F.col("overlapping"), "overlapping blocks"), F.when(F.col("table_score") < TABLE_IS_WEAK, "low table quality"),
    ))
    return p.withColumn("needs_vlm", F.col("overall_score") < PAGE_NEEDS_SECOND_PASS).withColumn("issues", issues)


def content_score(n: Column, stripped: Column, text: Column) -> Column:
    return F.when(n == 0, 0.3).when(stripped < 50, 0.4).otherwise(text)


def structure_score(headings: Column, has_title: Column, chars: Column, n: Column) -> Column:
    short = F.coalesce(F.try_divide(chars, n) < 10, F.lit(False))
    return T.clamp(1.0 - F.when(headings == 0, 0.1).otherwise(0.0) - F.when(~has_title, 0.1).otherwise(0.0) - F.when(short, 0.2).otherwise(0.0))


def overall(content: Column, structure: Column, tables: Column, figures: Column) -> Column:
    """Weighted mean of what there is: content .5, structure .3, tables .1, figures .1."""
    weight = 0.5 + 0.3 + F.when(tables.isNotNull(), 0.1).otherwise(0.0) + F.when(figures.isNotNull(), 0.1).otherwise(0.0)
    return (0.5 * content + 0.3 * structure + F.coalesce(0.1 * tables, F.lit(0.0)) + F.coalesce(0.1 * figures, F.lit(0.0))) / weight


def document_scores(docs: DataFrame, pages: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """One row a document of ``docs`` (doc_id, title): the four scores, overall and level, and what the pages add up to.

    ``pages`` as from :func:`page_confidence`. The stripped length of the joined
    text is taken as the stripped lengths of its elements and a space between
    those that are not blank; it only matters for texts under 50 characters.
    """
    p = pages.groupBy("doc_id").agg(
        *[F.sum(k).alias(k) for k in T.ADDITIVE], F.sum("stripped").alias("stripped"), F.sum("headings").alias("headings"), F.count("*").alias("total_pages"),
        F.count_if("needs_vlm").alias("pages_needing_vlm"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"),
        F.sort_array(F.collect_list(F.when(F.col("needs_vlm"), F.col("page")))).alias("bad_pages"), F.sort_array(F.collect_list(F.when(~F.col("needs_vlm"), F.col("page")))).alias("good_pages"),
    )
    t = tables.groupBy("doc_id").agg(F.avg("score").alias("table_score"))
    f = figures.groupBy("doc_id").agg(F.avg("score").alias("figure_score"))
    d = docs.select("doc_id", "title").join(p, "doc_id", "left").join(t, "doc_id", "left").join(f, "doc_id", "left")
    d = d.fillna(0, [*T.ADDITIVE, "stripped", "headings", "total_pages", "pages_needing_vlm"])
    joined = F.col("stripped") + F.greatest(F.col("n") - F.col("n_blank") - 1, F.lit(0))
    d = d.withColumn("content_score", content_score(F.col("n"), joined, T.text_score(T.text_ratios({k: F.col(k) for k in T.ADDITIVE}))))
    d = d.withColumn("structure_score", structure_score(F.col("headings"), F.coalesce("title", F.lit("")) != "", F.col("chars"), F.col("n")))
    d = d.withColumn("overall_score", overall(F.col("content_score"), F.col("structure_score"), F.col("table_score"), F.col("figure_score")))
    vlm_ratio = F.coalesce(F.try_divide(F.col("pages_needing_vlm"), F.col("total_pages")), F.lit(0.0))
    return d.withColumn("level", T.confidence_level(F.col("overall_score"))).withColumn("vlm_ratio", vlm_ratio).withColumn("needs_full_vlm", vlm_ratio > 0.30)
