"""Equivalence of two extractions of the same document.

Both sides are one row a document with nested arrays, so the comparison is one
equi-join on the document followed by expressions within the row. Only the
string ratio needs Python. ``match_long`` works on exploded boxes where the
arrays of a document would not fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.functions import geometry as G
from docparity.functions.similarity import indel_ratio, jaccard, token_sort_ratio
from docparity.functions.text import match_quality, mean_of

THRESHOLD = 0.85
WEIGHTS = (("metadata", 0.2), ("content", 0.5), ("figures", 0.15), ("tables", 0.15))


def count_score(n: Column, m: Column) -> Column:
    """1 less the relative difference of two counts; 1 if both are 0."""
    return F.when((n == 0) & (m == 0), 1.0).otherwise(1.0 - F.abs(n - m).cast("double") / F.greatest(n, m, F.lit(1)))


def metadata_score(title_a: Column, title_b: Column, title_ratio: Column, authors_a: Column, authors_b: Column, keywords_a: Column, keywords_b: Column) -> Column:
    """Mean of the parts there are: title, number of authors, keywords; 0.5 without any."""
    has = lambda t: F.coalesce(t, F.lit("")) != ""
    title = F.when(has(title_a) & has(title_b), title_ratio).when(has(title_a) | has(title_b), 0.0)
    authors = F.when((authors_a > 0) | (authors_b > 0), count_score(authors_a, authors_b))
    return F.coalesce(mean_of(title, authors, jaccard(keywords_a, keywords_b)), F.lit(0.5))


def joined_content(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.coalesce(e["content"], F.lit(""))), " ")


def content_score(n: Column, m: Column, text_ratio: Column) -> Column:
    return F.when((n == 0) & (m == 0), 1.0).otherwise(0.7 * text_ratio + 0.3 * count_score(n, m))


def type_counts(elements: Column) -> Column:
    """Map from element type to count."""
    types = F.transform(elements, lambda e: e["type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t.alias("key"), F.size(F.filter(types, lambda x: x == t)).alias("value"))))


def text_warning(ratio: Column, threshold: float = THRESHOLD) -> Column:
    text = f"Text similarity (%.2f%%) below threshold ({threshold * 100:.2f}%%)"
    return F.when(ratio < threshold, F.format_string(text, ratio * 100))


def match_score(boxes_a: Column, boxes_b: Column) -> Column:
    """Mean over boxes of ``a``, on pages both have, of the best overlap with a box of ``b`` there; 0 without any. Not symmetric."""
    shared = F.filter(boxes_a, lambda x: F.exists(boxes_b, lambda y: y["page"] == x["page"]))
    best = F.transform(shared, lambda x: F.aggregate(boxes_b, F.lit(0.0), lambda m, y: F.when(y["page"] == x["page"], F.greatest(m, G.iou(x, y))).otherwise(m)))
    return F.when(F.size(best) > 0, F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(best)).otherwise(0.0)


def match_long(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same over exploded boxes (keys, seq, page, x, y, width, height): one equi-join on document and page, then two aggregations."""
    on = [*keys, "page"]
    x = a.select(*on, "seq", F.struct("x", "y", "width", "height").alias("__dp_a"))
    y = b.select(*on, F.struct("x", "y", "width", "height").alias("__dp_b"))
    best = x.join(y, on).groupBy(*on, "seq").agg(F.max(G.iou(F.col("__dp_a"), F.col("__dp_b"))).alias("best"))
    return best.groupBy(*keys).agg(F.avg("best").alias("match_score"), F.count("*").alias("matched"))


def figures_score(a: Column, b: Column) -> Column:
    """Count score, averaged with the box match if there are as many and all have boxes."""
    n, m = F.size(a), F.size(b)
    boxes = lambda f: F.transform(f, lambda x: x["bbox"])
    all_boxed = F.forall(a, lambda x: x["bbox"].isNotNull()) & F.forall(b, lambda x: x["bbox"].isNotNull())
    c = count_score(n, m)
    return F.when((n == 0) & (m == 0), 1.0).when((n == m) & all_boxed, (c + match_score(boxes(a), boxes(b))) / 2).otherwise(c)


def _dims(rows: Column) -> Column:
    return F.struct(F.size(rows).alias("r"), F.size(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))).alias("c"))


def tables_score(a: Column, b: Column) -> Column:
    """Count score, averaged with the mean agreement of dimensions (1, else 0.5), table by table, if there are as many. Columns are ``rows`` arrays."""
    n, m = F.size(a), F.size(b)
    same = F.zip_with(a, b, lambda x, y: F.when(_dims(x["rows"]) == _dims(y["rows"]), 1.0).otherwise(0.5))
    c = count_score(n, m)
    return F.when((n == 0) & (m == 0), 1.0).when(n == m, (c + F.aggregate(same, F.lit(0.0), lambda s, v: s + v) / n) / 2).otherwise(c)


def overall(metadata: Column, content: Column, figures: Column, tables: Column) -> Column:
    return 0.2 * metadata + 0.5 * content + 0.15 * figures + 0.15 * tables


def compare(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document both sides have (doc_id, title, authors, keywords, content, figures, tables): scores, quality, differences, warnings.

    ``authors`` and ``keywords`` are arrays of strings; the others arrays of structs as in the document schema.
    """
    side = lambda d, s: d.select("doc_id", *[F.col(c).alias(f"{c}_{s}") for c in ("title", "authors", "keywords", "content", "figures", "tables")])
    j = side(a, "a").join(side(b, "b"), "doc_id")
    j = j.withColumns({"n_a": F.size("content_a"), "n_b": F.size("content_b"), "title_ratio": indel_ratio(F.col("title_a"), F.col("title_b")), "text_ratio": token_sort_ratio(joined_content(F.col("content_a")), joined_content(F.col("content_b")))})
    c = F.col
    m = metadata_score(c("title_a"), c("title_b"), c("title_ratio"), F.size("authors_a"), F.size("authors_b"), c("keywords_a"), c("keywords_b"))
    j = j.withColumns({"metadata_score": m, "content_score": content_score(c("n_a"), c("n_b"), c("text_ratio")), "figures_score": figures_score(c("figures_a"), c("figures_b")), "tables_score": tables_score(c("tables_a"), c("tables_b"))})
    j = j.withColumn("score", overall(c("metadata_score"), c("content_score"), c("figures_score"), c("tables_score")))
    empty = lambda t: F.coalesce(t, F.lit("")) == ""
    differs = (empty(c("title_a")) != empty(c("title_b"))) | (~empty(c("title_a")) & ~empty(c("title_b")) & (c("title_ratio") < threshold))
    return j.select(
        "doc_id", "metadata_score", "content_score", "figures_score", "tables_score", "score", match_quality(c("score")).alias("match_quality"),
        F.when(differs, F.struct(c("title_a").alias("tool"), c("title_b").alias("vlm"))).alias("title_difference"),
        type_counts(c("content_a")).alias("types_a"), type_counts(c("content_b")).alias("types_b"),
        F.array_compact(F.array(F.when((c("n_a") > 0) | (c("n_b") > 0), text_warning(c("text_ratio"), threshold)))).alias("warnings"),
    )


def basic_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equality of titles and counts, and a message where the element counts differ. ``content`` as above, counts of the rest as columns."""
    kind = lambda e, t: F.size(F.filter(e, lambda x: x["type"] == t))
    side = lambda d, s: d.select("doc_id", F.col("title").alias(f"title_{s}"), F.size("authors").alias(f"authors_{s}"), F.size("content").alias(f"total_{s}"), kind(F.col("content"), "heading").alias(f"headings_{s}"), kind(F.col("content"), "paragraph").alias(f"paragraphs_{s}"), F.size("figures").alias(f"figures_{s}"), F.size("tables").alias(f"tables_{s}"))
    j = side(a, "a").join(side(b, "b"), "doc_id")
    c = F.col
    return j.select(
        "doc_id", c("title_a").eqNullSafe(c("title_b")).alias("title_match"), (c("authors_a") == c("authors_b")).alias("authors_match"),
        *[f"{k}_{s}" for k in ("total", "headings", "paragraphs") for s in "ab"],
        F.when(c("total_a") != c("total_b"), F.format_string("element count mismatch: %d vs %d", "total_a", "total_b")).alias("message"),
        (c("figures_a") == c("figures_b")).alias("figures_match"), (c("tables_a") == c("tables_b")).alias("tables_match"),
    )


def set_comparison(a: Column, b: Column) -> Column:
    """Differences both ways, intersection, union and symmetric difference of two arrays of strings, each sorted."""
    s = F.array_sort
    return F.struct(
        s(F.array_except(a, b)).alias("a_only"), s(F.array_except(b, a)).alias("b_only"), s(F.array_intersect(a, b)).alias("both"), s(F.array_union(a, b)).alias("either"),
        s(F.array_union(F.array_except(a, b), F.array_except(b, a))).alias("one_of"),
    )


def summary_comparison(tool: Column, model: Column) -> Column:
    """Set operations between two summaries (title, authors, content, keywords, counts); types come from the listed elements only."""
    types = lambda s: F.array_distinct(F.transform(s["content"], lambda e: e["type"]))
    return F.struct(
        set_comparison(types(tool), types(model)).alias("types"), set_comparison(tool["keywords"], model["keywords"]).alias("keywords"),
        (tool["content_count"] - model["content_count"]).alias("extra_content"), (tool["tables_count"] - model["tables_count"]).alias("extra_tables"),
        tool["title"].eqNullSafe(model["title"]).alias("title_match"), F.size(F.array_intersect(tool["authors"], model["authors"])).alias("author_overlap"),
    )
