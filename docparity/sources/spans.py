"""Text spans of laid-out pages to elements, figures and tables.

``spans``: doc_id, page, block, block_type (0 text, 1 image), line, span, text, size, x0, y0, x1, y1.
One aggregation per (document, page, block) does all: the page's mean font size
is summed up from blocks, so text is shuffled once and never sorted globally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docparity.functions.text import author_list, pdf_date, split_list, strip

NO_SIZE = 12.0


def metadata(title: Column, author: Column, keywords: Column, created: Column) -> Column:
    return F.struct(
        F.nullif(title, F.lit("")).alias("title"), author_list(author).alias("authors"), pdf_date(created).alias("date"), split_list(keywords).alias("keywords"),
    )


def page_count(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))


def page_text(spans: DataFrame, page: int) -> DataFrame:
    """(doc_id, text) of one page, counted from 1: spans by a space, blocks by a line end. An error for documents without that page."""
    inside = F.max("page") >= page
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("page") == page, F.struct("block", "line", "span", "text")))), lambda s: s["text"]), " ")
    return spans.groupBy("doc_id").agg(F.when(inside & F.lit(page >= 1), text).otherwise(F.raise_error(F.lit(f"page {page} out of range"))).alias("text"))


def blocks(spans: DataFrame) -> DataFrame:
    """One row a text block that is not blank: joined text, largest and mean size, the page's mean size and the box."""
    size = F.coalesce("size", F.lit(NO_SIZE))
    b = spans.where("block_type = 0").groupBy("doc_id", "page", "block").agg(
        strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "span", "text"))), lambda s: F.coalesce(s["text"], F.lit(""))), " ")).alias("content"),
        F.max(size).alias("max_size"), F.avg(size).alias("mean_size"), F.sum(size).alias("__dp_sum"), F.count("*").alias("__dp_n"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    page = W.partitionBy("doc_id", "page")
    b = b.withColumn("page_size", F.sum("__dp_sum").over(page) / F.sum("__dp_n").over(page))
    return b.where("content <> ''").drop("__dp_sum", "__dp_n")


def heading_level(max_size: Column, page_size: Column) -> Column:
    """Level of a block by its largest size against the page's mean; null for paragraphs."""
    ratio = max_size / page_size
    return F.when(max_size > 1.2 * page_size, F.when(ratio > 1.8, 1).when(ratio > 1.4, 2).otherwise(3))


def elements(spans: DataFrame) -> DataFrame:
    """(doc_id, id, page, block, type, content, level, bbox)."""
    level = heading_level(F.col("max_size"), F.col("page_size"))
    return blocks(spans).select(
        "doc_id", F.format_string("p%d_b%d", "page", "block").alias("id"), "page", "block", F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("type"),
        "content", level.alias("level"),
        F.struct("page", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height")).alias("bbox"),
    )


def figures(images: DataFrame) -> DataFrame:
    """``images``: doc_id, page, image, rect (number of the rectangle), x0..y1; the first rectangle of each image, none without one."""
    first = images.where("rect is not null").groupBy("doc_id", "page", "image").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "rect").alias("r"))
    return first.select("doc_id", F.format_string("fig_p%d_i%d", "page", "image").alias("id"), "page", F.col("r.x0").alias("x"), F.col("r.y0").alias("y"), (F.col("r.x1") - F.col("r.x0")).alias("width"), (F.col("r.y1") - F.col("r.y0")).alias("height"))


def tables(cells: DataFrame) -> DataFrame:
    """``cells``: doc_id, page, table, row, col, text; (doc_id, id, page, table, rows) with nulls as empty strings."""
    by_row = cells.groupBy("doc_id", "page", "table", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"]).alias("cells"))
    t = by_row.groupBy("doc_id", "page", "table").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
    return t.select("doc_id", F.format_string("tab_p%d_t%d", "page", "table").alias("id"), "page", "table", "rows")


def renumbered_tables(found: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Tables that have rows, named ``table_1``, ``table_2``, ... through the whole document; ``pages`` counts from 1."""
    kept = found.where((F.size("rows") > 0) & (F.lit(True) if pages is None else F.col("page").isin(pages)))
    return kept.withColumn("id", F.concat(F.lit("table_"), F.row_number().over(W.partitionBy("doc_id").orderBy("page", "table")).cast("string")))


def region_table(cells: DataFrame, page: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The first table of each document whose cells lie inside a region of a page. ``cells`` has x0..y1 as well."""
    inside = cells.where((F.col("page") == page) & (F.col("x0") >= x0) & (F.col("y0") >= y0) & (F.col("x1") <= x1) & (F.col("y1") <= y1))
    return tables(inside).groupBy("doc_id").agg(F.min_by("rows", "table").alias("rows"))


def table_regions(cells: DataFrame) -> DataFrame:
    """Box around the cells of each table."""
    return cells.groupBy("doc_id", "page", "table").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@dataclass(frozen=True)
class TableSettings:
    """How tables are found: by ruled cells (``lines``, ``lines_strict``) or by where words stand (``text``). Distances are in points.

    What only ruled lines need (``join_tolerance``, ``edge_min_length``,
    ``intersection_tolerance``) is for the reader that finds the cells.
    """

    vertical_strategy: str = "lines"
    horizontal_strategy: str = "lines"
    snap_tolerance: float = 3
    join_tolerance: float = 3
    edge_min_length: float = 3
    min_words_vertical: int = 3
    min_words_horizontal: int = 1
    text_tolerance: float = 3
    intersection_tolerance: float = 3


def _starts(values: Column, tolerance: float) -> Column:
    """Where the runs of values begin, each value no farther than the tolerance from the one before, in order."""
    ordered = F.array_sort(F.array_distinct(values))
    return F.transform(F.array(ordered), lambda s: F.filter(s, lambda v, i: (i == 0) | ~(v - F.get(s, i - 1) <= tolerance)))[0]


def text_tables(words: DataFrame, settings: TableSettings = TableSettings("text", "text")) -> DataFrame:
    """Tables without ruled lines: (doc_id, id, page, table, rows, x0, y0, x1, y1), at most one a page.

    ``words``: doc_id, page, text, x0, y0, x1, y1. Words whose tops follow each other within
    ``snap_tolerance`` are a row if there are ``min_words_horizontal`` of them; left edges that do so are
    a column if there are ``min_words_vertical``. A word belongs to the last column that begins no
    more than ``text_tolerance`` behind its left edge, to the first if none does; words of one cell are
    joined by spaces, cells without words are empty. A page without columns has no table; words without text or position are left out.
    """
    page = ["doc_id", "page"]
    t = words.select(*page, "text", "x0", "y0", "x1", "y1").where("trim(text) <> '' and x0 is not null and y0 is not null and doc_id is not null and page is not null")
    t = t.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "text", "x1", "y1"))).alias("w"))
    if settings.min_words_vertical > 1:
        # most pages have no column, rows left out or not: runs of left edges, which are in order here, are too short
        far = lambda w, i: (i == 0) | ~(w["x0"] - F.get("w", i - 1)["x0"] <= settings.snap_tolerance)
        t = t.where(F.size("w") >= settings.min_words_vertical).withColumn("__dp_at", F.array_compact(F.transform("w", lambda w, i: F.when(far(w, i), i))))
        t = t.where(F.array_max(F.transform("__dp_at", lambda p, k: F.coalesce(F.get("__dp_at", k + 1), F.size("w")) - p)) >= settings.min_words_vertical).drop("__dp_at")
    t = t.withColumns({f"__dp_{k}": _starts(F.transform("w", lambda w: w[k]), settings.snap_tolerance) for k in ("y0", "x0")})
    run = lambda starts, v: F.size(F.filter(starts, lambda s: s <= v))
    t = t.withColumn("w", F.transform("w", lambda w: F.struct(*[w[k].alias(k) for k in ("x0", "y0", "text", "x1", "y1")], run(F.col("__dp_y0"), w["y0"]).alias("row"), run(F.col("__dp_x0"), w["x0"]).alias("col"))))
    rows = F.transform(F.sequence(F.lit(1), F.size("__dp_y0")), lambda i: F.filter("w", lambda w: w["row"] == i))
    t = t.withColumn("r", F.filter(rows, lambda r: F.size(r) >= max(settings.min_words_horizontal, 1)))
    t = t.withColumn("w", F.flatten("r"))
    columns = F.transform(F.sequence(F.lit(1), F.size("__dp_x0")), lambda j: F.transform(F.filter("w", lambda w: w["col"] == j), lambda w: w["x0"]))
    edges = F.transform(F.filter(columns, lambda c: F.size(c) >= max(settings.min_words_vertical, 1)), F.array_min)
    t = t.withColumn("edges", F.array_sort(edges)).where(F.size("edges") > 0)
    at = lambda w: F.greatest(run(F.col("edges"), w["x0"] + settings.text_tolerance), F.lit(1))
    cell = lambda r, j: F.array_join(F.transform(F.filter(r, lambda w: w["col"] == j), lambda w: w["text"]), " ")
    placed = F.transform("r", lambda r: F.transform(r, lambda w: F.struct(at(w).alias("col"), w["text"].alias("text"))))
    table = F.transform(placed, lambda r: F.transform(F.sequence(F.lit(1), F.size("edges")), lambda j: cell(r, j)))
    corners = [f(F.transform("w", lambda w: w[k])).alias(k) for f, k in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
    return t.select("doc_id", F.format_string("tab_p%d_t%d", "page", F.lit(1)).alias("id"), "page", F.lit(1).alias("table"), table.alias("rows"), *corners)


def found_tables(settings: TableSettings, cells: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Tables by the strategies of the settings: of ruled ``cells``, or of ``words`` if both are ``text``."""
    text = {settings.vertical_strategy, settings.horizontal_strategy}
    if not text <= {"lines", "lines_strict", "text"} or ("text" in text and len(text) > 1):
        raise ValueError(f"strategies {sorted(text)}: both must be 'text', or ruled lines")
    return text_tables(words, settings) if "text" in text else tables(cells)


# --- the service's variant ---


def service_elements(spans: DataFrame, dpi: float = 150.0) -> DataFrame:
    """Elements as the service shows them: heading where the block's mean size is above 14, content cut at 200 characters, boxes in pixels."""
    k = dpi / 72
    c = F.col("content")
    px = lambda a: (a * F.lit(k))
    return blocks(spans).select(
        "doc_id", "page", "block", F.concat(F.lit("tool_"), F.col("block").cast("string")).alias("id"), F.when(F.col("mean_size") > 14, "heading").otherwise("paragraph").alias("type"),
        F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c).alias("content"), F.bround("mean_size", 1).alias("font_size"),
        px(F.col("x0")).alias("x"), px(F.col("y0")).alias("y"), px(F.col("x1") - F.col("x0")).alias("width"), px(F.col("y1") - F.col("y0")).alias("height"),
    )


def service_image(width: Column, height: Column) -> Column:
    return F.format_string("Image (%dx%d)", width.cast("int"), height.cast("int"))


def service_table(rows: Column, columns: Column) -> Column:
    """``columns``: those of the first row."""
    return F.format_string("Table (%d rows × %d cols)", rows, columns)


def service_boxes(spans: DataFrame, cells: DataFrame, dpi: float = 150.0) -> DataFrame:
    """The service's other elements, in pixels: a figure for each image block, a table for each table. Tables count from 0 on each page."""
    k = F.lit(dpi / 72)
    px = [(F.col("x0") * k).alias("x"), (F.col("y0") * k).alias("y"), ((F.col("x1") - F.col("x0")) * k).alias("width"), ((F.col("y1") - F.col("y0")) * k).alias("height")]
    images = spans.where("block_type = 1").groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    shown = service_image(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    figures = images.select("doc_id", "page", F.concat(F.lit("tool_img_"), F.col("block").cast("string")).alias("id"), F.lit("figure").alias("type"), shown.alias("content"), *px)
    # only what is shown: numbers, no texts, so nothing is collected or joined
    corners = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    row = cells.groupBy("doc_id", "page", "table", "row").agg(F.count("*").alias("n"), *corners)
    first = F.min_by("n", F.coalesce(F.col("row").cast("long"), F.lit(-(2**63))))
    found = row.where("doc_id is not null and page is not null and table is not null").groupBy("doc_id", "page", "table").agg(F.count("*").alias("rows"), first.alias("cols"), *corners)
    number = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("table")) - 1
    return figures.union(found.select("doc_id", "page", F.concat(F.lit("tool_table_"), number.cast("string")).alias("id"), F.lit("table").alias("type"), service_table(F.col("rows"), F.col("cols")).alias("content"), *px))


def second_extractor(elements: DataFrame) -> DataFrame:
    """Stand-in for a second extractor: boxes shifted and shrunk a little, short paragraphs as captions. Needs id, type, content and a box."""
    return elements.withColumns({
        "id": F.replace("id", F.lit("tool_"), F.lit("vlm_")), "x": F.col("x") + 2, "y": F.col("y") + 1, "width": F.col("width") - 4, "height": F.col("height") - 2,
        "type": F.when((F.col("type") == "paragraph") & (F.length("content") < 50), "caption").otherwise(F.col("type")),
    })


def cached_or(found: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, page, elements, cached): a page's cached elements, else the given ones. ``cache`` is keyed by path and page name ``page_{n}``."""
    key = F.concat(F.lit("page_"), F.col("page").cast("string"))
    c = cache.select(F.col("path").alias("__dp_path"), F.col("page").alias("__dp_page"), F.col("elements").alias("__dp_elements"))
    joined = found.join(c, (F.col("path") == F.col("__dp_path")) & (key == F.col("__dp_page")), "left")
    return joined.select("path", "page", F.coalesce("__dp_elements", "elements").alias("elements"), F.col("__dp_elements").isNotNull().alias("cached"))


def tool_summary(title: Column, authors: Column, content: Column, tables: Column, figures: Column, keywords: Column) -> Column:
    """Counts and the first 20 elements, their content cut at 200 characters."""
    head = F.transform(F.slice(content, 1, 20), lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), F.substring(e["content"], 1, 200).alias("content"), e["level"].alias("level")))
    return F.struct(
        title.alias("title"), F.transform(authors, lambda a: a["name"]).alias("authors"), F.size(content).alias("content_count"), F.size(tables).alias("tables_count"),
        F.size(figures).alias("figures_count"), head.alias("content"), keywords.alias("keywords"),
    )


def model_summary(tool: Column) -> Column:
    """The stand-in's summary of the same page: it sees somewhat less of everything."""
    two = F.array(F.lit("AI"), F.lit("machine learning"))
    return F.struct(
        tool["title"].alias("title"), F.slice(tool["authors"], 1, 5).alias("authors"), (tool["content_count"] - 10).alias("content_count"), F.greatest(F.lit(0), tool["tables_count"] - 2).alias("tables_count"),
        tool["figures_count"].alias("figures_count"), F.slice(tool["content"], 1, 15).alias("content"), F.when(F.size(tool["keywords"]) > 0, F.slice(tool["keywords"], 1, 5)).otherwise(two).alias("keywords"),
    )
