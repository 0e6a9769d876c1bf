"""Markdown to elements, by array functions within the row: no shuffle, no Python.

``elements`` columns are arrays of (seq, type, content, level); :func:`exploded`
makes one row of each. Identifiers are a prefix and ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.functions.text import strip


def _lines(markdown: Column) -> Column:
    return F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), strip)


def heading_level(line: Column) -> Column:
    """Number of leading number signs, without upper bound; null for other lines."""
    n = F.length(F.regexp_extract(line, "^#*", 0))
    return F.when(n > 0, n)


def heading_text(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^#+", ""))


def _element(line: Column, i: Column) -> Column:
    level = heading_level(line)
    return F.struct(
        (i + 1).cast("int").alias("seq"), F.when(level.isNull(), "paragraph").otherwise("heading").alias("type"),
        F.when(level.isNull(), line).otherwise(heading_text(line)).alias("content"), level.cast("int").alias("level"),
    )


def line_elements(markdown: Column) -> Column:
    """Every line that is not blank is an element. Null and blank texts have none."""
    return F.transform(F.filter(_lines(markdown), lambda x: x != ""), _element)


def merged_elements(markdown: Column) -> Column:
    """Consecutive lines that are neither blank nor headings are one paragraph, joined by spaces."""
    text = F.array_join(_lines(markdown), "\n")
    apart = F.regexp_replace(text, r"(?md)^(#[^\n]*)$", "\n$1\n")
    blocks = F.transform(F.split(apart, r"\n{2,}"), lambda b: F.replace(F.regexp_replace(b, r"^\n|\n$", ""), F.lit("\n"), F.lit(" ")))
    return F.transform(F.filter(blocks, lambda b: b != ""), _element)


def first_heading(markdown: Column) -> Column:
    """Text of the first heading, null without one."""
    return F.get(F.transform(F.filter(_lines(markdown), lambda x: F.startswith(x, F.lit("#"))), heading_text), F.lit(0))


def heading_counts(docs: DataFrame, markdown: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Headings of levels 1 to 6 for each document and level; levels without headings have no row."""
    levels = F.filter(F.transform(_lines(F.col(markdown)), heading_level), lambda n: n.between(1, 6))
    return docs.select(*keys, F.explode(levels).alias("level")).groupBy(*keys, "level").agg(F.count("*").alias("n"))


def heading_map(markdown: Column) -> Column:
    """The same as a map from level to count within the row."""
    levels = F.transform(_lines(markdown), heading_level)
    counts = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.struct(k.alias("key"), F.size(F.filter(levels, lambda n: n == k)).alias("value")))
    return F.map_from_entries(F.filter(counts, lambda e: e["value"] > 0))


def exploded(docs: DataFrame, elements: Column, keys: tuple[str, ...] = ("doc_id",), prefix: str = "elem") -> DataFrame:
    """One row an element: keys, ``id``, ``seq``, ``type``, ``content``, ``level``."""
    e = docs.select(*keys, F.explode(elements).alias("e"))
    return e.select(*keys, F.concat(F.lit(f"{prefix}_"), F.col("e.seq").cast("string")).alias("id"), "e.seq", "e.type", "e.content", "e.level")
