"""Category rules: tables of checks compiled into one projection.

A check is a severity, a field and a condition on a flat description of the
document (see :func:`described`); a category is a list of checks and the number
they count against. New categories are added to ``CATEGORIES``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.functions.text import strip

ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Check:
    field: str
    severity: str
    message: str
    fails: Callable[[], Column]
    expected: str | None = None
    actual: Callable[[], Column] | None = None


def _blank(c: str) -> Callable[[], Column]:
    return lambda: strip(F.coalesce(F.col(c), F.lit(""))) == ""


def _short(c: str, n: int) -> Callable[[], Column]:
    return lambda: (strip(F.coalesce(F.col(c), F.lit(""))) != "") & (F.length(c) < n)


def _none(c: str) -> Callable[[], Column]:
    return lambda: F.col(c) == 0


def _lacks(*words: str) -> Callable[[], Column]:
    def fails() -> Column:
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains("text", F.lit(w))
        return ~any_of

    return fails


SECTIONS = tuple("abstract conclusion introduction method result".split())
CODE = (*("class function import ```".split()), *(f"{word} " for word in ("const", "def", "var")))
REPORT_PARTS = tuple("analysis executive finding recommendation summary".split())

CATEGORIES: dict[str, tuple[int, tuple[Check, ...]]] = {
    "academic_paper": (7, (
        Check("metadata.title", ERROR, "a paper needs a title", _blank("title")),
        Check("metadata.title", WARNING, "title is short", _short("title", 10), ">= 10 chars", lambda: F.length("title")),
        Check("metadata.authors", WARNING, "no author", _none("n_authors")),
        Check("metadata.abstract", WARNING, "no abstract", _blank("abstract")),
        Check("metadata.abstract", WARNING, "abstract is short", _short("abstract", 50), ">= 50 chars", lambda: F.length("abstract")),
        Check("content", ERROR, "a paper needs content", _none("n_content")),
        Check("content.structure", WARNING, "no usual section", _lacks(*SECTIONS), "at least one section keyword", lambda: F.lit("none found")),
        Check("figures", INFO, "no figures", _none("n_figures")),
        Check("tables", INFO, "no tables", _none("n_tables")),
    )),
    "blog_post": (5, (
        Check("metadata.title", ERROR, "a post needs a title", _blank("title")),
        Check("metadata.authors", WARNING, "no author", _none("n_authors")),
        Check("metadata.publish_date", WARNING, "no publish date", lambda: F.col("publish_date").isNull()),
        Check("content", ERROR, "a post needs content", _none("n_content")),
        Check("content", WARNING, "content is short", lambda: F.col("n_content").between(1, 2), ">= 3 paragraphs", lambda: F.col("n_content")),
        Check("metadata.keywords", INFO, "no keywords", _none("n_keywords")),
    )),
    "technical_docs": (4, (
        Check("metadata.title", WARNING, "no title", _blank("title")),
        Check("content", ERROR, "documentation needs content", _none("n_content")),
        Check("content.code", WARNING, "no code", _lacks(*CODE)),
        Check("links", INFO, "no links", _none("n_links")),
    )),
    "news_article": (4, (
        Check("metadata.title", ERROR, "an article needs a title", _blank("title")),
        Check("metadata.authors", WARNING, "no author", _none("n_authors")),
        Check("metadata.publish_date", WARNING, "no publish date", lambda: F.col("publish_date").isNull()),
        Check("content", ERROR, "an article needs content", _none("n_content")),
    )),
    "report": (4, (
        Check("metadata.title", ERROR, "a report needs a title", _blank("title")),
        Check("content", ERROR, "a report needs content", _none("n_content")),
        Check("data", WARNING, "neither tables nor figures", lambda: (F.col("n_tables") == 0) & (F.col("n_figures") == 0)),
        Check("content.structure", INFO, "no usual part of a report", _lacks(*REPORT_PARTS)),
    )),
}
ALIASES = {"technical_documentation": "technical_docs"}


def described(docs: DataFrame) -> DataFrame:
    """The flat description of nested documents (doc_id, category, metadata, content, figures, tables, links)."""
    text = F.array_join(F.transform(F.filter("content", lambda e: F.coalesce(e["content"], F.lit("")) != ""), lambda e: F.lower(e["content"])), " ")
    m = "metadata."
    return docs.select(
        "doc_id", "category", F.col(m + "title").alias("title"), F.size(m + "authors").alias("n_authors"), F.col(m + "abstract").alias("abstract"), F.col(m + "publish_date").alias("publish_date"),
        F.size(m + "keywords").alias("n_keywords"), F.size("content").alias("n_content"), F.size("figures").alias("n_figures"), F.size("tables").alias("n_tables"), F.size("links").alias("n_links"), text.alias("text"),
    )


def penalty_score(errors: Column, warnings: Column, total: Column | int) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - (errors + 0.5 * warnings) / total)


def _issues(checks: tuple[Check, ...], strict: bool) -> Column:
    def issue(c: Check) -> Column:
        severity = ERROR if strict and c.severity == WARNING else c.severity
        actual = c.actual().cast("string") if c.actual else F.lit(None).cast("string")
        return F.when(c.fails(), F.struct(F.lit(c.field).alias("field"), F.lit(severity).alias("severity"), F.lit(c.message).alias("message"), F.lit(c.expected).cast("string").alias("expected"), actual.alias("actual")))

    return F.array_compact(F.array(*[issue(c) for c in checks]))


def validate(described_docs: DataFrame, strict: bool = False, unknown: str = "error") -> DataFrame:
    """(doc_id, category, passed, score, issues). ``strict`` makes warnings errors, also in the score.

    A category without rules is an error, or, with ``unknown="skip"``, a row with nulls.
    """
    category = F.col("category")
    for name, key in ALIASES.items():
        category = F.when(category == name, key).otherwise(category)
    d = described_docs.withColumn("__dp_key", category)
    issues = total = None
    for key, (n, checks) in CATEGORIES.items():
        here = F.col("__dp_key") == key
        made = _issues(checks, strict)
        issues = F.when(here, made) if issues is None else issues.when(here, made)
        total = F.when(here, n) if total is None else total.when(here, n)
    if unknown == "error":
        known = F.col("__dp_key").isin(*CATEGORIES)
        total = F.when(F.coalesce(known, F.lit(False)), total).otherwise(F.raise_error(F.concat(F.lit("no validator for category "), F.coalesce("category", F.lit("null")))).cast("int"))
    d = d.select("doc_id", "category", issues.alias("issues"), total.alias("total"))
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    known = F.col("total").isNotNull()
    return d.select("doc_id", "category", F.when(known, count(ERROR) == 0).alias("passed"), F.when(known, penalty_score(count(ERROR), count(WARNING), F.col("total"))).alias("score"), "issues")
