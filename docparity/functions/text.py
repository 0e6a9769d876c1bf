"""Column functions over strings: cleaning, identifiers, additive text metrics, scores and buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def chars_left(text: Column, pattern: str) -> Column:
    """Characters left without what matches. Quicker than counting matches of one character each."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


#: White space as Unicode has it, for use within brackets; the same in Java's and RE2's expressions.
WHITE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def strip(text: Column) -> Column:
    """White space of any kind off both ends; the whole text is only searched where an end is white space."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(F.regexp_like(ends, F.lit(f"[{WHITE}]")), F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{WHITE}]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def url_to_id(url: Column) -> Column:
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.substring(F.translate(bare, "/.", "__"), 1, 50)


def screenshot_name(url: Column, index: Column) -> Column:
    """File name for a rendered URL; a number where the name would be longer than 100."""
    bare = F.translate(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "/:", "__")
    return F.concat(F.when(F.length(bare) > 100, F.concat(F.lit("screenshot_"), index.cast("string"))).otherwise(bare), F.lit(".png"))


_BY_SUFFIX = {".pdf": "pdf", ".html": "html", ".htm": "html", ".docx": "docx", ".pptx": "pptx", ".md": "markdown"}


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return reduce(lambda c, kv: c.when(suffix == kv[0], kv[1]), list(_BY_SUFFIX.items())[1:], F.when(suffix == ".pdf", "pdf")).otherwise("other")


def data_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(image))


def category_by_name(name: Column, known: tuple[str, ...]) -> Column:
    """A category from an enumeration name of any case; the default is academic_paper."""
    return F.when(F.lower(name).isin(*known), F.lower(name)).otherwise("academic_paper")


def category_by_value(value: Column, known: tuple[str, ...]) -> Column:
    """A category by its exact value; anything else is an error that lists the valid ones."""
    return F.when(value.isin(*known), value).otherwise(F.raise_error(F.concat(F.lit("unknown category "), F.coalesce(value, F.lit("null")), F.lit("; valid: " + ", ".join(known)))))


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS...`` to a timestamp; anything else is null."""
    return F.try_to_timestamp(F.when(F.substring(raw, 1, 2) == "D:", F.substring(raw, 3, 14)), F.lit("yyyyMMddHHmmss"))


def split_list(raw: Column, pattern: str = ",") -> Column:
    """Trimmed, non-empty parts of a separated list; [] for null."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), pattern), strip)
    return F.filter(parts, lambda p: p != "")


def author_list(raw: Column) -> Column:
    return split_list(F.replace(raw, F.lit(";"), F.lit(",")))


# --- metrics that add up over the elements of a page or document ---

ADDITIVE = ("n", "n_blank", "chars", "alnum", "spaces", "bad", "words", "word_chars", "broken")


def element_counts(text: Column, clean: Column | None = None) -> dict[str, Column]:
    """Counts of one element. Joined text is never built: joining n texts by a space adds n - 1 characters of white space.

    All but the characters are counted in the words by one space each, found by one
    expression; ``clean`` gives them (:func:`clean_text`) where it is known, as within
    a lambda, which does not share what its parts have in common.
    """
    t = F.coalesce(text, F.lit(""))
    clean = clean_text(t) if clean is None else clean
    space, none = F.lit(" "), F.lit("")
    closed = F.replace(clean, space, none)
    n, word_chars = F.length(t).cast("long"), F.length(closed).cast("long")
    good = reduce(lambda c, x: F.replace(c, F.lit(x), none), ("\ufffd", "\x00", "\ufffe", "\uffff"), t)
    return {
        "n": F.lit(1).cast("long"),
        "n_blank": F.when(word_chars == 0, 1).otherwise(0).cast("long"),
        "chars": n,
        "alnum": chars_left(closed, r"[^\p{L}\p{N}]+"),
        "spaces": n - word_chars,
        "bad": n - F.length(good).cast("long"),
        "words": F.when(word_chars == 0, 0).otherwise(F.length(clean) - word_chars + 1).cast("long"),
        "word_chars": word_chars,
        "broken": count_of(F.concat(space, clean, space), r" [^ \p{L}\p{N}](?= )"),
    }


def text_ratios(s: dict[str, Column]) -> dict[str, Column]:
    """The six quality ratios from summed counts; an empty or blank text has the neutral defaults and empty_block_ratio 1."""
    total = s["chars"] + s["n"] - 1
    usable = (s["n"] > 0) & (s["words"] > 0)

    def ratio(a: Column, b: Column, default: float) -> Column:
        return F.when(usable, a.cast("double") / F.greatest(b, F.lit(1))).otherwise(F.lit(default))

    return {
        "alphanumeric_ratio": ratio(s["alnum"], total, 1.0),
        "replacement_char_ratio": ratio(s["bad"], total, 0.0),
        "whitespace_ratio": ratio(s["spaces"] + s["n"] - 1, total, 0.0),
        "avg_word_length": ratio(s["word_chars"], s["words"], 5.0),
        "broken_word_ratio": ratio(s["broken"], s["words"], 0.0),
        "empty_block_ratio": ratio(s["n_blank"], s["n"], 1.0),
    }


def _below(c: Column, *steps: tuple[float, float]) -> Column:
    return reduce(lambda w, s: w.when(c < s[0], s[1]), steps[1:], F.when(c < steps[0][0], steps[0][1])).otherwise(0.0)


def _above(c: Column, *steps: tuple[float, float]) -> Column:
    return reduce(lambda w, s: w.when(c > s[0], s[1]), steps[1:], F.when(c > steps[0][0], steps[0][1])).otherwise(0.0)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def text_score(r: dict[str, Column]) -> Column:
    return clamp(
        F.lit(1.0)
        - _below(r["alphanumeric_ratio"], (0.3, 0.4), (0.5, 0.2))
        - _above(r["replacement_char_ratio"], (0.05, 0.5), (0.01, 0.2))
        - _below(r["avg_word_length"], (2.0, 0.3), (3.0, 0.1))
        - _above(r["broken_word_ratio"], (0.3, 0.3), (0.1, 0.1))
        - _above(r["empty_block_ratio"], (0.5, 0.3), (0.2, 0.1))
    )


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.70, "medium").when(score >= 0.50, "low").otherwise("very_low")


def match_quality(score: Column) -> Column:
    return (
        F.when(score >= 0.99, "exact").when(score >= 0.95, "excellent").when(score >= 0.85, "good")
        .when(score >= 0.70, "fair").when(score >= 0.50, "poor").otherwise("failed")
    )


def accepted(score: Column, quality: Column) -> Column:
    return (score >= 0.85) & quality.isin("exact", "excellent", "good")


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not null, null if all are; added in the given order."""
    have = F.array_compact(F.array(*parts))
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have))
