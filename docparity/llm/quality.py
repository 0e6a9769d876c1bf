"""Quality rules: a table of thresholds compiled into one Spark projection.

No user function takes part: every metric is a built-in expression, so the
projection stays in the JVM, needs no shuffle and reads the text once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "the of and to in is that it was for on with as be by at this are an a "
    "la le de et les des un une que en du est pour dans qui par sur au pas "
    "el los las y por una para con se del al su "
    "der die und das den ist mit im zu von auf dem ein eine nicht sich als".split()
)
_SYMBOL = r"[#%&$*|<>{}~^\\_]"
#: Marks that end a word; what follows them up to the next white space is not looked at.
_MARKS = ".,;:!?"
#: Stop words behind their first letters, so most places fail at one character. What ends a word is not consumed, as it may begin the next match.
_STOP = r"(?:^|\s)(?:" + "|".join(f"{a}(?:{'|'.join(w[1:] for w in STOP_WORDS if w[0] == a)})" for a in sorted({w[0] for w in STOP_WORDS})) + rf")(?=$|[\s{_MARKS}])"


@dataclass(frozen=True)
class Rule:
    """Reject where ``metric`` is outside ``[low, high]``, for texts of ``from_words`` to ``to_words`` words (end excluded)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    to_words: int | None = None


RULES = (
    Rule("empty", "n_words", low=1),
    Rule("length", "n_chars", low=2, high=5_000_000),
    Rule("symbols", "symbol_ratio", high=0.015, from_words=5),
    Rule("shouting", "upper_ratio", high=0.3, from_words=10),
    Rule("word_length", "mean_word_chars", low=2, high=15, from_words=10),
    Rule("repeated_words_short", "distinct_word_ratio", low=0.45, from_words=10, to_words=400),
    Rule("repeated_words_long", "distinct_word_ratio", low=0.15, from_words=400),
    Rule("few_stop_words", "stop_word_ratio", low=0.06, from_words=50),
    Rule("repeated_lines", "distinct_line_ratio", low=0.4, from_words=20),
)
METRICS = ("n_chars", "n_words", "symbol_ratio", "upper_ratio", "mean_word_chars", "distinct_word_ratio", "stop_word_ratio", "distinct_line_ratio")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; filters are pushed below projections, so a column would not do."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _left(text: Column, pattern: str) -> Column:
    """Characters left when all runs of others are gone: one match for a run, so far fewer than characters."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def metrics(text: Column) -> Column:
    """Struct of the metrics. ``text`` must not be null."""
    return _let(F.struct(text.alias("t"), F.lower(text).alias("l")), lambda x: _let(F.split(x["l"], r"\s+"), lambda w: _let(_words(w), lambda n: _struct(x["t"], x["l"], w, n))))


def _words(parts: Column) -> Column:
    """Number of words; white space at an end leaves an empty part there."""
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("double")


def _struct(text: Column, lower: Column, parts: Column, words: Column) -> Column:
    chars, per_word = F.greatest(F.length(text), F.lit(1)).cast("double"), F.greatest(words, F.lit(1.0))
    lines = F.split(text, "\n")
    return F.struct(
        F.length(text).cast("double").alias("n_chars"),
        words.alias("n_words"),
        (_left(text, _SYMBOL.replace("[", "[^") + "+") / chars).alias("symbol_ratio"),
        (_left(text, r"\P{Lu}+") / chars).alias("upper_ratio"),
        (_left(text, r"\s+") / per_word).alias("mean_word_chars"),
        (F.size(F.array_distinct(parts)).cast("double") / per_word).alias("distinct_word_ratio"),
        (F.regexp_count(lower, F.lit(_STOP)).cast("double") / per_word).alias("stop_word_ratio"),
        (F.size(F.array_distinct(lines)).cast("double") / F.size(lines).cast("double")).alias("distinct_line_ratio"),
    )


def _broken(rule: Rule, metric, words, lit, both, either):
    outside = [x for x in (rule.low is not None and metric < lit(rule.low), rule.high is not None and metric > lit(rule.high)) if x is not False]
    bad = outside[0] if len(outside) == 1 else either(*outside)
    if rule.from_words:
        bad = both(bad, words >= lit(rule.from_words))
    if rule.to_words is not None:
        bad = both(bad, words < lit(rule.to_words))
    return bad


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of ``m`` (the metrics) and ``broken`` (names of broken rules, in table order).

    A null text is judged as an empty one: it breaks the rules ``empty`` and ``length``.
    """
    def judge(m: Column) -> Column:
        broken = [F.when(_broken(r, m[r.metric], m["n_words"], F.lit, lambda a, b: a & b, lambda a, b: a | b), F.lit(r.name)) for r in rules]
        return F.struct(m.alias("m"), F.array_compact(F.array(*broken)).alias("broken"))

    return _let(metrics(F.coalesce(text, F.lit(""))), judge)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, the metrics rounded to 6 places, ``broken`` (rule names joined by commas) and ``keep``.

    Null and empty texts break the rules ``empty`` and ``length``; a null ``doc_id`` stays null;
    repeated rows are judged one by one; other columns of ``docs``, whatever
    their names, are not read. An empty table gives an empty result.
    """
    out = docs.select("doc_id", verdict(F.col(text), rules).alias("v"))
    return out.select(
        "doc_id",
        *[F.round(F.col(f"v.m.{k}"), 6).alias(k) for k in METRICS],
        F.concat_ws(",", "v.broken").alias("broken"),
        (F.size("v.broken") == 0).alias("keep"),
    )


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns of ``docs``; null and empty texts go."""
    return docs.where(F.size(verdict(F.col(text), rules)["broken"]) == 0)


class _Sql(str):
    """SQL text with the comparisons the rule compiler uses."""

    def __lt__(self, other):
        return _Sql(f"{self} < {other}")

    def __gt__(self, other):
        return _Sql(f"{self} > {other}")

    def __ge__(self, other):
        return _Sql(f"{self} >= {other}")


def _white(pattern: str) -> str:
    """The pattern with white space spelled out."""
    return pattern.replace(r"[\s", r"[\x09-\x0D ").replace(r"\s", r"[\x09-\x0D ]").replace(r"\S", r"[^\x09-\x0D ]")


def _sql_metrics(table: str) -> str:
    # \\s leaves out the vertical tab in RE2, but not in Spark
    n = lambda p, of="t": f"len(regexp_extract_all({of}, '{_white(p)}'))::DOUBLE"
    words = n(r"\S+")
    per_word = f"greatest({words}, 1.0)"
    # told apart word by word, not by the expression that Spark counts
    heads = f"list_transform(regexp_split_to_array(lower(t), '{_white(r'\s+')}'), lambda x: regexp_extract(x, '^[^{_MARKS}]*'))"
    stops = f"len(list_filter({heads}, lambda x: x IN ({', '.join(repr(w) for w in dict.fromkeys(STOP_WORDS))})))::DOUBLE"
    return f"""
      SELECT doc_id, length(t)::DOUBLE AS n_chars, {words} AS n_words,
        {n(_SYMBOL)} / greatest(length(t), 1) AS symbol_ratio,
        {n(r'\p{Lu}')} / greatest(length(t), 1) AS upper_ratio,
        {n(r'\S')} / {per_word} AS mean_word_chars,
        len(list_distinct(regexp_split_to_array(lower(t), '[\\x09-\\x0D ]+')))::DOUBLE / {per_word} AS distinct_word_ratio,
        {stops} / {per_word} AS stop_word_ratio,
        len(list_distinct(string_split(t, chr(10))))::DOUBLE / len(string_split(t, chr(10))) AS distinct_line_ratio
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM {table})"""


def report_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for :func:`quality_report`, compiled from the same table."""
    broken = [
        f"CASE WHEN {_broken(r, _Sql(r.metric), _Sql('n_words'), str, lambda a, b: _Sql(f'({a}) AND ({b})'), lambda a, b: _Sql(f'({a}) OR ({b})'))} THEN '{r.name}' END"
        for r in rules
    ]
    return f"""
    WITH m AS ({_sql_metrics(table)}),
    j AS (SELECT *, concat_ws(',', {', '.join(broken)}) AS broken FROM m)
    SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in METRICS)}, broken, broken = '' AS keep FROM j"""
