"""Strings, boxes, markdown, JSON: published values and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from docparity.functions import similarity as S
from docparity.functions import text as T
from docparity.sources import markdown, model_json


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


_SAME = "Document analysis is"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (f"{_SAME} critical.", f"{_SAME} essential.", 0.85), ("ML for natural language processing", "Machine learning for NLP", 0.31),
        ("", "", 1.0), ("Completely different text", "Another unrelated sentence", 0.39), ("", "a", 0.0), ("abc", "abc", 1.0),
    ],
)
def test_ratio(a, b, want):
    assert S.ratio(a, b) == want


def test_lcs_against_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcdeé", k=rng.randrange(0, 90))) for _ in range(2))
        assert S.lcs_length(a, b) == slow(a, b)


def test_token_sort_ignores_case(spark):
    assert one(spark, S.token_sort_ratio(F.lit("HELLO  world"), F.lit("World-hello"))) == 1.0
    assert one(spark, S.token_sorted(F.lit("b, A_c é"))) == "a b c"


def test_null_ratio(spark):
    assert one(spark, S.indel_ratio(F.lit(None).cast("string"), F.lit("a"))) is None


def elements(spark, f, text):
    return [(e["seq"], e["type"], e["content"], e["level"]) for e in one(spark, f(F.col("t")), t=text)]


def test_markdown_levels(spark):
    assert [e[3] for e in elements(spark, markdown.merged_elements, "# Level 1\n## Level 2\n### Level 3")] == [1, 2, 3]


def test_markdown_paragraphs(spark):
    text = "one\n\n\n  two\nstill two  \n#head\nthree"
    assert elements(spark, markdown.merged_elements, text) == [(1, "paragraph", "one", None), (2, "paragraph", "two still two", None), (3, "heading", "head", 1), (4, "paragraph", "three", None)]
    assert [e[2] for e in elements(spark, markdown.line_elements, text)] == ["one", "two", "still two", "head", "three"]


@pytest.mark.parametrize("text", [None, "", "  \n \t\n"])
def test_markdown_empty(spark, text):
    assert elements(spark, markdown.merged_elements, text) == [] == elements(spark, markdown.line_elements, text)


def test_markdown_edges(spark):
    assert elements(spark, markdown.merged_elements, "####### deep\n#\n") == [(1, "heading", "deep", 7), (2, "heading", "", 1)]
    assert one(spark, markdown.heading_map(F.col("t")), t="# H1\n## H2\n## H2") == {1: 1, 2: 2}
    assert one(spark, markdown.first_heading(F.col("t")), t="x\n  ## A b \n# c") == "A b"
    assert one(spark, markdown.first_heading(F.col("t")), t="x") is None


def test_json(spark):
    kind = "struct<title:string,n:int>"
    f = lambda t: one(spark, model_json.json_or_embedded(F.col("t"), kind), t=t)
    assert f('{"title": "a", "n": 1}')["title"] == "a"
    assert f('So: {"title": "a"} done')["title"] == "a"
    assert f("nothing") is None and f(None) is None and f("{broken") is None
    fenced = one(spark, model_json.fenced_json(F.col("t"), kind), t='x\n```json\n{"n": 3}\n```')
    assert fenced["value"]["n"] == 3 and fenced["error"] is None
    bad = one(spark, model_json.fenced_json(F.col("t"), kind), t="```\nno\n```")
    assert bad["error"] == "invalid JSON" and bad["raw_response"].startswith("```")
    with pytest.raises(Exception, match="no JSON"):
        one(spark, model_json.json_or_error(F.col("t"), kind), t="nothing")


def test_document_from_answer(spark):
    raw = '{"title":"T","authors":["A"],"date":"2024-05-01","content":[{"level":2,"text":"h","type":"heading"},{"text":"p"}],"tables":[{"data":[["1"]],"rows":[["2"]],"label":"L"}],"links":[{"text":"x","url":"u"}]}'
    plain = one(spark, model_json.to_document(F.lit("d"), model_json.json_or_embedded(F.col("t"))), t=raw)
    assert [c["id"] for c in plain["content"]] == ["vlm_c0", "vlm_c1"] and plain["content"][1]["type"] == "paragraph"
    assert plain["links"] == [] and plain["category"] is None and plain["tables"][0]["rows"] == [["1"]] and plain["tables"][0]["label"] is None
    full = one(spark, model_json.to_document(F.lit("d"), model_json.json_or_embedded(F.col("t")), F.lit("report"), with_links=True), t=raw)
    assert full["links"][0]["id"] == "vlm_l0" and full["tables"][0]["rows"] == [["2"]] and full["tables"][0]["label"] == "L" and full["metadata"]["date"].year == 2024


def test_dates_and_lists(spark):
    assert str(one(spark, T.pdf_date(F.col("t")), t="D:20240131235959Z")) == "2024-01-31 23:59:59"
    assert one(spark, T.pdf_date(F.col("t")), t="D:2024") is None and one(spark, T.pdf_date(F.col("t")), t="2024-01-31") is None
    assert one(spark, T.author_list(F.col("t")), t="A; B,, C ") == ["A", "B", "C"] and one(spark, T.author_list(F.col("t")), t=None) == []


@pytest.mark.parametrize(("score", "level"), [(0.85, "high"), (0.84, "medium"), (0.70, "medium"), (0.69, "low"), (0.50, "low"), (0.49, "very_low")])
def test_levels(spark, score, level):
    assert one(spark, T.confidence_level(F.lit(score))) == level


def test_white_space_is_unicode(spark):
    assert one(spark, T.strip(F.lit("  a b　\x1c"))) == "a b"


def test_long_text_that_lost_parts():
    import random
    import time

    r = random.Random(5)
    words = sorted("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(60_000))
    a, b = " ".join(words), " ".join(w for w in words if r.random() < 0.8)
    t = time.perf_counter()
    assert S.lcs_length(a, b) == S.lcs_length(b, a) == len(b)
    assert time.perf_counter() - t < 1.5
    assert S.lcs_length("abcabd", "dab") == 2 and S.lcs_length("", "x") == 0 and S.lcs_length("axbxc", "abc") == 3


def test_tokens_are_split_before_they_are_lower_case(spark):
    assert one(spark, S.token_sorted(F.col("t")), t="İX, É ΑΣ b--A_2 ") == "2 a b i̇x ας"
    assert one(spark, S.token_sorted(F.col("t")), t="?? ") == "" and one(spark, S.token_sorted(F.col("t")), t=None) == ""


@pytest.mark.parametrize("text", ["", "a ! b\u0085\U0001f600 \U0001f600x ! ! ,\x1c", "\x00�￿ .", " \t\n", "x", "\U0001d400 # #", " � "])
def test_counts_of_an_element(spark, text):
    words = text.split()
    k = T.element_counts(F.col("t"))
    got = one(spark, F.struct(*[v.alias(n) for n, v in k.items()]), t=text).asDict()
    broken = sum(len(w) == 1 and not w.isalnum() for w in words)
    assert got == {
        "n": 1, "n_blank": int(not words), "chars": len(text), "alnum": sum(map(str.isalnum, text)), "spaces": sum(map(str.isspace, text)), "bad": sum(c in "�\x00￾￿" for c in text),
        "words": len(words), "word_chars": sum(map(len, words)), "broken": broken,
    }
    plan = spark.createDataFrame([(text,)], "t string").select(*[v.alias(n) for n, v in k.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<!" not in plan
