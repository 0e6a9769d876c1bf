"""Confidence, escalation, equivalence, validators, reports, images: values worked out by hand or published."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from docparity.functions import geometry as G
from docparity.operators import confidence as C
from docparity.operators import equivalence as E
from docparity.operators import escalation as A
from docparity.operators import images, report, validators
from docparity.sources import spans

EL = "doc_id string, seq int, type string, content string, page int, x double, y double, width double, height double"
TR = "doc_id string, table_no int, page int, cells array<string>"


def scored(spark, elements, tables=(), title="T", figures=()):
    e = spark.createDataFrame(list(elements), EL)
    t = C.table_scores(spark.createDataFrame(list(tables), TR))
    f = spark.createDataFrame(list(figures), "doc_id string, page int, score double")
    pages = C.page_confidence(e, t, f)
    docs = spark.createDataFrame([("d", title)], "doc_id string, title string")
    return C.document_scores(docs, pages, t, f).first(), pages.collect()


def test_well_formed(spark):
    text = "A paragraph of ordinary length that reads like any other."
    els = [("d", 1, "heading", "Introduction to things", 1, 50.0, 50.0, 200.0, 20.0), ("d", 2, "paragraph", text, 1, 50.0, 90.0, 200.0, 50.0), ("d", 3, "paragraph", text, 1, 50.0, 160.0, 200.0, 50.0)]
    doc, _ = scored(spark, els, [("d", 1, 1, ["a", "b", "c"])] * 3)
    assert doc["overall_score"] == pytest.approx(1.0) and doc["level"] == "high"


def test_poor(spark):
    els = [("d", 1, "paragraph", "", 1, None, None, None, None), ("d", 2, "paragraph", "x y z ! @ # $ % ^", 1, None, None, None, None), ("d", 3, "paragraph", "��� test ��", 1, None, None, None, None)]
    doc, pages = scored(spark, els, [("d", 1, 1, ["a", "", ""]), ("d", 1, 1, ["", "", ""]), ("d", 1, 1, ["", "", ""])], title=None)
    assert doc["content_score"] == 0.4 and doc["structure_score"] == pytest.approx(0.6) and doc["table_score"] == pytest.approx(0.7) and doc["overall_score"] == pytest.approx(0.5)
    assert pages[0]["text_score"] == 0 and pages[0]["layout_score"] == 1


def test_empty_document(spark):
    doc, pages = scored(spark, [], title=None)
    assert doc["content_score"] == 0.3 and doc["overall_score"] == pytest.approx(0.4875) and pages == [] and doc["issues"] is None


def test_touching_boxes_overlap_but_have_no_common_area(spark):
    els = [("d", 1, "paragraph", "some words here", 1, 0.0, 0.0, 10.0, 10.0), ("d", 2, "paragraph", "some words here", 1, 10.0, 0.0, 10.0, 10.0)]
    _, pages = scored(spark, els)
    assert pages[0]["overlapping"]
    box = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    got = spark.range(1).select(G.iou(box(0.0), box(10.0)).alias("a"), G.iou(box(0.0), box(5.0)).alias("b"), G.iou(box(0.0), box(0.0)).alias("c")).first()
    assert (got["a"], got["c"]) == (0.0, 1.0) and got["b"] == pytest.approx(1 / 3)


def test_table_without_rows(spark):
    assert C.table_scores(spark.createDataFrame([("d", 1, 1, None)], TR)).first()["score"] == 0.3


def test_prefix_and_presets():
    assert A.stages_up_to("marker") == ("pymupdf", "marker") and A.stages_up_to("unknown") == A.STAGES


def test_ties_keep_the_earlier_stage(spark):
    a = spark.createDataFrame([("d", 0, True, 0.5), ("d", 1, True, 0.5), ("e", 0, False, None)], "doc_id string, stage int, success boolean, overall double")
    got = {r["doc_id"]: r for r in A.best_attempt(a, ["doc_id"]).collect()}
    assert got["d"]["stage"] == 0 and got["d"]["error"] is None and got["e"]["error"] == "all parsers failed"


SIDE = "doc_id string, title string, authors array<string>, keywords array<string>, content array<struct<type:string,content:string>>, figures array<struct<bbox:struct<page:int,x:double,y:double,width:double,height:double>>>, tables array<struct<rows:array<array<string>>>>"


def compared(spark, a, b):
    return E.compare(spark.createDataFrame([("d", *a)], SIDE), spark.createDataFrame([("d", *b)], SIDE)).first()


def test_equivalence_goldens(spark):
    a = ("Machine Learning for Document Analysis", ["A"], ["k"], [("paragraph", "x y z")], [], [([["1", "2"]],)])
    same = compared(spark, a, a)
    assert same["score"] == pytest.approx(1.0) and same["match_quality"] == "exact" and same["warnings"] == [] and same["title_difference"] is None
    empty = (None, [], [], [], [], [])
    none = compared(spark, empty, empty)
    assert none["score"] == pytest.approx(0.9) and none["match_quality"] == "good"


def test_blog_pair(spark):
    a = ("Post", ["W"], ["blog", "test"], [("paragraph", "This is the first paragraph of the blog post.")], [], [])
    b = ("Post", ["W"], ["blog"], [("paragraph", "This is the first paragraph of the blog.")], [], [])
    got = compared(spark, a, b)
    assert got["metadata_score"] == pytest.approx((1 + 1 + 0.5) / 3) and got["match_quality"] in ("good", "excellent")


def test_title_on_one_side(spark):
    a, b = ("T", [], [], [("p", "a")], [], []), (None, [], [], [("p", "a")], [], [])
    got = compared(spark, a, b)
    assert got["metadata_score"] == 0.0 and got["title_difference"]["tool"] == "T"


def test_different_text_warns(spark):
    got = compared(spark, (None, [], [], [("p", "aaaa")], [], []), (None, [], [], [("p", "zzzz")], [], []))
    assert got["warnings"] == ["Text similarity (0.00%) below threshold (85.00%)"]


def test_figures_without_common_page(spark):
    box = lambda p: [((p, 0.0, 0.0, 5.0, 5.0),)]
    got = compared(spark, (None, [], [], [], box(1), []), (None, [], [], [], box(2), []))
    assert got["figures_score"] == 0.5


def test_validators(spark):
    flat = "doc_id int, category string, title string, n_authors int, abstract string, publish_date timestamp, n_keywords int, n_content int, n_figures int, n_tables int, n_links int, text string"
    rows = [(1, "blog_post", "t", 1, None, datetime(2024, 1, 1), 1, 5, 0, 0, 0, ""), (2, "report", None, 0, None, None, 0, 0, 0, 0, 0, "")]
    got = {r["doc_id"]: r for r in validators.validate(spark.createDataFrame(rows, flat)).collect()}
    assert got[1]["passed"] and got[1]["score"] == 1.0 and got[1]["issues"] == []
    assert not got[2]["passed"] and got[2]["score"] == pytest.approx(1 - 2.5 / 4)
    with pytest.raises(Exception, match="no validator"):
        validators.validate(spark.createDataFrame([(3, "tutorial", *rows[0][2:])], flat)).collect()
    assert validators.validate(spark.createDataFrame([(3, "tutorial", *rows[0][2:])], flat), unknown="skip").first()["score"] is None


def test_report_formats(spark):
    r = report.summary(spark.createDataFrame([(0.9, "good"), (0.6, "poor")], "score double, match_quality string")).first()
    d = report.as_dict(r, "run", datetime(2024, 1, 1))
    assert not d["passed"] and d["summary"]["quality_distribution"] == {"good": 1, "poor": 1} and "visual_pass_rate" not in d["summary"]
    assert "| poor | 1 |" in report.formatted(d, "markdown") and "FAILED" in report.formatted(d) and report.formatted(d, "json").startswith("{")
    with pytest.raises(ValueError):
        report.formatted(d, "html")
    none = report.as_dict(report.summary(spark.createDataFrame([], "score double, match_quality string")).first(), "none", datetime(2024, 1, 1))
    assert none["passed"] and "avg_score" not in none["summary"]


def test_images():
    white = np.full((200, 200, 3), 255, np.uint8)
    white[50:100, 50:100] = (0, 0, 255)
    same = images.compare(white, white)
    assert same["similarity_score"] == pytest.approx(1.0) and same["pixel_diff_count"] == 0 and same["passed"]
    dot = white.copy()
    dot[10:20, 10:20] = (255, 0, 0)
    found = images.compare(white, dot)
    assert found["pixel_diff_count"] == 100 and found["diff_percentage"] == 0.25 and found["similarity_score"] < 1 and not found["passed"]
    assert images.compare(white, dot, ignore=[(5, 5, 20, 20)])["pixel_diff_count"] == 0
    assert images.compare(white, images.resized(white, 300, 300))["total_pixels"] == 40_000
    flat = np.full((30, 20, 3), 77, np.uint8)
    assert (images.resized(flat, 45, 13) == 77).all()


def test_page_out_of_range(spark):
    s = spark.createDataFrame([("d", 1, 1, 0, 0, 0, "a", 1.0, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    assert spans.page_text(s, 1).first()["text"] == "a"
    with pytest.raises(Exception, match="out of range"):
        spans.page_text(s, 2).collect()


def test_images_are_not_broadcast(spark):
    few = spark.range(3).select(F.col("id").alias("img_id"))
    pixels = few.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr("img_id", "y", "x", "x * 9 AS r", "y AS g", "0 AS b")
    found = images.pixel_diff_long(pixels, pixels.withColumn("r", F.when(F.col("x") == 2, 1).otherwise(F.col("r"))))
    whole = few.select("img_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.expr("unhex(repeat('0A', 192))").alias("rgb"))
    compared = images.compare_images(whole, whole, with_diff=False)
    for d in (found, compared):
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert [(r["pixel_diff_count"], r["total_pixels"]) for r in found.collect()] == [(8, 64)] * 3
    assert all(r["passed"] for r in compared.collect())
