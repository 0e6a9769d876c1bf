"""HTML edge cases, files, sinks, streaming."""

import pytest
from pyspark.sql import functions as F

from docparity import sinks
from docparity.sources import converters, files, html, model_json, spans
from docparity.streaming import ingest

PAGE = """<html><head><title> T &amp; t </title><meta name="author" content="A, B"><meta name=keywords content="x, ,y"></head><body>
<main><article class="blog-post"><h1>Head</h1><p>One<p>Two <b>bold</b> text<script>var x = "<p>no</p>"</script>
<figure><img src=a><figcaption> Cap </figcaption></figure><figure>none</figure><img alt="loose"><img alt="">
<table></table><table><caption>C</caption><thead><tr><th colspan=2>h</thead><tbody><tr><td>1</td><td>2<table><tr><td>in</table></td></tr></table>
<p>ab</p><a href="#x">skip</a><a href="/u">first</a><a href="/u">again</a><a href="/v"><img></a><a name=z>no href</a></article></main><p>outside</p></body></html>"""


def test_extract():
    d = html.extract(PAGE)
    assert d["title"] == "T & t" and d["authors"] == ["A, B"] and d["keywords"] == ["x", "y"] and d["inferred"] == "blog_post"
    assert [(c["id"], c["type"], c["content"], c["level"]) for c in d["content"]] == [("elem_1", "heading", "Head", 1), ("elem_2", "paragraph", "One", None), ("elem_3", "paragraph", "Two bold text", None)]
    assert [(f["id"], f["caption"], f["label"]) for f in d["figures"]] == [("fig_1", "Cap", "Figure 1"), ("fig_2", "loose", None)]
    assert [(t["id"], t["label"], t["rows"]) for t in d["tables"]] == [("table_2", "Table 2", [["h"], ["1", "2 in", "in"], ["in"]]), ("table_3", None, [["in"]])]
    assert [(x["id"], x["url"]) for x in d["links"]] == [("link_2", "/u")]


@pytest.mark.parametrize("text", ["", "<html><body></html>", "no tags at all", "<", "<p", "</p></div>", "<!-- open"])
def test_extract_oddities(text):
    d = html.extract(text)
    assert d["content"] == [] and d["tables"] == [] and d["links"] == [] and d["inferred"] is None


def test_many_elements():
    d = html.extract("".join(f"<h2>Section {i}</h2><p>Paragraph {i}" for i in range(100)))
    assert len(d["content"]) == 200


def test_deep_nesting():
    assert html.extract("<div>" * 20_000 + "<p>deep text</p>")["content"][0]["content"] == "deep text"


def test_expressions_agree_with_the_tree(spark):
    row = spark.createDataFrame([(PAGE,)], "html string").select(html.title(F.col("html")).alias("t"), html.authors(F.col("html")).alias("a"), html.category_of(F.col("html")).alias("c"), html.main_region(F.col("html")).alias("r")).first()
    assert (row["t"], row["a"], row["c"], row["r"]) == ("T & t", ["A, B"], "blog_post", "main")


def test_parse_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.b/c", "", None), (None, "u", PAGE, "y")], "page_id long, url string, html string, id string")
    got = {r["page_id"]: r for r in html.parse(pages).collect()}
    assert got[1]["content"] is None and got[1]["id"] == "html_doc" and got[2]["content"] == [] and got[2]["id"] == "a_b_c" and len(got[None]["content"]) == 3
    assert html.parse(pages.limit(0)).collect() == []


def test_files(spark, tmp_path):
    for i in range(25):
        (tmp_path / f"f{i:02}.pdf").write_bytes(b"x" * (i + 1))
    listed = files.list_files(spark, f"file://{tmp_path}").collect()
    assert len(listed) == 20 and listed[3]["size"] == 4 and listed[0]["format"] == "pdf"
    (tmp_path / "a.html").write_text("<title>q</title>\n<p>para graph")
    assert files.read_html(spark, f"file://{tmp_path}/a.html").select(html.title(F.col("html")).alias("t")).first()["t"] == "q"
    ok, why = files.ModelConfig.from_session(spark).validate()
    assert not ok and why
    assert files.ModelConfig(key="k").validate()[0]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id int, text string")
    sinks.write_json(d, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.write_converted(d, f"{tmp_path}/c")
    assert (tmp_path / "c/md/doc_id=1").is_dir()
    sinks.write_workflow(d, d, d, f"{tmp_path}/w")
    assert (tmp_path / "w/comparison").is_dir()
    (tmp_path / "img").mkdir()
    assert sinks.write_binary_files(spark.createDataFrame([("a.raw", b"12"), ("b.raw", None)], "img_id string, diff_image binary"), str(tmp_path / "img")) == 1
    assert (tmp_path / "img/a.raw").read_bytes() == b"12"


def test_stream_is_the_batch(spark, tmp_path):
    d = spark.createDataFrame([(1, "good words in here"), (2, ""), (3, None)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/in")
    s = ingest.text_scores(ingest.read_documents(spark, f"{tmp_path}/in", "doc_id long, text string"))
    ingest.write_stream(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(map(tuple, ingest.text_scores(d).collect()), key=str)


def test_windows_have_a_watermark(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:01:00' as ts, 's' as source, 'some good words' as text").write.parquet(f"{tmp_path}/in")
    s = ingest.windowed_scores(ingest.text_scores(ingest.read_documents(spark, f"{tmp_path}/in", "ts timestamp, source string, text string")), "ts")
    assert s.isStreaming and s.columns == ["w", "source", "n", "avg_score", "weak"]


def test_converters(spark):
    def convert(data: bytes) -> str:
        return data.decode()

    given = spark.createDataFrame([("a", b"# T\ntext\nmore"), ("b", b"\xff"), ("c", b"")], "path string, content binary")
    got = {r["path"]: r for r in converters.merged_or_whole(converters.to_markdown(given, convert)).collect()}
    assert [e["content"] for e in got["a"]["elements"]] == ["T", "text more"] and got["a"]["error"] is None
    assert "Unicode" in got["b"]["error"] and [e["content"] for e in got["c"]["elements"]] == [""]


def test_a_broken_file_is_a_row(spark):
    given = spark.createDataFrame([("a", b"one\n\n  two"), ("b", b"\xff"), ("c", None), ("d", b" \n")], "path string, content binary")
    got = converters.to_spans(given, converters.plain_spans).collect()
    assert sorted((r["doc_id"], r["block"], r["text"]) for r in got if r["error"] is None) == [("a", 0, "one"), ("a", 2, "  two")]
    failed = {r["doc_id"]: r["error"] for r in got if r["error"] is not None}
    assert set(failed) == {"b", "c"} and failed["b"].startswith("UnicodeDecodeError")
    made = {r["path"]: (r["json"], r["error"]) for r in converters.to_json(given, lambda b: {"n": len(b), "odd": {1}}).collect()}
    assert made["a"] == ('{"n":10,"odd":"{1}"}', None) and made["c"][0] is None and "TypeError" in made["c"][1]


def test_pdf_reader(spark):
    got = converters.pdf_spans(spark.createDataFrame([("x.pdf", b"no pdf")], "path string, content binary")).collect()
    assert len(got) == 1 and got[0]["doc_id"] == "x.pdf" and got[0]["error"] and got[0]["text"] is None


def test_described(spark):
    rows = [(1, ("T", "# h\nline", None, 2, ["a", None])), (2, (None, None, "whole", None, None)), (3, None), (4, (None, None, None, 0, []))]
    got = {r["k"]: r["d"] for r in spark.createDataFrame(rows, f"k int, a {converters.DESCRIBED}").select("k", converters.described(F.col("a")).alias("d")).collect()}
    assert [tuple(e) for e in got[1]["content"]] == [("elem_1", "heading", "h", 1), ("elem_2", "paragraph", "line", None)]
    assert [tuple(t) for t in got[1]["tables"]] == [("table_1", []), ("table_2", [])] and [tuple(f) for f in got[1]["figures"]] == [("figure_1", "a"), ("figure_2", None)]
    assert [e["content"] for e in got[2]["content"]] == ["whole"] and all(got[k]["content"] == got[k]["tables"] == got[k]["figures"] == [] for k in (3, 4))


def test_tables_by_where_words_stand(spark):
    words = [(1, 1, w, float(x), float(y), x + 10.0, y + 8.0) for w, x, y in (
        ("a", 50, 100), ("b", 101, 101), ("c", 200, 99), ("d", 51, 120), ("e", 102, 121), ("f", 112, 120), ("g", 49, 140), ("h", 201, 141), ("i", 100, 142), ("j", 199, 160), ("k", 30, 180))]
    words += [(1, 2, "lonely", 50.0, 10.0, 60.0, 18.0), (2, 1, None, 50.0, 10.0, 60.0, 18.0), (2, 1, "x", None, None, None, None)]
    table = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = spans.text_tables(table).collect()
    assert [(r["doc_id"], r["id"], r["rows"]) for r in got] == [(1, "tab_p1_t1", [["a", "b", "c"], ["d", "e f", ""], ["g", "i", "h"], ["", "", "j"], ["k", "", ""]])]
    assert (got[0]["x0"], got[0]["y0"], got[0]["x1"], got[0]["y1"]) == (30.0, 99.0, 211.0, 188.0)
    strict = spans.TableSettings("text", "text", min_words_horizontal=2)
    assert spans.found_tables(strict, words=table).first()["rows"] == [["a", "b c"], ["d", "e f"], ["g", "i h"]]
    with pytest.raises(ValueError, match="strategies"):
        spans.found_tables(spans.TableSettings("text", "lines"), words=table)


def test_table_answers(spark):
    raw = ['{"rows": [["a", null], null], "label": "Table 1"}', "```json\n{\"rows\": []}\n```", "none", '{"caption": "x"}', None]
    got = spark.createDataFrame(list(enumerate(raw)), "k int, raw string").select("k", model_json.table_answer(F.col("raw")).alias("a")).orderBy("k").collect()
    assert got[0]["a"]["value"]["rows"] == [["a", ""], []] and got[0]["a"]["value"]["id"] == "table_1" and got[1]["a"]["value"]["rows"] == []
    assert [r["a"]["error"] is not None for r in got] == [False, False, True, True, False] and got[4]["a"]["value"] is None


def test_entities_need_their_semicolon():
    d = html.extract('<title>a &amp; b&amp</title><h1>x&lt;y &copy 5&amp;&am</h1><p>AT&T &quot;q&quot; &notit; &#38; &</p><a href="/?a=1&copy=2&amp;b">l&amp</a><p><xmp>&amp;</xmp> end')
    assert d["title"] == "a & b&amp"
    assert [e["content"] for e in d["content"]][:2] == ["x<y &copy 5&&am", 'AT&T "q" &notit; & &']
    assert d["links"] == [{"id": "link_1", "text": "l&amp", "url": "/?a=1&copy=2&b"}]


def test_boxes_and_text_tables_hold_one_aggregation(spark):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    cells = spark.createDataFrame([("d", 1, 3, None, 0, "x", 0.0, 5.0, 9.0, 8.0), ("d", 1, 3, 2, 0, "y", 1.0, 9.0, 8.0, 12.0), ("d", 1, 3, 2, 1, None, 9.0, 9.0, 20.0, 12.0), ("d", 1, 1, 1, 0, "z", 0.0, 0.0, 1.0, 1.0), ("d", None, 1, 1, 0, "z", 0.0, 0.0, 1.0, 1.0)],
                                  "doc_id string, page int, table int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double")
    none = spark.createDataFrame([], "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    found = spans.service_boxes(none, cells, 72.0)
    assert "Join" not in plan(found) and "collect_list" not in plan(found)
    assert sorted((r["id"], r["content"], r["width"], r["height"]) for r in found.collect()) == [("tool_table_0", "Table (1 rows × 1 cols)", 1.0, 1.0), ("tool_table_1", "Table (2 rows × 1 cols)", 20.0, 7.0)]
    at = [(x, y) for y in (0.0, 1.0, 10.0, 20.0, 40.0) for x in (0.0, 50.0 + y % 3)] + [(200.0, 30.0)]
    words = spark.createDataFrame([("d", 1, f"{i}", x, y, x + 5, y + 5) for i, (x, y) in enumerate(at)] + [("d", 2, "a", 0.0, 0.0, 1.0, 1.0), ("d", None, "a", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    tables = spans.text_tables(words, spans.TableSettings("text", "text", min_words_horizontal=2))
    assert "Window" not in plan(tables) and "Join" not in plan(tables)
    r = tables.collect()
    assert [x["rows"] for x in r] == [[["0 2", "1 3"], ["4", "5"], ["6", "7"], ["8", "9"]]] and (r[0]["x1"], r[0]["y1"]) == (57.0, 45.0)
