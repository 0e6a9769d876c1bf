"""Registered queries of the sources: markdown, HTML, spans and tables, model answers, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docparity import schemas
from docparity.functions import geometry as G
from docparity.functions import text as T
from docparity.plans import inputs as I
from docparity.plans.registry import query, r6, r6_sql
from docparity.sources import converters, files, html, markdown, model_json, spans

_W = T.WHITE

# --- markdown ---

_COLS = "doc_id, id, seq, type, content, level"


@query("m2_line_elements", f"WITH {I.EL} SELECT doc_id, 'elem_' || seq AS id, seq, type, content, level FROM el")
def line_elements(spark, sf_dir):
    return markdown.exploded(I.markdown(spark, sf_dir), markdown.line_elements(F.col("md")))


@query("m1_merged_elements", f"""WITH {I.MD},
ln AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS no FROM md),
st AS (SELECT doc_id, no, {I.strip_sql('line')} AS line FROM ln),
br AS (SELECT *, line LIKE '#%' AS head, line = '' OR line LIKE '#%' OR coalesce(lag(line = '' OR line LIKE '#%') OVER (PARTITION BY doc_id ORDER BY no), true) AS starts FROM st),
gr AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY no) AS g FROM br),
bk AS (SELECT doc_id, g, bool_or(head) AS head, string_agg(line, ' ' ORDER BY no) AS line FROM gr WHERE line <> '' GROUP BY doc_id, g),
nu AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INTEGER AS seq FROM bk)
SELECT doc_id, 'elem_' || seq AS id, seq, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN head THEN {I.strip_sql("regexp_replace(line, '^#+', '')")} ELSE line END AS content,
  CASE WHEN head THEN len(regexp_extract(line, '^#+'))::INTEGER END AS level FROM nu""")  # fmt: skip
def merged_elements(spark, sf_dir):
    return markdown.exploded(I.markdown(spark, sf_dir), markdown.merged_elements(F.col("md")))


@query("m3_first_heading", f"WITH {I.EL} SELECT doc_id, first(content ORDER BY seq) AS title FROM el WHERE type = 'heading' GROUP BY doc_id")
def first_heading(spark, sf_dir):
    return I.markdown(spark, sf_dir).select("doc_id", markdown.first_heading(F.col("md")).alias("title"))


@query("m4_heading_counts", f"WITH {I.EL} SELECT doc_id, level, count(*) AS n FROM el WHERE level BETWEEN 1 AND 6 GROUP BY ALL")
def heading_counts(spark, sf_dir):
    return markdown.heading_counts(I.markdown(spark, sf_dir), "md")


@query("s5_s6_fallback", f"""WITH {I.EL}, n AS (SELECT doc_id, count(*) FILTER (type = 'paragraph') AS paragraphs FROM el GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.doc_id % 10 = 0 THEN 1 ELSE n.paragraphs END::BIGINT AS paragraphs FROM documents JOIN n USING (doc_id)""")  # fmt: skip
def fallback(spark, sf_dir):
    """Where an extractor gave nothing (every tenth document) the whole text is one paragraph."""
    d = I.markdown(spark, sf_dir)
    made = F.when(F.col("doc_id") % 10 != 0, markdown.line_elements(F.col("md")))
    whole = F.array(F.struct(F.lit(1).alias("seq"), F.lit("paragraph").alias("type"), F.col("md").alias("content"), F.lit(None).cast("int").alias("level")))
    return d.select("doc_id", F.size(F.filter(F.coalesce(made, whole), lambda e: e["type"] == "paragraph")).cast("long").alias("paragraphs"))


# --- HTML ---

_CODE = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<!--.*?-->', '', 'g')"
_ENT = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_CLEAN = lambda x: f"trim(regexp_replace({_ENT.format(f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')")}, '[{_W}]+', ' ', 'g'))"
_TITLE = f"CASE WHEN page_id % 9 = 0 THEN 'Graph title' ELSE {I.strip_sql(_ENT.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} END"


@query("h1_title", f"WITH {I.RP} SELECT page_id, {_TITLE} AS title FROM rp")
def h_title(spark, sf_dir):
    return I.rich_pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


@query("h2_h3_metadata", f"WITH {I.RP} SELECT page_id, ['A. Writer, B. ' || page_id] AS authors, ['one', 'k' || page_id % 7] AS keywords FROM rp")
def h_metadata(spark, sf_dir):
    return I.rich_pages(spark, sf_dir).select("page_id", html.authors(F.col("html")).alias("authors"), html.keywords(F.col("html")).alias("keywords"))


@query("h3_keywords_from_description", f"WITH {I.RP} SELECT page_id, ['first second third fourth fifth'] AS keywords FROM rp")
def h_described(spark, sf_dir):
    p = I.rich_pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "<meta name=\"keywords\"[^>]*>", ""))
    return p.select("page_id", html.keywords(F.col("html")).alias("keywords"))


@query("h4_stripped", f"SELECT page_id, {_CODE} AS html FROM pages")
def h_stripped(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", html.without_code(F.col("html")).alias("html"))


@query("h5_h12_region_category", """SELECT page_id, 'article' AS region, CASE WHEN page_id % 4 = 1 THEN 'academic_paper' WHEN page_id % 4 = 2 THEN 'blog_post' ELSE 'webpage_general' END AS category FROM pages""")
def h_region(spark, sf_dir):
    kind = F.when(F.col("page_id") % 4 == 1, '<article class="x Abstract">').when(F.col("page_id") % 4 == 2, '<article class="my-blog">').otherwise("<article>")
    p = I.table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<article>"), kind))
    return p.select("page_id", html.main_region(F.col("html")).alias("region"), html.category_of(F.col("html")).alias("category"))


_PIECES = f"""{I.RP},
ar AS (SELECT page_id, regexp_extract({_CODE}, '(?s)<article>(.*)</article>', 1) AS a FROM rp),
pc AS (SELECT page_id, unnest(string_split(regexp_replace(a, '<(h1|p)>', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:]) AS x FROM ar),
no AS (SELECT page_id, x, row_number() OVER () AS r FROM pc),
cl AS (SELECT page_id, r, string_split(x, chr(2))[1] AS tag, {_CLEAN("regexp_replace(string_split(x, chr(2))[2], '(?s)</p>.*|</h1>.*|<figure>.*', '')")} AS content FROM no)"""


@query("h6_content", f"""WITH {_PIECES} SELECT page_id, 'elem_' || row_number() OVER (PARTITION BY page_id ORDER BY r) AS id, CASE WHEN tag = 'h1' THEN 'heading' ELSE 'paragraph' END AS type, content, CASE WHEN tag = 'h1' THEN 1 END::INTEGER AS level
FROM cl WHERE len(content) >= 3""")  # fmt: skip
def h_content(spark, sf_dir):
    return html.parse(I.rich_pages(spark, sf_dir), parts=("content",)).select("page_id", F.explode("content").alias("e")).select("page_id", "e.*")


@query("h7_figures", "SELECT page_id, 'fig_1' AS id, 'Shown ' || page_id AS caption, 'Figure 1' AS label FROM pages UNION ALL SELECT page_id, 'fig_2', 'loose', NULL FROM pages")
def h_figures(spark, sf_dir):
    return html.parse(I.rich_pages(spark, sf_dir), parts=("figures",)).select("page_id", F.explode("figures").alias("e")).select("page_id", "e.*")


@query("h8_tables", "SELECT page_id, 'table_2' AS id, 'Cap' AS caption, 'Table 2' AS label, 'h1|h2;a b|' || page_id AS rows FROM pages")
def h_tables(spark, sf_dir):
    t = html.parse(I.rich_pages(spark, sf_dir), parts=("tables",)).select("page_id", F.explode("tables").alias("e"))
    return t.select("page_id", "e.id", "e.caption", "e.label", F.concat_ws(";", F.transform("e.rows", lambda r: F.concat_ws("|", r))).alias("rows"))


_A = '(?s)<a href="([^"]*)">(.*?)</a>'


@query("h9_links", f"""WITH {I.RP}, st AS (SELECT page_id, {_CODE} AS h FROM rp),
al AS (SELECT page_id, unnest(regexp_extract_all(h, '{_A}', 1)) AS u, unnest(regexp_extract_all(h, '{_A}', 2)) AS raw, unnest(range(1, len(regexp_extract_all(h, '{_A}', 1)) + 1)) AS k FROM st),
ct AS (SELECT page_id, k, u, {_CLEAN('raw')} AS t FROM al)
SELECT page_id, 'link_' || k AS id, t AS text, u AS url FROM ct WHERE t <> '' AND u NOT LIKE '#%' QUALIFY row_number() OVER (PARTITION BY page_id, u ORDER BY k) = 1""")  # fmt: skip
def h_links(spark, sf_dir):
    return html.parse(I.rich_pages(spark, sf_dir), parts=("links",)).select("page_id", F.explode("links").alias("e")).select("page_id", "e.*")


@query("h10_plain_text", f"WITH {I.RP} SELECT page_id, {_CLEAN(_CODE)} AS text FROM rp")
def h_plain(spark, sf_dir):
    return I.rich_pages(spark, sf_dir).select("page_id", html.plain_text(html.without_code(F.col("html"))).alias("text"))


_ID = "substring(replace(replace(replace(replace(url, 'https://', ''), 'http://', ''), '/', '_'), '.', '_'), 1, 50)"


@query("h11_url_ids", f"SELECT page_id, {_ID} AS id FROM pages")
def h_ids(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", T.url_to_id(F.col("url")).alias("id"))


@query("s1_html_documents", f"""WITH {_PIECES}, n AS (SELECT page_id, count(*) AS n FROM cl WHERE len(content) >= 3 GROUP BY page_id)
SELECT rp.page_id, {_ID} AS id, {_TITLE} AS title, 'webpage_general' AS category, n::BIGINT AS elements, 2::BIGINT AS figures, 1::BIGINT AS tables FROM rp JOIN n USING (page_id)""")  # fmt: skip
def s_documents(spark, sf_dir):
    d = html.parse(I.rich_pages(spark, sf_dir), parts=("title", "inferred", "content", "figures", "tables"))
    return d.select("page_id", "id", "title", F.col("inferred").alias("category"), *[F.size(k).cast("long").alias(n) for k, n in (("content", "elements"), ("figures", "figures"), ("tables", "tables"))])


# --- spans ---


@query("p1_metadata", "SELECT o_orderkey, ['A' || o_custkey, 'B'] AS authors, date_trunc('second', o_orderdate) AS date, ['k1', o_orderstatus] AS keywords FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, [], NULL, [] FROM orders WHERE o_orderkey % 2 <> 0")
def p_metadata(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    author = F.when(even, F.concat(F.lit("A"), F.col("o_custkey").cast("string"), F.lit("; B ,")))
    created = F.when(even, F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'00'"))).otherwise("yesterday")
    m = spans.metadata(F.lit("t"), author, F.when(even, F.concat(F.lit("k1, ,"), "o_orderstatus")), created)
    return o.select("o_orderkey", m.alias("m")).select("o_orderkey", "m.authors", "m.date", "m.keywords")


_LV = "CASE WHEN max_size > 1.2e0 * page_size THEN CASE WHEN max_size / page_size > 1.8e0 THEN 1 WHEN max_size / page_size > 1.4e0 THEN 2 ELSE 3 END END"


@query("p2_p5_elements", f"""WITH {I.SP} SELECT doc_id, 'p' || page || '_b' || block AS id, page, CASE WHEN max_size > 1.2e0 * page_size THEN 'heading' ELSE 'paragraph' END AS type, content, ({_LV})::INTEGER AS level,
  x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height FROM bl""")  # fmt: skip
def p_elements(spark, sf_dir):
    return spans.elements(I.spans(spark, sf_dir)).select("doc_id", "id", "page", "type", "content", "level", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


@query("p6_figures", "SELECT DISTINCT l_orderkey AS doc_id, 'fig_p1_i' || l_linenumber AS id, 1 AS page, (10 * l_linenumber)::DOUBLE AS x, 5e0 AS width FROM lineitem WHERE l_linenumber % 2 = 0")
def p_figures(spark, sf_dir):
    l = I.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("image")).distinct()  # noqa: E741
    rects = F.when(F.col("image") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(None).cast("int")))
    i = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "image", F.explode(rects).alias("rect"))
    x = F.col("image") * 10.0 + F.col("rect")
    found = spans.figures(i.select("*", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 5).alias("x1"), F.lit(9.0).alias("y1")))
    return found.select("doc_id", "id", "page", "x", "width")


_FLAT = "array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), ';')"


@query("p7_tables", f"WITH {I.CE} SELECT doc_id, id, page, {_FLAT} AS rows FROM tb")
def p_tables(spark, sf_dir):
    return spans.tables(I.cells(spark, sf_dir)).select("doc_id", "id", "page", _flat("rows"))


def _flat(rows):
    return F.concat_ws(";", F.transform(rows, lambda r: F.array_join(r, "|"))).alias("rows")


@query("s8_renumbered_tables", f"""WITH {I.CE} SELECT doc_id, 'table_' || row_number() OVER (PARTITION BY doc_id ORDER BY page, "table") AS id, page, {_FLAT} AS rows FROM tb""")
def s_tables(spark, sf_dir):
    return spans.renumbered_tables(spans.tables(I.cells(spark, sf_dir))).select("doc_id", "id", "page", _flat("rows"))


@query("s9_region_table", f"WITH {I.CE} SELECT doc_id, array_to_string(list(array_to_string(cells, '|') ORDER BY row), ';') AS rows FROM ce WHERE page = 1 AND x0 >= 50 AND y0 >= 30 AND x1 <= 170 AND y1 <= 100 GROUP BY doc_id")
def s_region(spark, sf_dir):
    return spans.region_table(I.cells(spark, sf_dir), 1, 50, 30, 170, 100).select("doc_id", _flat("rows"))


@query("s9_table_regions", f"""WITH {I.CE} SELECT doc_id, page, "table", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ce GROUP BY doc_id, page, "table" """)
def s_regions(spark, sf_dir):
    return spans.table_regions(I.cells(spark, sf_dir))


@query("s9_text_tables", f"""WITH {I.SP}, tx AS (SELECT *, (block - 1) // 3 + 1 AS page FROM li0 WHERE block % 7 <> 6)
SELECT doc_id, 'tab_p' || page || '_t1' AS id, page, string_agg('part ' || part || '|' || supp, ';' ORDER BY block) AS rows, 50e0 AS x0, min(block) * 40e0 AS y0, 170e0 AS x1, max(block) * 40e0 + 12 AS y1
FROM tx GROUP BY doc_id, page HAVING count(*) >= 3""")  # fmt: skip
def s_text_tables(spark, sf_dir):
    words = I.spans(spark, sf_dir).where("block_type = 0")
    return spans.found_tables(spans.TableSettings("text", "text"), words=words).select("doc_id", "id", "page", _flat("rows"), "x0", "y0", "x1", "y1")


@query("s3_page_count", f"WITH {I.SP} SELECT doc_id, count(DISTINCT page) AS pages FROM sp GROUP BY doc_id")
def s_pages(spark, sf_dir):
    return spans.page_count(I.spans(spark, sf_dir))


@query("s4_page_text", f"WITH {I.SP} SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY block, span) FILTER (page = 1), '') AS text FROM sp GROUP BY doc_id")
def s_page_text(spark, sf_dir):
    return spans.page_text(I.spans(spark, sf_dir), 1)


_SV = f"""{I.SP},
sv AS (
  SELECT doc_id, block, 'tool_' || block AS id, CASE WHEN mean_size > 14 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN len(content) > 200 THEN content[1:200] || '...' ELSE content END AS content, round_even(mean_size, 1) AS font_size,
    x0 * (150e0 / 72) AS x, y0 * (150e0 / 72) AS y, (x1 - x0) * (150e0 / 72) AS width, (y1 - y0) * (150e0 / 72) AS height FROM bl)"""


@query("p8_service_elements", f"WITH {_SV} SELECT doc_id, id, type, content, font_size, {r6_sql('x', 'y', 'width', 'height')} FROM sv")
def p_service(spark, sf_dir):
    return spans.service_elements(I.spans(spark, sf_dir)).select("doc_id", "id", "type", "content", "font_size", *r6("x", "y", "width", "height"))


@query("p8_service_boxes", f"""WITH {I.SP}, {I.CE}, bo AS (
  SELECT doc_id, ((block - 1) // 3 + 1)::INTEGER AS page, 'tool_img_' || block AS id, 'figure' AS type, 'Image (120x12)' AS content, 50e0 AS x0, block * 40e0 AS y0, 170e0 AS x1, block * 40e0 + 12 AS y1 FROM li0 WHERE block % 7 = 6
  UNION ALL SELECT doc_id, page, 'tool_table_0', 'table', 'Table (' || count(*) || ' rows × 2 cols)', min(x0), min(y0), max(x1), max(y1) FROM ce GROUP BY doc_id, page)
SELECT doc_id, page, id, type, content, round(x0 * 150 / 72, 6) AS x, round(y0 * 150 / 72, 6) AS y, round((x1 - x0) * 150 / 72, 6) AS width, round((y1 - y0) * 150 / 72, 6) AS height FROM bo""")  # fmt: skip
def p_service_boxes(spark, sf_dir):
    return spans.service_boxes(I.spans(spark, sf_dir), I.cells(spark, sf_dir)).select("doc_id", "page", "id", "type", "content", *r6("x", "y", "width", "height"))


@query("p9_second_extractor", f"""WITH {_SV} SELECT doc_id, replace(id, 'tool_', 'vlm_') AS id, CASE WHEN type = 'paragraph' AND len(content) < 50 THEN 'caption' ELSE type END AS type,
  round(x + 2, 6) AS x, round(y + 1, 6) AS y, round(width - 4, 6) AS width, round(height - 2, 6) AS height FROM sv""")  # fmt: skip
def p_second(spark, sf_dir):
    return spans.second_extractor(spans.service_elements(I.spans(spark, sf_dir))).select("doc_id", "id", "type", *r6("x", "y", "width", "height"))


@query("p10_percent_to_pixels", """SELECT l_orderkey, l_linenumber, round(coalesce(v, 0e0) * 1275 / 100, 6) AS x, round(coalesce(v, 0e0) * 1650 / 100, 6) AS y, round(coalesce(v, 10e0) * 1275 / 100, 6) AS width, round(coalesce(v, 5e0) * 1650 / 100, 6) AS height
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 40 THEN l_quantity END AS v FROM lineitem)""")  # fmt: skip
def p_percent(spark, sf_dir):
    v = F.when(F.col("l_quantity") <= 40, F.col("l_quantity"))
    box = G.percent_to_pixels(v, v, v, v, F.lit(1275.0), F.lit(1650.0))
    return I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", *[F.round(f"b.{k}", 6).alias(k) for k in ("x", "y", "width", "height")])


@query("p11_summaries", """WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, n::INTEGER AS tool_count, least(n, 20)::INTEGER AS tool_listed, (n - 10)::INTEGER AS model_count, least(n, 15)::INTEGER AS model_listed, greatest(0, n % 4 - 2)::INTEGER AS model_tables,
  CASE WHEN n % 2 = 0 THEN 'AI,machine learning' ELSE 'a,b,c,d,e' END AS model_keywords FROM n""")  # fmt: skip
def p_summaries(spark, sf_dir):
    l = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct(F.lit("e").alias("id"), F.lit("paragraph").alias("type"), F.col("l_returnflag").alias("content"), F.lit(None).cast("int").alias("level"))).alias("content"))  # noqa: E741
    n = F.size("content")
    words = F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, "abcdef")))
    tool = spans.tool_summary(F.lit("t"), F.array(F.struct(F.lit("x").alias("name"))), F.col("content"), F.array_repeat(F.lit(1), n % 4), F.array(), words)
    s = l.select("doc_id", tool.alias("tool")).withColumn("model", spans.model_summary(F.col("tool")))
    return s.select(
        "doc_id", F.col("tool.content_count").alias("tool_count"), F.size("tool.content").alias("tool_listed"), F.col("model.content_count").alias("model_count"), F.size("model.content").alias("model_listed"),
        F.col("model.tables_count").alias("model_tables"), F.concat_ws(",", "model.keywords").alias("model_keywords"),
    )


@query("s14_cached_pages", "SELECT 'd' || doc_id || '.pdf' AS path, page, doc_id % 5 = 0 AND page = 0 AS cached, CASE WHEN doc_id % 5 = 0 AND page = 0 THEN 'model' ELSE 'tool' END AS origin FROM documents, (VALUES (0), (1)) p(page)")
def s_cached(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "doc_id")
    cache = d.where("doc_id % 5 = 0").select("path", F.lit("page_0").alias("page"), F.array(F.lit("model")).alias("elements"))
    found = d.select("path", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.array(F.lit("tool")).alias("elements"))
    return spans.cached_or(found, cache).select("path", "page", "cached", F.get("elements", F.lit(0)).alias("origin"))


# --- model answers ---

_KINDS = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'Here it is: ' || props || ' as asked.' ELSE 'no answer' END"


@query("j1_json_or_embedded", """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props->>'k')::BIGINT END AS k, event_id % 3 = 2 AS failed FROM events""")
def j_embedded(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").select("event_id", F.expr(_KINDS).alias("raw"))
    v = e.select("event_id", model_json.json_or_embedded(F.col("raw"), "struct<k:bigint>").alias("v"))
    return v.select("event_id", F.col("v.k").alias("k"), F.col("v").isNull().alias("failed"))


@query("j2_fenced_json", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 4 = 3 THEN 'invalid JSON' END AS error, CASE WHEN event_id % 4 = 3 THEN 'sorry' END AS raw_response FROM events""")
def j_fenced(spark, sf_dir):
    kinds = "CASE event_id % 4 WHEN 0 THEN concat('text\\n```json\\n', props, '\\n```\\nmore') WHEN 1 THEN concat('```\\n', props, '```') WHEN 2 THEN props ELSE 'sorry' END"
    e = I.table(spark, sf_dir, "events").select("event_id", F.expr(kinds).alias("raw"))
    return e.select("event_id", model_json.fenced_json(F.col("raw"), "struct<k:bigint>").alias("v")).select("event_id", F.col("v.value.k").alias("k"), "v.error", "v.raw_response")


@query("j3_documents", """WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, 'vlm_c' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) AS id, CASE WHEN role = 'user' THEN 'user' ELSE 'paragraph' END AS type, text AS content FROM c""")  # fmt: skip
def j_documents(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations").where("text is not null")
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(F.when(x["role"] == "user", x["role"]).alias("type"), x["text"].alias("text")))
    answers = c.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("t").alias("title"), said.alias("content"))).alias("raw"))
    d = answers.select("conv_id", model_json.to_document(F.col("conv_id"), model_json.json_or_error(F.col("raw"))).alias("d"))
    return d.select("conv_id", F.explode("d.content").alias("e")).select("conv_id", "e.id", "e.type", "e.content")


_ASK = (
    "Read the page image and answer with one JSON object that has the fields title, authors, abstract, keywords, content (type, text, level), tables (caption, data) and figures (caption). Leave out what the page does not show."
)


@query("j4_prompts", f"""SELECT doc_id, '{_ASK}' || CASE {I.CATEGORY} WHEN 'academic_paper' THEN ' Mind the abstract, section headings, captions and references.' WHEN 'blog_post' THEN ' Mind the author, the date of publication, tags and the main text.'
  WHEN 'technical_documentation' THEN ' Mind code blocks, command lines, parameter tables and cross-references.' ELSE '' END AS prompt FROM documents""")  # fmt: skip
def j_prompts(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", model_json.extraction_prompt(F.expr(I.CATEGORY)).alias("prompt"))


@query("s11_tables_from_images", """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'table_' || event_id END AS id, CASE WHEN event_id % 4 < 2 THEN 'of ' || user_id END AS caption, CASE WHEN event_id % 4 < 2 THEN 'k|' || (props->>'k') || ';|' END AS rows,
  CASE WHEN event_id % 4 = 0 THEN 3 END AS page, CASE WHEN event_id % 4 >= 2 THEN 'no table in the answer' END AS error FROM events""")  # fmt: skip
def s_image_tables(spark, sf_dir):
    k = "get_json_object(props, '$.k')"
    rows = f"""'{{"rows": [["k", "', {k}, '"], ["", null]], "caption": "of ', user_id, '"'"""
    kinds = f"""CASE event_id % 4 WHEN 0 THEN concat({rows}, ', "bbox": {{"page": 3, "x": 1.5}}}}') WHEN 1 THEN concat('Here:\\n```json\\n', {rows}, '}}\\n```') WHEN 2 THEN 'There is no table.' ELSE '{{"caption": "only"}}' END"""
    e = I.table(spark, sf_dir, "events").select("event_id", F.expr(kinds).alias("raw"))
    v = e.select("event_id", model_json.table_answer(F.col("raw"), F.concat(F.lit("table_"), F.col("event_id").cast("string"))).alias("a"))
    flat = F.when(F.col("a.value").isNotNull(), F.array_join(F.transform("a.value.rows", lambda r: F.array_join(r, "|")), ";"))
    return v.select("event_id", "a.value.id", "a.value.caption", flat.alias("rows"), F.col("a.value.bbox.page").alias("page"), "a.error")


@query("j5_categories", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'academic_paper' ELSE 'blog_post' END AS category FROM documents")
def j_categories(spark, sf_dir):
    name = F.element_at(F.array(F.lit("REPORT"), F.lit("no such"), F.lit("Blog_Post")), (F.col("doc_id") % 3).cast("int") + 1)
    return I.table(spark, sf_dir, "documents").select("doc_id", T.category_by_name(name, schemas.CATEGORIES).alias("category"))


# --- converters ---


@query("s2_laid_out_text", f"""WITH {I.TF}, ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM tf)
SELECT path AS doc_id, (n // 60 + 1)::INTEGER AS page, (n % 60)::INTEGER AS block, line AS text, round(n % 60 * 12e0, 6) AS y0, len(line) * 5e0 AS x1, false AS failed FROM ln WHERE {I.strip_sql('line')} <> ''
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, true FROM tf WHERE text IS NULL""")  # fmt: skip
def s_laid_out(spark, sf_dir):
    s = converters.to_spans(I.text_files(spark, sf_dir), converters.plain_spans)
    return s.select("doc_id", "page", "block", "text", F.round("y0", 6).alias("y0"), "x1", F.col("error").isNotNull().alias("failed"))


def _counts(content: bytes) -> dict:
    text = content.decode("utf-8")
    return {"lines": text.count("\n") + 1, "characters": len(text)}


@query("s5_json", f"WITH {I.TF} SELECT path, CASE WHEN text IS NOT NULL THEN json_object('lines', len(string_split(text, chr(10))), 'characters', len(text))::VARCHAR END AS json, text IS NULL AS failed FROM tf")
def s_json(spark, sf_dir):
    return converters.to_json(I.text_files(spark, sf_dir), _counts).select("path", "json", F.col("error").isNotNull().alias("failed"))


@query("s6_described", f"""WITH {I.EL}, ne AS (SELECT doc_id, count(*) AS n FROM el GROUP BY doc_id)
SELECT doc_id, source AS title, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE n END::INTEGER AS elements, CASE WHEN doc_id % 7 = 0 THEN lang ELSE source END AS first_content,
  ['', 'table_1:0', 'table_1:0,table_2:0'][doc_id % 3 + 1] AS tables, CASE WHEN doc_id % 2 = 0 THEN 'figure_1=' || lang || ',figure_2=?' ELSE '' END AS figures FROM documents JOIN ne USING (doc_id)""")  # fmt: skip
def s_described(spark, sf_dir):
    d = I.markdown(spark, sf_dir)
    answer = F.struct(
        F.col("source").alias("title"), F.when(F.col("doc_id") % 7 != 0, F.col("md")).alias("markdown"), F.col("lang").alias("text"), (F.col("doc_id") % 3).cast("int").alias("tables"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.col("lang"), F.lit(None).cast("string"))).alias("pictures"),
    )
    d = d.select("doc_id", converters.described(answer.cast(converters.DESCRIBED)).alias("d"))
    return d.select(
        "doc_id", "d.title", F.size("d.content").alias("elements"), F.get("d.content", F.lit(0))["content"].alias("first_content"),
        F.array_join(F.transform("d.tables", lambda t: F.concat(t["id"], F.lit(":"), F.size(t["rows"]).cast("string"))), ",").alias("tables"),
        F.array_join(F.transform("d.figures", lambda f: F.concat(f["id"], F.lit("="), F.coalesce(f["caption"], F.lit("?")))), ",").alias("figures"),
    )


# --- files ---


@query("s7_formats", "SELECT p_partkey, ['pdf', 'html', 'html', 'docx', 'pptx', 'markdown', 'other', 'other'][p_partkey % 8 + 1] AS format FROM part")
def s_formats(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, (".PDF", ".html", ".Htm", ".docx", ".pptx", ".md", ".tar.gz", ""))), (F.col("p_partkey") % 8).cast("int") + 1)
    return I.table(spark, sf_dir, "part").select("p_partkey", T.format_of(F.concat(F.lit("/data/"), F.translate("p_name", " ", "_"), suffix)).alias("format"))


@query("s12_safe_names", f"""SELECT page_id, CASE WHEN len(b) > 100 THEN 'screenshot_' || page_id ELSE b END || '.png' AS name FROM (SELECT page_id, replace(replace(replace(replace(u, 'https://', ''), 'http://', ''), '/', '_'), ':', '_') AS b
  FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN url || '?' || repeat('q', 90) ELSE url END AS u FROM pages))""")  # fmt: skip
def s_names(spark, sf_dir):
    url = F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("?"), F.repeat(F.lit("q"), 90))).otherwise(F.col("url"))
    return I.table(spark, sf_dir, "pages").select("page_id", T.screenshot_name(url, F.col("page_id")).alias("name"))


@query("s13_scraped", f"SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'error' ELSE {_ID} END AS id, page_id % 8 <> 0 AS success, CASE WHEN page_id % 8 = 0 THEN 'no content' END AS error FROM pages")
def s_scraped(spark, sf_dir):
    return files.scraped(I.table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 8 != 0, F.col("html"))))


@query("s13_viewports", "SELECT page_id, viewport, width, height FROM pages, (VALUES ('mobile', 375, 667), ('tablet', 768, 1024), ('desktop', 1920, 1080)) v(viewport, width, height)")
def s_viewports(spark, sf_dir):
    return files.renderings(I.table(spark, sf_dir, "pages").select("page_id"))


@query("s16_data_uris", "SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS uri FROM part")
def s_uris(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey", T.data_uri(F.encode("p_name", "UTF-8")).alias("uri"))


@query("s15_list_files")
def s_list(spark, sf_dir):
    return files.list_files(spark, sf_dir, "*.parquet").select("name", "format", "size")
