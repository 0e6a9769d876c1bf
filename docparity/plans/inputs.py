"""Inputs the registered queries share: the given tables seen as documents, elements, boxes, spans and runs. Each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docparity.functions.text import WHITE
from docparity.sources.markdown import line_elements


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


# --- documents as markdown ---


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, md): a heading, the text with a paragraph for each sentence, a heading and one too deep to count."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))
    md = F.concat(F.lit("# "), "source", F.lit("\n"), text, F.lit("\n## "), "lang", F.lit("\n####### deep"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", md.alias("md"))


MD = """md AS (SELECT doc_id, lang, source, '# ' || source || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)) || chr(10) || '## ' || lang || chr(10) || '####### deep' AS md FROM documents)"""
EL = f"""{MD},
ls AS (SELECT doc_id, list_filter(list_transform(string_split(md, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM md),
li AS (SELECT doc_id, unnest(range(1, len(l) + 1))::INTEGER AS seq, unnest(l) AS line FROM ls),
el AS (
  SELECT doc_id, seq, CASE WHEN line LIKE '#%' THEN 'heading' ELSE 'paragraph' END AS type,
    CASE WHEN line LIKE '#%' THEN {strip_sql("regexp_replace(line, '^#+', '')")} ELSE line END AS content, CASE WHEN line LIKE '#%' THEN len(regexp_extract(line, '^#+'))::INTEGER END AS level
  FROM li)"""


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with boxes, 20 a page: two columns in every third document, touching boxes in every fourth, none in every thirteenth; replacement characters in every eleventh."""
    e = markdown(spark, sf_dir).select("doc_id", F.explode(line_elements(F.col("md"))).alias("e")).select("doc_id", "e.seq", "e.type", "e.content", "e.level")
    c, i, has = F.col, (F.col("seq") - 1) % 20, F.col("doc_id") % 13 != 0
    return e.select(
        "doc_id", "seq", "type", F.when((c("doc_id") % 11 == 0) & (c("seq") % 3 == 0), F.concat("content", F.lit(" ���"))).otherwise(c("content")).alias("content"), "level",
        F.when(has, F.floor((c("seq") - 1) / 20).cast("int") + 1).alias("page"),
        F.when(has, F.when((c("doc_id") % 3 == 0) & (i % 2 == 1), 350.0).otherwise(50.0)).alias("x"), F.when(has, F.lit(50.0) + i * 40).alias("y"),
        F.when(has, F.lit(200.0)).alias("width"), F.when(has, F.lit(30.0) + (c("doc_id") % 4) * 4).alias("height"),
    )


BX = f"""{EL},
bx AS (
  SELECT doc_id, seq, type, CASE WHEN doc_id % 11 = 0 AND seq % 3 = 0 THEN content || ' ' || repeat(chr(65533), 3) ELSE content END AS content, level,
    CASE WHEN has THEN (seq - 1) // 20 + 1 END AS page, CASE WHEN has THEN CASE WHEN doc_id % 3 = 0 AND (seq - 1) % 20 % 2 = 1 THEN 350e0 ELSE 50e0 END END AS x,
    CASE WHEN has THEN 50e0 + (seq - 1) % 20 * 40 END AS y, CASE WHEN has THEN 200e0 END AS width, CASE WHEN has THEN 30e0 + doc_id % 4 * 4 END AS height
  FROM (SELECT *, doc_id % 13 <> 0 AS has FROM el))"""


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, table_no, page, cells): an order's lines as a table of each document, ragged and with empty cells; an order without lines is a table without rows."""
    d = table(spark, sf_dir, "documents").select("doc_id").distinct()
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")  # noqa: E741
    second = F.when(F.col("l_quantity") > 25, "").otherwise(F.col("l_linestatus"))
    cells = F.when(F.col("l_linenumber") % 4 == 0, F.array("l_returnflag", "l_linestatus", F.lit(""))).when(F.col("l_linenumber").isNotNull(), F.array(F.col("l_returnflag"), second))
    return d.join(l, F.col("doc_id") == F.col("l_orderkey"), "left").select("doc_id", F.lit(1).alias("table_no"), F.lit(1).alias("page"), cells.alias("cells"))


TR = """tr AS (
  SELECT doc_id, CASE WHEN l_linenumber % 4 = 0 THEN [l_returnflag, l_linestatus, ''] WHEN l_linenumber IS NOT NULL THEN [l_returnflag, CASE WHEN l_quantity > 25 THEN '' ELSE l_linestatus END] END AS cells
  FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN lineitem ON doc_id = l_orderkey)"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, caption, label, width, height): a figure of each document, without caption or area in some."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (1 + F.col("doc_id") % 2).cast("int").alias("page"), F.when(F.col("doc_id") % 8 != 1, F.col("lang")).alias("caption"), F.col("source").alias("label"), (F.col("doc_id") % 3).cast("double").alias("width"), F.lit(10.0).alias("height"))


FG = "fg AS (SELECT doc_id, (1 + doc_id % 2)::INTEGER AS page, CASE WHEN doc_id % 8 <> 1 THEN lang END AS caption, source AS label, (doc_id % 3)::DOUBLE AS width, 10e0 AS height FROM documents)"


# --- order lines as text spans ---


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a document: a line a block, three a page, every seventh an image; two spans a block with font sizes of their own."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").alias("q"))  # noqa: E741
    n = F.col("l_linenumber")
    both = F.array(
        F.struct(F.lit(0).alias("span"), F.concat(F.lit("part "), F.col("part").cast("string")).alias("text"), (F.col("q") % 17 + 8).alias("size"), F.lit(0.0).alias("dx")),
        F.struct(F.lit(1).alias("span"), F.col("supp").cast("string").alias("text"), F.lit(10.0).alias("size"), F.lit(60.0).alias("dx")),
    )
    e = l.select(F.col("l_orderkey").alias("doc_id"), (F.floor((n - 1) / 3) + 1).cast("int").alias("page"), n.cast("int").alias("block"), F.when(n % 7 == 6, 1).otherwise(0).alias("block_type"), F.explode(both).alias("s"))
    return e.select("doc_id", "page", "block", "block_type", F.lit(0).alias("line"), "s.span", "s.text", "s.size", (F.lit(50.0) + F.col("s.dx")).alias("x0"), (F.col("block") * 40.0).alias("y0"), (F.lit(110.0) + F.col("s.dx")).alias("x1"), (F.col("block") * 40.0 + 12).alias("y1"))


SP = """li0 AS (SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS block, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
sp AS (
  SELECT doc_id, (block - 1) // 3 + 1 AS page, block, CASE WHEN block % 7 = 6 THEN 1 ELSE 0 END AS block_type, 0 AS span, 'part ' || part AS text, q % 17 + 8 AS size, 50e0 AS x0, block * 40e0 AS y0, 110e0 AS x1, block * 40e0 + 12 AS y1 FROM li0
  UNION ALL SELECT doc_id, (block - 1) // 3 + 1, block, CASE WHEN block % 7 = 6 THEN 1 ELSE 0 END, 1, supp::VARCHAR, 10e0, 110e0, block * 40e0, 170e0, block * 40e0 + 12 FROM li0),
bl AS (
  SELECT *, sum(s) OVER w / sum(k) OVER w AS page_size FROM (
    SELECT doc_id, page, block, string_agg(text, ' ' ORDER BY span) AS content, max(size) AS max_size, avg(size) AS mean_size, sum(size) AS s, count(*) AS k, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
    FROM sp WHERE block_type = 0 GROUP BY doc_id, page, block)
  WINDOW w AS (PARTITION BY doc_id, page))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as table cells: two tables a document, some cells without text."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))  # noqa: E741
    n = F.col("l_linenumber").cast("int")
    both = F.array(F.struct(F.lit(0).alias("col"), F.col("part").cast("string").alias("text")), F.struct(F.lit(1).alias("col"), F.when(F.col("part") % 3 != 0, F.col("flag")).alias("text")))
    e = l.select(F.col("l_orderkey").alias("doc_id"), (1 + n % 2).alias("page"), F.lit(1).alias("table"), n.alias("row"), F.explode(both).alias("c"))
    return e.select("doc_id", "page", "table", "row", "c.col", "c.text", (50.0 + 60 * F.col("c.col")).alias("x0"), (20.0 * F.col("row")).alias("y0"), (110.0 + 60 * F.col("c.col")).alias("x1"), (20.0 * F.col("row") + 12).alias("y1"))


CE = """c0 AS (SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS row, min(l_partkey) AS part, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
ce AS (SELECT doc_id, (1 + row % 2)::INTEGER AS page, 1 AS "table", row, [part::VARCHAR, CASE WHEN part % 3 <> 0 THEN flag ELSE '' END] AS cells, 50e0 AS x0, 20e0 * row AS y0, 170e0 AS x1, 20e0 * row + 12 AS y1 FROM c0),
tb AS (SELECT doc_id, 'tab_p' || page || '_t1' AS id, page, "table", list(cells ORDER BY row) AS rows FROM ce GROUP BY doc_id, page, "table")"""


# --- two extractions of one document ---


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nested documents (doc_id, title, authors, keywords, content, figures, tables): as extracted, and with every fifth element gone, boxes inset, metadata changed."""
    el = boxed(spark, sf_dir).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "type", "content", F.when(F.col("x").isNotNull(), F.struct("page", "x", "y", "width", "height")).alias("bbox")))).alias("content")
    )
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(el, "doc_id")
    third = F.col("doc_id") % 3
    inset = lambda b: F.when(b.isNotNull(), F.struct(b["page"].alias("page"), (b["x"] + 2).alias("x"), (b["y"] + 1).alias("y"), (b["width"] - 4).alias("width"), (b["height"] - 2).alias("height")))
    figs = lambda c: F.transform(F.filter(c, lambda e: e["seq"] % 4 == 1), lambda e: F.struct(e["bbox"].alias("bbox")))
    rows = lambda n, w: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.struct(F.array_repeat(F.array_repeat(F.lit("c"), w.cast("int")), i).alias("rows")))
    a = d.select(
        "doc_id", F.concat_ws(" ", "source", "lang").alias("title"), F.array("source").alias("authors"), F.array("lang", "source").alias("keywords"), "content", figs(F.col("content")).alias("figures"),
        rows(1 + third, F.lit(2)).alias("tables"),
    )
    kept = F.transform(F.filter("content", lambda e: e["seq"] % 5 != 0), lambda e: F.struct(e["seq"].alias("seq"), e["type"].alias("type"), e["content"].alias("content"), inset(e["bbox"]).alias("bbox")))
    b = d.select(
        "doc_id", F.when(third == 0, F.concat_ws(" ", "source", "lang")).when(third == 1, F.col("source")).alias("title"), F.array("source", "lang").alias("authors"), F.array("lang").alias("keywords"),
        kept.alias("content"), F.transform(figs(F.col("content")), lambda f: F.struct(inset(f["bbox"]).alias("bbox"))).alias("figures"), rows(F.lit(2), 2 + third % 2).alias("tables"),
    )
    return a, b


# --- runs of several extractors ---

CATEGORY = "CASE doc_id % 6 WHEN 0 THEN 'academic_paper' WHEN 1 THEN 'blog_post' WHEN 2 THEN 'technical_documentation' WHEN 3 THEN 'news_article' WHEN 4 THEN 'report' ELSE 'other' END"
AT = """ex AS (
  SELECT doc_id, category, stage, success, CASE WHEN success THEN (doc_id * 37 + stage * 211) % 1000 / 1000e0 END AS overall, CASE WHEN success THEN 0.6e0 + (doc_id * 13 + stage * 101) % 400 / 1000e0 END AS content,
    CASE WHEN success AND doc_id % 2 = 0 THEN 0.5e0 + (doc_id * 7 + stage * 97) % 500 / 1000e0 END AS "table", CASE WHEN success AND doc_id % 3 = 0 THEN 0.5e0 + (doc_id * 11 + stage * 89) % 500 / 1000e0 END AS figure,
    (1 + (doc_id * 31 + stage * 17) % 900) / 100e0 AS time_seconds
  FROM (SELECT doc_id, {category} AS category, stage, (doc_id + stage) % 7 <> 0 AND doc_id % 50 <> 49 AND stage < 3 AS success FROM documents, (VALUES (0), (1), (2), (3)) s(stage)))""".replace("{category}", CATEGORY)
NAMES = ("pymupdf", "marker", "docling", "vlm")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, category, stage, parser, success, scores, time_seconds): what four extractors would have scored; the last always fails, and all for every fiftieth document."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{CATEGORY} as category").withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(3))))
    c, s = F.col, F.col("stage")
    ok = ((c("doc_id") + s) % 7 != 0) & (c("doc_id") % 50 != 49) & (s < 3)
    part = lambda a, b, n: (c("doc_id") * a + s * b) % n / 1000.0
    return d.select(
        "doc_id", "category", "stage", F.element_at(F.array(*map(F.lit, NAMES)), s + 1).alias("parser"), ok.alias("success"), F.when(ok, part(37, 211, 1000)).alias("overall"),
        F.when(ok, 0.6 + part(13, 101, 400)).alias("content"), F.when(ok & (c("doc_id") % 2 == 0), 0.5 + part(7, 97, 500)).alias("table"), F.when(ok & (c("doc_id") % 3 == 0), 0.5 + part(11, 89, 500)).alias("figure"),
        ((1 + (c("doc_id") * 31 + s * 17) % 900) / 100.0).alias("time_seconds"),
    )


# --- pages with metadata, figures and tables ---

_HEAD = ("<meta name=\"author\" content=\"A. Writer, B. ", "\"><meta name=\"keywords\" content=\"one, ,k", " \"><meta name=\"description\" content=\"first second  third fourth fifth sixth\">")
_MORE = (
    "<figure><img src=\"a.png\"><figcaption> Shown ", "</figcaption></figure><figure><p>no image here</p></figure><img alt=\" loose \"><img alt=\" \">"
    "<table></table><table><caption>Cap</caption><tr><th>h1</th><th>h2</th></tr><tr><td>a b</td><td>", "</td></tr></table>"
    "<a href=\"#top\">up</a><a href=\"/dup\">first</a><a href=\"/dup\">second</a><a href=\"/none\"> </a>",
)


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with author, keywords, a figure, loose images, tables and repeated links put in; no title in every ninth, an Open Graph one instead."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit(_HEAD[0]), n, F.lit(_HEAD[1]), (F.col("page_id") % 7).cast("string"), F.lit(_HEAD[2]))
    more = F.concat(F.lit(_MORE[0]), n, F.lit(_MORE[1]), n, F.lit(_MORE[2]))
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("</article>"), F.concat(more, F.lit("</article>")))
    og = F.regexp_replace(html, r"<title>[^<]*</title>", '<title> </title><meta property="og:title" content="Graph title">')
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 9 == 0, og).otherwise(html).alias("html"))


RP = f"""rp AS (
  SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN regexp_replace(h, '<title>[^<]*</title>', '<title> </title><meta property="og:title" content="Graph title">', 'g') ELSE h END AS html
  FROM (SELECT page_id, url, replace(replace(html, '</head>', '{_HEAD[0]}' || page_id || '{_HEAD[1]}' || page_id % 7 || '{_HEAD[2]}</head>'), '</article>', '{_MORE[0]}' || page_id || '{_MORE[1]}' || page_id || '{_MORE[2]}</article>') AS h FROM pages))"""


# --- files that converters read ---


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the documents as files of text, every tenth of them broken."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 == 3, F.unhex(F.lit("41FF"))).otherwise(F.encode("text", "UTF-8")).alias("content"))


TF = "tf AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 <> 3 THEN text END AS text FROM documents)"
