"""Registered queries of extraction confidence (page grain, document grain) and of staged escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docparity.functions import text as T
from docparity.functions.text import WHITE
from docparity.operators import confidence as C
from docparity.operators import escalation as A
from docparity.plans import inputs as I
from docparity.plans.registry import query, r6, r6_sql

_RATIOS = ("alphanumeric_ratio", "replacement_char_ratio", "whitespace_ratio", "avg_word_length", "broken_word_ratio", "empty_block_ratio")
_CT = f"""{I.BX},
ct AS (
  SELECT doc_id, coalesce(page, 1) AS page, type, x, ({I.strip_sql('content')} = '')::INTEGER AS blank, len(content) AS chars, len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}]')) AS alnum,
    len(regexp_extract_all(content, '[{WHITE}]')) AS spaces, len(content) - len(replace(content, chr(65533), '')) AS bad, regexp_extract_all(content, '[^{WHITE}]+') AS ws, len({I.strip_sql('content')}) AS stripped
  FROM bx)"""


def _sums(keys: str, source: str = "ct", more: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS n, sum(blank) AS n_blank, sum(chars) AS chars, sum(alnum) AS alnum, sum(spaces) AS spaces, sum(bad) AS bad, sum(len(ws)) AS words,
      sum(coalesce(list_sum(list_transform(ws, lambda w: len(w))), 0)) AS word_chars, sum(len(list_filter(ws, lambda w: len(w) = 1 AND NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))) AS broken,
      sum(stripped) AS stripped, count(*) FILTER (type = 'heading') AS headings{more} FROM {source} GROUP BY {keys}"""


def _ratios(source: str) -> str:
    r = lambda a, b, d: f"CASE WHEN n > 0 AND words > 0 THEN ({a})::DOUBLE / greatest({b}, 1)::DOUBLE ELSE {d} END"
    total = "chars + n - 1"
    return f"""SELECT *, {r('alnum', total, '1e0')} AS alphanumeric_ratio, {r('bad', total, '0e0')} AS replacement_char_ratio, {r('spaces + n - 1', total, '0e0')} AS whitespace_ratio,
      {r('word_chars', 'words', '5e0')} AS avg_word_length, {r('broken', 'words', '0e0')} AS broken_word_ratio, {r('n_blank', 'n', '1e0')} AS empty_block_ratio FROM {source}"""


def _step(c: str, op: str, a: float, x: float, b: float, y: float) -> str:
    return f"CASE WHEN {c} {op} {a}e0 THEN {x}e0 WHEN {c} {op} {b}e0 THEN {y}e0 ELSE 0e0 END"


_TEXT = "greatest(0e0, least(1e0, 1e0 - " + " - ".join([
    _step("alphanumeric_ratio", "<", 0.3, 0.4, 0.5, 0.2), _step("replacement_char_ratio", ">", 0.05, 0.5, 0.01, 0.2), _step("avg_word_length", "<", 2, 0.3, 3, 0.1),
    _step("broken_word_ratio", ">", 0.3, 0.3, 0.1, 0.1), _step("empty_block_ratio", ">", 0.5, 0.3, 0.2, 0.1)]) + "))"
_LEVEL = "CASE WHEN {0} >= 0.85e0 THEN 'high' WHEN {0} >= 0.7e0 THEN 'medium' WHEN {0} >= 0.5e0 THEN 'low' ELSE 'very_low' END"

_TS = f"""{I.TR},
tw AS (SELECT doc_id, max(rows) AS modal FROM (SELECT doc_id, len(cells) AS width, count(cells) AS rows FROM tr GROUP BY ALL) GROUP BY doc_id),
tn AS (SELECT doc_id, count(cells) AS rows, sum(len(cells)) AS cells, sum(len(list_filter(cells, lambda c: c IS NULL OR {I.strip_sql('c')} = ''))) AS empty FROM tr GROUP BY doc_id),
ts AS (
  SELECT doc_id, CASE WHEN rows = 0 THEN 0.3e0 ELSE greatest(0e0, 1e0 - CASE WHEN modal::DOUBLE / rows < 0.8e0 THEN 0.3e0 ELSE 0e0 END
    - CASE WHEN empty::DOUBLE / cells > 0.5e0 THEN 0.3e0 WHEN empty::DOUBLE / cells > 0.3e0 THEN 0.15e0 ELSE 0e0 END - CASE WHEN rows < 2 THEN 0.1e0 ELSE 0e0 END) END AS table_score
  FROM tn JOIN tw USING (doc_id))"""
_FS = f"""{I.FG},
fs AS (SELECT doc_id, page, 1e0 - CASE WHEN coalesce(caption, '') = '' THEN 0.1e0 ELSE 0e0 END - CASE WHEN coalesce(label, '') = '' THEN 0.1e0 ELSE 0e0 END - CASE WHEN width <= 0 OR height <= 0 THEN 0.3e0 ELSE 0e0 END AS figure_score FROM fg)"""
_PG = f"""{_CT}, {_TS}, {_FS},
p0 AS ({_sums('doc_id, page', more=', coalesce(var_samp(x), 0e0) AS x_variance')}),
ov AS (
  SELECT DISTINCT a.doc_id, a.page FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq < b.seq
  WHERE a.x <= b.x + b.width AND b.x <= a.x + a.width AND a.y <= b.y + b.height AND b.y <= a.y + a.height),
p1 AS ({_ratios('p0')}),
p2 AS (
  SELECT p1.*, table_score, f.figure_score, x_variance / 360000 > 0.02e0 AS multi_column, ov.doc_id IS NOT NULL AS overlapping, {_TEXT} AS text_score
  FROM p1 LEFT JOIN ov USING (doc_id, page) LEFT JOIN (SELECT doc_id, 1 AS page, table_score FROM ts) USING (doc_id, page)
  LEFT JOIN (SELECT doc_id, page, avg(figure_score) AS figure_score FROM fs GROUP BY ALL) f USING (doc_id, page)),
p3 AS (SELECT *, 1e0 - CASE WHEN multi_column THEN 0.2e0 ELSE 0e0 END - CASE WHEN overlapping THEN 0.3e0 ELSE 0e0 END AS layout_score FROM p2),
pg AS (
  SELECT *, overall_score < 0.65e0 AS needs_vlm, list_filter([CASE WHEN text_score < 0.65e0 THEN 'low text quality' END, CASE WHEN multi_column THEN 'multi-column layout' END,
    CASE WHEN overlapping THEN 'overlapping blocks' END, CASE WHEN table_score < 0.6e0 THEN 'low table quality' END], lambda i: i IS NOT NULL) AS issues
  FROM (SELECT *, (text_score + layout_score + coalesce(table_score, 0e0) + coalesce(figure_score, 0e0)) / (2 + (table_score IS NOT NULL)::INTEGER + (figure_score IS NOT NULL)::INTEGER) AS overall_score FROM p3))"""


def _parts(spark, sf_dir):
    tables = C.table_scores(I.table_rows(spark, sf_dir))
    figures = I.figures(spark, sf_dir).select("doc_id", "page", C.figure_score(F.col("caption"), F.col("label"), F.col("width"), F.col("height")).alias("score"))
    return tables, figures, C.page_confidence(I.boxed(spark, sf_dir), tables, figures)


@query("c2_c5_text_metrics", f"""WITH {_CT}, s AS ({_sums('doc_id')}), r AS ({_ratios('s')})
SELECT doc_id, {r6_sql(*_RATIOS)}, round({_TEXT}, 6) AS text_score FROM r""")  # fmt: skip
def text_metrics(spark, sf_dir):
    e = I.boxed(spark, sf_dir)
    s = e.select("doc_id", *[v.alias(k) for k, v in T.element_counts(F.col("content")).items()]).groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in T.ADDITIVE])
    s = s.select("doc_id", *[v.alias(k) for k, v in T.text_ratios({k: F.col(k) for k in T.ADDITIVE}).items()])
    return s.select("doc_id", *r6(*_RATIOS), F.round(T.text_score({k: F.col(k) for k in _RATIOS}), 6).alias("text_score"))


@query("c6_c9_layout", f"WITH {_PG} SELECT doc_id, page, round(x_variance, 6) AS x_variance, multi_column, overlapping, round(layout_score, 6) AS layout_score FROM pg")
def layout(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, page int, score double")
    return C.page_confidence(I.boxed(spark, sf_dir), none, none).select("doc_id", "page", F.round("x_variance", 6).alias("x_variance"), "multi_column", "overlapping", F.round("layout_score", 6).alias("layout_score"))


@query("c10_c11_tables", f"WITH {_TS} SELECT doc_id, round(table_score, 6) AS table_score FROM ts")
def tables(spark, sf_dir):
    return C.table_scores(I.table_rows(spark, sf_dir)).groupBy("doc_id").agg(F.round(F.avg("score"), 6).alias("table_score"))


@query("c12_figures", f"WITH {_FS} SELECT doc_id, page, round(figure_score, 6) AS figure_score FROM fs")
def figures(spark, sf_dir):
    f = I.figures(spark, sf_dir)
    return f.select("doc_id", "page", F.round(C.figure_score(F.col("caption"), F.col("label"), F.col("width"), F.col("height")), 6).alias("figure_score"))


_PAGE = ("text_score", "layout_score", "table_score", "figure_score", "overall_score")


@query("c1_c13_pages", f"WITH {_PG} SELECT doc_id, page, {r6_sql(*_PAGE)}, needs_vlm, array_to_string(issues, ';') AS issues FROM pg")
def pages(spark, sf_dir):
    return _parts(spark, sf_dir)[2].select("doc_id", "page", *r6(*_PAGE), "needs_vlm", F.concat_ws(";", "issues").alias("issues"))


_D = f"""{_PG},
d0 AS (
  SELECT doc_id, sum(n) AS n, sum(n_blank) AS n_blank, sum(chars) AS chars, sum(alnum) AS alnum, sum(spaces) AS spaces, sum(bad) AS bad, sum(words) AS words, sum(word_chars) AS word_chars, sum(broken) AS broken,
    sum(stripped) AS stripped, sum(headings) AS headings, count(*)::BIGINT AS total_pages, count(*) FILTER (needs_vlm) AS pages_needing_vlm, array_to_string(list_sort(list_distinct(flatten(list(issues)))), ';') AS issues,
    array_to_string(list(page ORDER BY page) FILTER (needs_vlm), ',') AS bad_pages FROM pg GROUP BY doc_id),
d1 AS ({_ratios('d0')}),
d2 AS (
  SELECT d1.*, ts.table_score, f.figure_score, CASE WHEN n = 0 THEN 0.3e0 WHEN stripped + greatest(n - n_blank - 1, 0) < 50 THEN 0.4e0 ELSE {_TEXT} END AS content_score,
    greatest(0e0, 1e0 - CASE WHEN headings = 0 THEN 0.1e0 ELSE 0e0 END - CASE WHEN doc_id % 6 = 0 THEN 0.1e0 ELSE 0e0 END - CASE WHEN chars::DOUBLE / n < 10 THEN 0.2e0 ELSE 0e0 END) AS structure_score
  FROM d1 LEFT JOIN ts USING (doc_id) LEFT JOIN (SELECT doc_id, avg(figure_score) AS figure_score FROM fs GROUP BY doc_id) f USING (doc_id)),
dd AS (
  SELECT *, (0.5e0 * content_score + 0.3e0 * structure_score + coalesce(0.1e0 * table_score, 0e0) + coalesce(0.1e0 * figure_score, 0e0))
    / (0.5e0 + 0.3e0 + CASE WHEN table_score IS NOT NULL THEN 0.1e0 ELSE 0e0 END + CASE WHEN figure_score IS NOT NULL THEN 0.1e0 ELSE 0e0 END) AS overall_score, pages_needing_vlm::DOUBLE / total_pages AS vlm_ratio
  FROM d2)"""
_DOC = ("content_score", "structure_score", "table_score", "figure_score", "overall_score", "vlm_ratio")


def _documents(spark, sf_dir):
    t, f, p = _parts(spark, sf_dir)
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("source")).alias("title"))
    return C.document_scores(docs, p, t, f)


@query("c14_c19_documents", f"""WITH {_D} SELECT doc_id, {r6_sql(*_DOC)}, {_LEVEL.format('round(overall_score, 9)')} AS level, total_pages, pages_needing_vlm, issues, coalesce(bad_pages, '') AS bad_pages, vlm_ratio > 0.3e0 AS needs_full_vlm FROM dd""")
def documents(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("level", T.confidence_level(F.round("overall_score", 9)))
    return d.select("doc_id", *r6(*_DOC), "level", "total_pages", "pages_needing_vlm", F.concat_ws(";", "issues").alias("issues"), F.concat_ws(",", F.transform("bad_pages", lambda x: x.cast("string"))).alias("bad_pages"), "needs_full_vlm")


_FLAG = f"""{_CT}, s AS ({_sums('doc_id')}), r AS ({_ratios('s')}),
q AS (SELECT doc_id, round((0.5e0 * CASE WHEN stripped + greatest(n - n_blank - 1, 0) < 50 THEN 0.4e0 ELSE {_TEXT} END + 0.3e0 * (1e0 - CASE WHEN chars::DOUBLE / n < 10 THEN 0.2e0 ELSE 0e0 END)) / 0.8e0, 9) AS score FROM r)"""


@query("c18_levels_by_language", f"""WITH {_FLAG} SELECT lang, {_LEVEL.format('score')} AS level, count(*) AS docs, round(avg(score), 6) AS avg_score FROM q JOIN documents USING (doc_id) GROUP BY ALL""")
def levels_by_language(spark, sf_dir):
    """Confidence levels of all documents by language: one shuffle of a row a document, one of a row a group."""
    e = I.boxed(spark, sf_dir).select("doc_id", "type", "content")
    counts = e.select("doc_id", F.length(T.strip(F.col("content"))).cast("long").alias("stripped"), *[v.alias(k) for k, v in T.element_counts(F.col("content")).items()])
    s = counts.groupBy("doc_id").agg(F.sum("stripped").alias("stripped"), *[F.sum(k).alias(k) for k in T.ADDITIVE])
    text = T.text_score(T.text_ratios({k: F.col(k) for k in T.ADDITIVE}))
    joined = F.col("stripped") + F.greatest(F.col("n") - F.col("n_blank") - 1, F.lit(0))
    content = C.content_score(F.col("n"), joined, text)
    structure = C.structure_score(F.lit(1), F.lit(True), F.col("chars"), F.col("n"))
    none = F.lit(None).cast("double")
    q = s.select("doc_id", F.round(C.overall(content, structure, none, none), 9).alias("score")).join(I.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return q.groupBy("lang", T.confidence_level(F.col("score")).alias("level")).agg(F.count("*").alias("docs"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("c18_levels_by_label", f"""WITH {_FLAG} SELECT quality, toxic, {_LEVEL.format('score')} AS level, count(*) AS docs FROM q LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def levels_by_label(spark, sf_dir):
    e = I.boxed(spark, sf_dir).select("doc_id", "content")
    counts = e.select("doc_id", F.length(T.strip(F.col("content"))).cast("long").alias("stripped"), *[v.alias(k) for k, v in T.element_counts(F.col("content")).items()])
    s = counts.groupBy("doc_id").agg(F.sum("stripped").alias("stripped"), *[F.sum(k).alias(k) for k in T.ADDITIVE])
    joined = F.col("stripped") + F.greatest(F.col("n") - F.col("n_blank") - 1, F.lit(0))
    content = C.content_score(F.col("n"), joined, T.text_score(T.text_ratios({k: F.col(k) for k in T.ADDITIVE})))
    none = F.lit(None).cast("double")
    q = s.select("doc_id", F.round(C.overall(content, C.structure_score(F.lit(1), F.lit(True), F.col("chars"), F.col("n")), none, none), 9).alias("score"))
    return q.join(I.table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("quality", "toxic", T.confidence_level(F.col("score")).alias("level")).agg(F.count("*").alias("docs"))


# --- escalation ---

_MIN = """mn AS (SELECT * FROM (VALUES ('academic_paper', 0.75e0, 0.8e0, 0.75e0, 0.75e0), ('plot_visualization', 0.8e0, 0.7e0, 0.8e0, 0.9e0), ('technical_documentation', 0.75e0, 0.8e0, 0.7e0, 0.7e0),
  ('blog_post', 0.65e0, 0.7e0, 0.6e0, 0.6e0), ('news_article', 0.65e0, 0.7e0, 0.6e0, 0.6e0)) t(category, mo, mc, mt, mf))"""
_ES = f"""{I.AT}, {_MIN},
es AS (
  SELECT a.*, coalesce(overall < coalesce(mo, 0.7e0), false) OR coalesce(content < coalesce(mc, 0.75e0), false) OR coalesce("table" < coalesce(mt, 0.65e0), false) OR coalesce(figure < coalesce(mf, 0.7e0), false) AS escalate
  FROM ex a LEFT JOIN mn USING (category)),
nm AS (SELECT es.*, ['pymupdf', 'marker', 'docling', 'vlm'][stage + 1] AS parser FROM es)"""


def _escalated(spark, sf_dir):
    a = A.with_thresholds(I.attempts(spark, sf_dir))
    return a.withColumn("escalate", A.should_escalate(overall=F.col("overall"), content=F.col("content"), table=F.col("table"), figure=F.col("figure"))).drop(*[f"min_{k}" for k in A.DEFAULTS])


@query("a1_a2_should_escalate", f"WITH {_ES} SELECT doc_id, category, stage, success, escalate FROM es")
def should_escalate(spark, sf_dir):
    return _escalated(spark, sf_dir).select("doc_id", "category", "stage", "success", "escalate")


@query("a3_pipeline_prefix", f"WITH {_ES} SELECT doc_id, stage, parser FROM nm WHERE stage <= 1")
def prefix(spark, sf_dir):
    return I.attempts(spark, sf_dir).where(F.col("parser").isin(*A.stages_up_to(A.PRESETS["balanced"]))).select("doc_id", "stage", "parser")


_RE = f"""{_ES},
re AS (
  SELECT * FROM (SELECT *, coalesce(max((success AND NOT escalate)::INTEGER) OVER (PARTITION BY doc_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM nm) WHERE done = 0)"""


@query("a4_staged_attempts", f"WITH {_RE} SELECT doc_id, stage, parser, success, escalate FROM re")
def staged(spark, sf_dir):
    return A.reached(_escalated(spark, sf_dir), ["doc_id"]).select("doc_id", "stage", "parser", "success", "escalate")


@query("a4_staged_by_anti_join", f"WITH {_RE} SELECT doc_id, stage, parser FROM re")
def staged_by_anti_join(spark, sf_dir):
    every = _escalated(spark, sf_dir)
    docs = I.table(spark, sf_dir, "documents").select("doc_id")
    steps = [(name, lambda left, i=i: left.join(every.where(F.col("stage") == i).drop("stage", "parser"), "doc_id")) for i, name in enumerate(A.STAGES)]
    return A.run_staged(docs, steps, lambda a: a["success"] & ~a["escalate"]).select("doc_id", "stage", "parser")


@query("a5_a6_best_attempt", f"""WITH {_RE},
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overall DESC, stage) AS k FROM re WHERE success)
SELECT t.doc_id, t.attempts, CASE WHEN w.doc_id IS NULL THEN 'all parsers failed' END AS error, w.parser AS final_parser, w.stage, round(w.overall, 6) AS overall
FROM (SELECT doc_id, count(*) AS attempts FROM re GROUP BY doc_id) t LEFT JOIN w ON t.doc_id = w.doc_id AND k = 1""")  # fmt: skip
def best(spark, sf_dir):
    b = A.best_attempt(A.reached(_escalated(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return b.select("doc_id", "attempts", "error", F.col("parser").alias("final_parser"), "stage", F.round("overall", 6).alias("overall"))


@query("a7_hybrid_gate", f"WITH {_D} SELECT doc_id, pages_needing_vlm > 0 AND NOT vlm_ratio > 0.3e0 AS used_hybrid FROM dd")
def hybrid(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", A.hybrid_used(F.lit(True), F.col("pages_needing_vlm"), F.col("needs_full_vlm"), F.lit("vlm" in A.stages_up_to("vlm"))).alias("used_hybrid"))


@query("a8_worst_pages", f"WITH {_PG} SELECT doc_id, page, rank::INTEGER AS rank, round(overall_score, 6) AS overall_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(overall_score, 9), page) AS rank FROM pg WHERE needs_vlm) WHERE rank <= 3")
def worst(spark, sf_dir):
    p = _parts(spark, sf_dir)[2].where("needs_vlm").withColumn("overall_score", F.round("overall_score", 9))
    return A.worst_pages(p, 3).select("doc_id", "page", "rank", F.round("overall_score", 6).alias("overall_score"))


@query("a9_page_merge", f"""WITH {I.BX},
rp AS (SELECT doc_id, page, seq, 'again ' || seq AS content FROM bx WHERE page IS NOT NULL AND page % 2 = 0 AND seq % 4 = 0),
m AS (SELECT doc_id, page, seq AS old, content, 0 AS part FROM bx WHERE (doc_id, coalesce(page, -1)) NOT IN (SELECT doc_id, page FROM rp) UNION ALL SELECT doc_id, page, seq, content, 1 FROM rp)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY part, CASE WHEN part = 1 THEN page END, old))::INTEGER AS seq, content FROM m""")  # fmt: skip
def merge(spark, sf_dir):
    base = I.boxed(spark, sf_dir).select("doc_id", "page", "seq", "content")
    again = base.where("page is not null and page % 2 = 0 and seq % 4 = 0").withColumn("content", F.concat(F.lit("again "), F.col("seq").cast("string")))
    return A.merge_pages(base, again).select("doc_id", "page", "seq", "content")


@query("a10_attempt_summary", f"""WITH {_RE} SELECT doc_id, string_agg(parser || ':' || success::VARCHAR || ':' || coalesce((round_even(overall * 1000, 0)::BIGINT)::VARCHAR, '-'), ' ' ORDER BY stage) AS attempts FROM re GROUP BY doc_id""")
def attempt_summary(spark, sf_dir):
    a = A.reached(_escalated(spark, sf_dir), ["doc_id"])
    one = F.concat_ws(":", "parser", F.col("success").cast("string"), F.coalesce(F.bround(F.col("overall") * 1000, 0).cast("long").cast("string"), F.lit("-")))
    return a.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stage", one.alias("s")))), lambda x: x["s"]), " ").alias("attempts"))


_PM = f"""{I.BX}, {_ES},
pe AS (SELECT doc_id, count(*) AS n, sum(len(content)) AS chars FROM bx GROUP BY doc_id),
pm AS (
  SELECT doc_id, parser AS pipeline, stage AS ord, success, CASE WHEN success THEN round_even(time_seconds, 3) ELSE 0e0 END AS time_seconds, (CASE WHEN success THEN n ELSE 0 END)::BIGINT AS elements,
    (CASE WHEN success THEN chars - stage * n ELSE 0 END)::BIGINT AS text_length, parser = 'docling' AS uses_local_model, parser IN ('marker', 'docling') AS uses_gpu, CASE WHEN NOT success THEN 'failed' END AS error
  FROM nm JOIN pe USING (doc_id))"""


def _metrics(spark, sf_dir):
    runs = I.attempts(spark, sf_dir).select("doc_id", F.col("parser").alias("pipeline"), F.col("stage").alias("ord"), "success", "time_seconds", F.lit("failed").alias("error"))
    # an extractor further on loses a character of each element
    e = I.boxed(spark, sf_dir).select("doc_id", "content").join(runs.select("doc_id", "pipeline", "ord"), "doc_id")
    e = e.select("doc_id", "pipeline", F.lit("element").alias("kind"), F.expr("substring(content, 1, length(content) - ord)").alias("content"))
    return A.pipeline_metrics(e, runs).join(runs.select("doc_id", "pipeline", "ord"), ["doc_id", "pipeline"])


_LOSS = _PM.replace("pe AS (SELECT doc_id, count(*) AS n, sum(len(content)) AS chars FROM bx GROUP BY doc_id)", "pe AS (SELECT doc_id, s AS stage0, count(*) AS n, sum(greatest(len(content) - s, 0)) AS chars FROM bx, (VALUES (0), (1), (2), (3)) v(s) GROUP BY ALL)")
_LOSS = _LOSS.replace("chars - stage * n", "chars").replace("FROM nm JOIN pe USING (doc_id)", "FROM nm JOIN pe ON nm.doc_id = pe.doc_id AND stage = stage0").replace("SELECT doc_id, parser AS pipeline", "SELECT nm.doc_id, parser AS pipeline")
_METRIC = ("doc_id", "pipeline", "success", "time_seconds", "elements", "text_length", "uses_local_model", "uses_gpu", "error")


@query("a11_pipeline_metrics", f"WITH {_LOSS} SELECT {', '.join(_METRIC)} FROM pm")
def metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select(*_METRIC)


_WIN = f"""{_LOSS},
wi AS (
  SELECT doc_id, coalesce(first(pipeline ORDER BY time_seconds, ord) FILTER (success), 'none') AS fastest, coalesce(first(pipeline ORDER BY text_length DESC, ord) FILTER (success), 'none') AS most_content FROM pm GROUP BY doc_id)"""


@query("a12_winners", f"WITH {_WIN} SELECT doc_id, fastest, most_content FROM wi")
def winners(spark, sf_dir):
    return A.winners(_metrics(spark, sf_dir))


@query("a13_batch_wins", f"WITH {_WIN} SELECT fastest, count(*) AS wins, min(doc_id) AS first_doc FROM wi GROUP BY fastest")
def batch_wins(spark, sf_dir):
    return A.win_counts(A.winners(_metrics(spark, sf_dir)))


@query("a14_pairwise", f"""WITH {_LOSS} SELECT a.doc_id, a.time_seconds AS time_seconds_a, b.time_seconds AS time_seconds_b, a.elements AS elements_a, b.elements AS elements_b, a.text_length AS text_length_a, b.text_length AS text_length_b,
  CASE WHEN a.time_seconds = 0 THEN 0e0 ELSE round_even(b.time_seconds / a.time_seconds, 2) END AS speed_ratio FROM pm a JOIN pm b USING (doc_id) WHERE a.pipeline = 'pymupdf' AND b.pipeline = 'marker'""")  # fmt: skip
def pairwise(spark, sf_dir):
    return A.compare_pipelines(_metrics(spark, sf_dir), "pymupdf", "marker")


@query("a15_category_sweep", f"WITH {I.AT} SELECT doc_id, c.category, page FROM (SELECT DISTINCT doc_id FROM ex) CROSS JOIN (VALUES ('academic_paper'), ('blog_post'), ('report')) c(category) CROSS JOIN (VALUES (1), (2)) p(page)")
def sweep(spark, sf_dir):
    wanted = spark.createDataFrame([(c, p) for c in ("academic_paper", "blog_post", "report") for p in (1, 2)], "category string, page int")
    return I.table(spark, sf_dir, "documents").select("doc_id").crossJoin(F.broadcast(wanted))
