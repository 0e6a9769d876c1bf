"""Registered queries of equivalence, set comparison, validation, reports and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from docparity import sinks
from docparity.functions import geometry as G
from docparity.functions import similarity as S
from docparity.functions import text as T
from docparity.operators import equivalence as E
from docparity.operators import escalation as A
from docparity.operators import images, report, validators
from docparity.plans import inputs as I
from docparity.plans.confidence import _CT, _TEXT, _WIN, _metrics, _ratios, _sums
from docparity.plans.registry import query, r6, r6_sql
from docparity.schemas import QUALITIES
from docparity.streaming import ingest

# --- string similarity, by dynamic programming in SQL ---


def _lcs_sql(pairs: str) -> str:
    """CTEs after ``pairs`` (a, b distinct strings) that give ``lc`` (a, b, n): a row of the table at a time, its running maximum by a list."""
    return f"""{pairs},
rows AS (
  SELECT a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN greatest(r[k], r[k - 1] + 1) ELSE r[k] END)))
  FROM rows WHERE i < len(a)),
lc AS (SELECT a, b, CASE WHEN len(a) + len(b) = 0 THEN 1e0 ELSE round_even(200e0 * r[len(b) + 1] / (len(a) + len(b)), 0) / 100 END AS ratio FROM rows WHERE i = len(a))"""


@query("e1_indel_ratio", f"WITH RECURSIVE {_lcs_sql('pairs AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part)')} SELECT p_partkey, ratio FROM part JOIN lc ON a = p_name AND b = p_type")
def indel(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey", S.indel_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


def _tokens_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace({x}, '[\\x{{80}}-\\x{{ff}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')), ' '), lambda w: w <> '')), ' ')"


_PT = f"pt AS (SELECT p_partkey, {_tokens_sql('''p_name || ', É ' || p_brand''')} AS a, {_tokens_sql('''p_brand || '/' || p_name || '-' || p_type''')} AS b FROM part), pairs AS (SELECT DISTINCT a, b FROM pt)"


@query("e2_token_sort_ratio", f"WITH RECURSIVE {_lcs_sql(_PT)} SELECT p_partkey, a AS tokens, ratio FROM pt JOIN lc USING (a, b)")
def token_sort(spark, sf_dir):
    a, b = F.concat("p_name", F.lit(", É "), "p_brand"), F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_type")
    return I.table(spark, sf_dir, "part").select("p_partkey", S.token_sorted(a).alias("tokens"), S.token_sort_ratio(a, b).alias("ratio"))


# --- two extractions ---

_TITLES = "ti AS (SELECT doc_id, lang, source, source || ' ' || lang AS ta, CASE doc_id % 3 WHEN 0 THEN source || ' ' || lang WHEN 1 THEN source END AS tb FROM documents), pairs AS (SELECT DISTINCT ta AS a, tb AS b FROM ti WHERE tb IS NOT NULL)"
_ME = f"""{_lcs_sql(_TITLES)},
me AS (SELECT doc_id, ((CASE WHEN tb IS NULL THEN 0e0 ELSE ratio END) + 0.5e0 + (CASE WHEN lang = source THEN 1e0 ELSE 0.5e0 END)) / 3 AS metadata_score FROM ti LEFT JOIN lc ON ta = a AND tb = b)"""


@query("e3_metadata_score", f"WITH RECURSIVE {_ME} SELECT doc_id, round(metadata_score, 6) AS metadata_score FROM me")
def metadata(spark, sf_dir):
    return _compared(spark, sf_dir).select("doc_id", F.round("metadata_score", 6).alias("metadata_score"))


def _compared(spark, sf_dir):
    return E.compare(*I.two_sides(spark, sf_dir))


_CO = f"""{I.BX},
co AS (SELECT doc_id, count(*) AS n, count(*) FILTER (seq % 5 <> 0) AS m, count(*) FILTER (seq % 4 = 1) AS f, count(*) FILTER (seq % 4 = 1 AND seq % 5 = 0) AS fd, bool_and(x IS NOT NULL) AS boxed FROM bx GROUP BY doc_id)"""


@query("e4_content_counts", f"""WITH {_CO},
ty AS (SELECT doc_id, type, count(*) AS a, count(*) FILTER (seq % 5 <> 0) AS b FROM el GROUP BY ALL),
tm AS (SELECT doc_id, string_agg(type || '=' || a, ',' ORDER BY type) AS types_a, string_agg(type || '=' || b, ',' ORDER BY type) FILTER (b > 0) AS types_b FROM ty GROUP BY doc_id)
SELECT doc_id, round(1e0 - (n - m)::DOUBLE / n, 6) AS count_score, types_a, types_b FROM co JOIN tm USING (doc_id)""")  # fmt: skip
def content_counts(spark, sf_dir):
    a, b = I.two_sides(spark, sf_dir)
    j = a.select("doc_id", F.col("content").alias("ca")).join(b.select("doc_id", F.col("content").alias("cb")), "doc_id")
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return j.select("doc_id", F.round(E.count_score(F.size("ca"), F.size("cb")), 6).alias("count_score"), flat(E.type_counts(F.col("ca"))).alias("types_a"), flat(E.type_counts(F.col("cb"))).alias("types_b"))


@query("e4_text_ratio")
def text_ratio(spark, sf_dir):
    """Token-sort ratio of whole documents; too slow in SQL, tested against a table of subsequences."""
    a, b = I.two_sides(spark, sf_dir)
    j = a.select("doc_id", E.joined_content(F.col("content")).alias("ta")).join(b.select("doc_id", E.joined_content(F.col("content")).alias("tb")), "doc_id")
    ratio = S.token_sort_ratio(F.col("ta"), F.col("tb"))
    return j.select("doc_id", ratio.alias("text_ratio")).withColumn("warning", E.text_warning(F.col("text_ratio")))


_IOU = "greatest(0e0, CASE WHEN w > 0 AND h > 0 THEN w * h / (aw * ah + bw * bh - w * h) ELSE 0e0 END)"
_MA = f"""{I.BX},
bb AS (SELECT doc_id, seq, page, x + 2 AS x, y + 1 AS y, width - 4 AS width, height - 2 AS height FROM bx WHERE seq % 5 <> 0 AND x IS NOT NULL),
pa AS (
  SELECT a.doc_id, a.seq, a.page, a.width AS aw, a.height AS ah, b.width AS bw, b.height AS bh, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS w, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS h
  FROM bx a JOIN bb b ON a.doc_id = b.doc_id AND a.page = b.page),
be AS (SELECT doc_id, seq, page, max({_IOU}) AS best FROM pa GROUP BY ALL)"""


@query("e7_e8_box_match", f"WITH {_MA} SELECT doc_id, round(avg(best), 6) AS match_score, count(*) AS matched FROM be GROUP BY doc_id")
def box_match(spark, sf_dir):
    a = I.boxed(spark, sf_dir).where("x is not null").select("doc_id", "seq", "page", "x", "y", "width", "height")
    b = a.where("seq % 5 <> 0").select("doc_id", "seq", "page", (F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y"), (F.col("width") - 4).alias("width"), (F.col("height") - 2).alias("height"))
    return E.match_long(a, b).select("doc_id", F.round("match_score", 6).alias("match_score"), "matched")


_FI = f"""{_CO},
fi AS (SELECT doc_id, CASE WHEN f = 0 THEN 1e0 WHEN boxed THEN (1e0 + ms) / 2 ELSE 1e0 END AS figures_score
  FROM co LEFT JOIN (SELECT doc_id, avg(best) AS ms FROM (
    SELECT doc_id, seq, max({_IOU}) AS best FROM (
      SELECT a.doc_id, a.seq, a.width AS aw, a.height AS ah, a.width - 4 AS bw, a.height - 2 AS bh, least(a.x + a.width, b.x + 2 + b.width - 4) - greatest(a.x, b.x + 2) AS w, least(a.y + a.height, b.y + 1 + b.height - 2) - greatest(a.y, b.y + 1) AS h
      FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq % 4 = 1 AND b.seq % 4 = 1) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)),
ta AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN (1e0 + 0.5e0) / 2 ELSE 1e0 - abs((1 + doc_id % 3) - 2)::DOUBLE / greatest(1 + doc_id % 3, 2) END AS tables_score FROM documents)"""


@query("e5_e6_figures_tables", f"WITH {_FI} SELECT doc_id, round(figures_score, 6) AS figures_score, round(tables_score, 6) AS tables_score FROM fi JOIN ta USING (doc_id)")
def figures_tables(spark, sf_dir):
    a, b = I.two_sides(spark, sf_dir)
    j = a.select("doc_id", F.col("figures").alias("fa"), F.col("tables").alias("ta")).join(b.select("doc_id", F.col("figures").alias("fb"), F.col("tables").alias("tb")), "doc_id")
    return j.select("doc_id", F.round(E.figures_score(F.col("fa"), F.col("fb")), 6).alias("figures_score"), F.round(E.tables_score(F.col("ta"), F.col("tb")), 6).alias("tables_score"))


@query("e9_e11_equivalence")
def equivalence(spark, sf_dir):
    """The whole comparison of two extractions of every document; its text ratio has no practical SQL."""
    c = _compared(spark, sf_dir)
    return c.select("doc_id", *r6("metadata_score", "content_score", "figures_score", "tables_score", "score"), "match_quality", T.accepted(F.col("score"), F.col("match_quality")).alias("accepted"), F.concat_ws(";", "warnings").alias("warnings"))


_QUALITY = "CASE WHEN score >= 0.99e0 THEN 'exact' WHEN score >= 0.95e0 THEN 'excellent' WHEN score >= 0.85e0 THEN 'good' WHEN score >= 0.7e0 THEN 'fair' WHEN score >= 0.5e0 THEN 'poor' ELSE 'failed' END"
_SHORT = f"""sd AS (
  SELECT p_partkey AS doc_id, {_tokens_sql("p_name || ' ' || p_type")} AS a, {_tokens_sql("CASE WHEN p_partkey % 2 = 1 THEN p_name || ' ' || p_brand ELSE p_name END")} AS b FROM part), pairs AS (SELECT DISTINCT a, b FROM sd)"""


@query("e4_e9_short_documents", f"""WITH RECURSIVE {_lcs_sql(_SHORT)},
sc AS (SELECT doc_id, ratio AS text_ratio, ((CASE WHEN doc_id % 3 = 0 THEN 0e0 ELSE 1e0 END) + 0e0 + 0.5e0) / 3 AS metadata_score, 0.7e0 * ratio + 0.3e0 * (CASE WHEN doc_id % 2 = 1 THEN 1e0 ELSE 0.5e0 END) AS content_score FROM sd JOIN lc USING (a, b)),
ov AS (SELECT *, 0.2e0 * metadata_score + 0.5e0 * content_score + 0.15e0 AS score FROM sc)
SELECT doc_id, round(metadata_score, 6) AS metadata_score, round(content_score, 6) AS content_score, 1e0 AS figures_score, 0e0 AS tables_score, round(score, 6) AS score, {_QUALITY} AS match_quality,
  CASE WHEN text_ratio < {E.THRESHOLD}e0 THEN printf('Text similarity (%.2f%%) below threshold ({E.THRESHOLD * 100:.2f}%%)', text_ratio * 100) ELSE '' END AS warnings FROM ov""")  # fmt: skip
def short_documents(spark, sf_dir):
    """The whole comparison, of documents short enough for subsequences in SQL."""
    p, c = I.table(spark, sf_dir, "part"), F.col
    element = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"), F.lit(None).cast("struct<page:int,x:double,y:double,width:double,height:double>").alias("bbox"))
    none = F.array().cast("array<struct<bbox:struct<page:int,x:double,y:double,width:double,height:double>>>")
    a = p.select(
        c("p_partkey").alias("doc_id"), c("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type", "p_brand").alias("keywords"), F.array(element("heading", c("p_name")), element("paragraph", c("p_type"))).alias("content"),
        none.alias("figures"), F.array(F.struct(F.array(F.array(F.lit("c"))).alias("rows"))).alias("tables"),
    )
    more = F.when(c("p_partkey") % 2 == 1, F.array(element("paragraph", c("p_brand")))).otherwise(F.slice(F.array(element("paragraph", c("p_brand"))), 1, 0))
    b = p.select(
        c("p_partkey").alias("doc_id"), F.when(c("p_partkey") % 3 != 0, c("p_name")).alias("title"), F.array().cast("array<string>").alias("authors"), F.array("p_brand").alias("keywords"), F.concat(F.array(element("heading", c("p_name"))), more).alias("content"),
        none.alias("figures"), F.array().cast("array<struct<rows:array<array<string>>>>").alias("tables"),
    )
    d = E.compare(a, b)
    return d.select("doc_id", *r6("metadata_score", "content_score", "figures_score", "tables_score", "score"), "match_quality", F.concat_ws(";", "warnings").alias("warnings"))


_RS = f"rs AS (SELECT doc_id, lang, score, {_QUALITY} AS match_quality FROM (SELECT doc_id, lang, (doc_id * 37 % 1000) / 1000e0 AS score FROM documents))"


def _results(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") * 37 % 1000 / 1000.0).alias("score"))
    return d.withColumn("match_quality", T.match_quality(F.col("score")))


@query("e10_e11_quality", f"WITH {_RS} SELECT doc_id, match_quality, score >= 0.85e0 AND match_quality IN ('exact', 'excellent', 'good') AS accepted FROM rs")
def quality(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "match_quality", T.accepted(F.col("score"), F.col("match_quality")).alias("accepted"))


@query("e12_basic_diff", f"""WITH {_CO},
k AS (SELECT doc_id, count(*) FILTER (type = 'heading') AS ha, count(*) FILTER (type = 'heading' AND seq % 5 <> 0) AS hb FROM el GROUP BY doc_id)
SELECT doc_id, doc_id % 3 = 0 AS title_match, false AS authors_match, n::INTEGER AS total_a, m::INTEGER AS total_b, ha::INTEGER AS headings_a, hb::INTEGER AS headings_b, (n - ha)::INTEGER AS paragraphs_a, (m - hb)::INTEGER AS paragraphs_b,
  CASE WHEN n <> m THEN 'element count mismatch: ' || n || ' vs ' || m END AS message, true AS figures_match, doc_id % 3 = 1 AS tables_match FROM co JOIN k USING (doc_id)""")  # fmt: skip
def basic_diff(spark, sf_dir):
    return E.basic_diff(*I.two_sides(spark, sf_dir))


@query("e13_set_comparison", """WITH s AS (SELECT conv_id, list_distinct(list(role) FILTER (turn % 2 = 0)) AS a, list_distinct(list(role) FILTER (turn % 3 = 0)) AS b FROM conversations GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s), j AS (SELECT conv_id, list_filter(a, lambda x: NOT list_contains(b, x)) AS ao, list_filter(b, lambda x: NOT list_contains(a, x)) AS bo, list_filter(a, lambda x: list_contains(b, x)) AS bt FROM z)
SELECT conv_id, array_to_string(list_sort(ao), ',') AS a_only, array_to_string(list_sort(bo), ',') AS b_only, array_to_string(list_sort(bt), ',') AS "both",
  array_to_string(list_sort(list_concat(list_concat(ao, bo), bt)), ',') AS either, array_to_string(list_sort(list_concat(ao, bo)), ',') AS one_of FROM j""")  # fmt: skip
def sets(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("turn") % 3 == 0, F.col("role"))).alias("b"))
    s = c.select("conv_id", E.set_comparison(F.col("a"), F.col("b")).alias("s"))
    return s.select("conv_id", *[F.concat_ws(",", f"s.{k}").alias(k) for k in ("a_only", "b_only", "both", "either", "one_of")])


# --- validators ---

_VC = "CASE doc_id % 5 WHEN 0 THEN 'academic_paper' WHEN 1 THEN 'blog_post' WHEN 2 THEN 'technical_documentation' WHEN 3 THEN 'news_article' ELSE 'report' END"
_VD = f"""vd AS (
  SELECT doc_id, {_VC} AS category, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 < 3 THEN lang ELSE source || ' in ' || lang END AS title, doc_id % 3 AS n_authors, CASE WHEN doc_id % 4 > 0 THEN repeat('x', (doc_id % 90)::INTEGER) END AS abstract,
    doc_id % 2 = 0 AS dated, doc_id % 2 AS n_keywords, doc_id % 9 AS n_content, doc_id % 4 AS n_figures, doc_id % 3 AS n_tables, doc_id % 2 AS n_links, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lower(text) END AS t FROM documents)"""


def _vsql(strict: bool) -> str:
    blank, has = "trim(coalesce({0}, '')) = ''", lambda *w: "NOT (" + " OR ".join(f"contains(t, '{x}')" for x in w) + ")"
    rules = {
        "academic_paper": (7, [("metadata.title", "e", blank.format("title")), ("metadata.title", "w", "trim(title) <> '' AND len(title) < 10"), ("metadata.authors", "w", "n_authors = 0"), ("metadata.abstract", "w", blank.format("abstract")),
                               ("metadata.abstract", "w", "trim(abstract) <> '' AND len(abstract) < 50"), ("content", "e", "n_content = 0"), ("content.structure", "w", has(*"abstract conclusion introduction method result".split())), ("figures", "i", "n_figures = 0"), ("tables", "i", "n_tables = 0")]),
        "blog_post": (5, [("metadata.title", "e", blank.format("title")), ("metadata.authors", "w", "n_authors = 0"), ("metadata.publish_date", "w", "NOT dated"), ("content", "e", "n_content = 0"), ("content", "w", "n_content IN (1, 2)"), ("metadata.keywords", "i", "n_keywords = 0")]),
        "technical_documentation": (4, [("metadata.title", "w", blank.format("title")), ("content", "e", "n_content = 0"), ("content.code", "w", has("class", "const ", "def ", "```", "function", "var ", "import")), ("links", "i", "n_links = 0")]),
        "news_article": (4, [("metadata.title", "e", blank.format("title")), ("metadata.authors", "w", "n_authors = 0"), ("metadata.publish_date", "w", "NOT dated"), ("content", "e", "n_content = 0")]),
        "report": (4, [("metadata.title", "e", blank.format("title")), ("content", "e", "n_content = 0"), ("data", "w", "n_tables = 0 AND n_figures = 0"), ("content.structure", "i", has(*"analysis executive finding recommendation summary".split()))]),
    }
    each = [f"SELECT doc_id, category, {n} AS total, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{'e' if strict and s == 'w' else s}:{f}' END" for f, s, c in checks) + f"], lambda i: i IS NOT NULL) AS issues FROM vd WHERE category = '{k}'" for k, (n, checks) in rules.items()]
    return f"""WITH {_VD}, v AS ({' UNION ALL '.join(each)}), k AS (SELECT *, len(list_filter(issues, lambda i: i[1] = 'e')) AS e, len(list_filter(issues, lambda i: i[1] = 'w')) AS w FROM v)
    SELECT doc_id, category, e = 0 AS passed, round(greatest(0e0, 1 - (e + 0.5e0 * w) / total), 6) AS score, array_to_string(issues, ',') AS issues FROM k"""


def _validated(spark, sf_dir, strict):
    n = F.col("doc_id")
    c = lambda k: (n % k).cast("int")
    d = I.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_VC).alias("category"), F.when(n % 7 == 0, "").when(n % 7 < 3, F.col("lang")).otherwise(F.concat("source", F.lit(" in "), "lang")).alias("title"), c(3).alias("n_authors"),
        F.when(n % 4 > 0, F.repeat(F.lit("x"), c(90))).alias("abstract"), F.when(n % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("publish_date"), c(2).alias("n_keywords"), c(9).alias("n_content"), c(4).alias("n_figures"),
        c(3).alias("n_tables"), c(2).alias("n_links"), F.when(n % 9 == 0, "").otherwise(F.lower("text")).alias("text"),
    )
    v = validators.validate(d, strict)
    flat = F.concat_ws(",", F.transform("issues", lambda i: F.concat(F.substring(i["severity"], 1, 1), F.lit(":"), i["field"])))
    return v.select("doc_id", "category", "passed", F.round("score", 6).alias("score"), flat.alias("issues"))


@query("v1_v7_validators", _vsql(False))
def validated(spark, sf_dir):
    return _validated(spark, sf_dir, False)


@query("v1_strict", _vsql(True))
def validated_strict(spark, sf_dir):
    return _validated(spark, sf_dir, True)


# --- reports ---


@query("r1_summary", f"""WITH {_RS} SELECT count(*) AS total_comparisons, bool_and(match_quality NOT IN ('poor', 'failed')) AND bool_and(doc_id % 10 <> 0) AS passed, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score,
  {', '.join(f"count(*) FILTER (match_quality = '{q}') AS n_{q}" for q in QUALITIES)}, count(*) AS total_visual_comparisons, round(avg(1 - score / 10), 6) AS avg_visual_similarity, round(avg((doc_id % 10 <> 0)::INTEGER), 6) AS visual_pass_rate FROM rs""")  # fmt: skip
def r_summary(spark, sf_dir):
    r = _results(spark, sf_dir)
    s = report.summary(r, r.select((1 - F.col("score") / 10).alias("similarity_score"), (F.col("doc_id") % 10 != 0).alias("passed")))
    return s.withColumns({k: F.round(k, 6) for k in ("avg_score", "avg_visual_similarity", "visual_pass_rate")})


@query("r1_rollup", f"WITH {_RS} SELECT lang, match_quality, count(*) AS n, round(avg(score), 6) AS avg_score, grouping_id(lang, match_quality) AS grain FROM rs GROUP BY ROLLUP (lang, match_quality)")
def r_rollup(spark, sf_dir):
    return report.by_group(_results(spark, sf_dir), "lang").withColumn("avg_score", F.round("avg_score", 6))


@query("k1_json", "SELECT c_custkey, c_name AS name, c_nationkey AS nation, NULL::VARCHAR AS gone FROM customer")
def k_json(spark, sf_dir):
    """Written as JSON objects, nulls kept, and read back."""
    n = I.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(None).cast("string").alias("gone"))
    j = n.select(sinks.as_json("c_custkey", "name", "nation", "gone").alias("j"))
    return j.select(F.from_json("j", "c_custkey long, name string, nation int, gone string").alias("v")).select("v.*")


_N = lambda c: f"CASE WHEN success THEN {c}::VARCHAR ELSE '-' END"


@query("k3_pipeline_reports", f"""WITH {_WIN} SELECT doc_id, '| pipeline | status | time (s) | content | tables | figures | text length |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10)
  || string_agg('| ' || concat_ws(' | ', pipeline, CASE WHEN success THEN 'ok' ELSE 'failed' END, {', '.join(map(_N, ('time_seconds', 'elements', '0', '0', 'text_length')))}) || ' |', chr(10) ORDER BY ord)
  || chr(10) || chr(10) || '- **Fastest:** ' || fastest || chr(10) || '- **Most content:** ' || most_content AS report FROM pm JOIN wi USING (doc_id) GROUP BY doc_id, fastest, most_content""")  # fmt: skip
def k_reports(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return report.pipeline_report(m, A.winners(m), "markdown")


# --- images ---

_PX = "px AS (SELECT s_suppkey AS img_id, y, x, (y * 13 + x * 7 + s_suppkey) % 256 AS r, (y * x) % 256 AS g, (x * 11) % 256 AS b FROM supplier, range(0, 20) a(y), range(0, 24) c(x)), py AS (SELECT img_id, y, x, CASE WHEN (x + y * 3 + img_id) % 17 = 0 AND img_id % 5 > 0 THEN 255 - r ELSE r END AS r, g, b FROM px)"


def _pixels(spark, sf_dir):
    n = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_id"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23))))
    c = F.col
    a = n.select("img_id", "y", "x", ((c("y") * 13 + c("x") * 7 + c("img_id")) % 256).alias("r"), (c("y") * c("x") % 256).alias("g"), (c("x") * 11 % 256).alias("b"))
    b = a.withColumn("r", F.when(((c("x") + c("y") * 3 + c("img_id")) % 17 == 0) & (c("img_id") % 5 > 0), 255 - c("r")).otherwise(c("r")))
    return a, b


def _raw(pixels):
    hexed = F.concat(*[F.lpad(F.hex(F.col(k).cast("long")), 2, "0") for k in "rgb"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", hexed.alias("h")))), lambda p: p["h"]), "")
    return pixels.groupBy("img_id").agg(F.unhex(joined).alias("rgb")).select("img_id", F.lit(24).alias("width"), F.lit(20).alias("height"), "rgb")


@query("i3_pixel_diff", f"WITH {_PX} SELECT img_id, count(*) FILTER (px.r <> py.r OR px.g <> py.g OR px.b <> py.b) AS pixel_diff_count, count(*) AS total_pixels, round(count(*) FILTER (px.r <> py.r) / count(*)::DOUBLE * 100, 6) AS diff_percentage FROM px JOIN py USING (img_id, y, x) GROUP BY img_id")
def pixel_diff(spark, sf_dir):
    return images.pixel_diff_long(*_pixels(spark, sf_dir)).withColumn("diff_percentage", F.round("diff_percentage", 6))


@query("i1_i2_ssim", f"""WITH {_PX},
gr AS (SELECT img_id, y, x, floor((px.r + px.g + px.b) / 3e0) AS a, floor((py.r + py.g + py.b) / 3e0) AS b, px.r <> py.r AS differs FROM px JOIN py USING (img_id, y, x)),
wi AS (SELECT g.img_id, o.y, o.x, avg(g.a) AS ma, avg(g.b) AS mb, var_samp(g.a) AS va, var_samp(g.b) AS vb, covar_samp(g.a, g.b) AS cv FROM gr o JOIN gr g ON g.img_id = o.img_id AND g.y BETWEEN o.y AND o.y + 6 AND g.x BETWEEN o.x AND o.x + 6 WHERE o.y <= 13 AND o.x <= 17 GROUP BY ALL),
sc AS (SELECT img_id, avg((2 * ma * mb + 6.5025e0) * (2 * cv + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (va + vb + 58.5225e0))) AS score FROM wi GROUP BY img_id),
df AS (SELECT img_id, count(*) FILTER (differs) AS n, count(*) AS total FROM gr GROUP BY img_id)
SELECT img_id, round(score, 6) AS similarity_score, n AS pixel_diff_count, score >= 0.95e0 AND n * 100e0 / total <= 0.01e0 AS passed FROM sc JOIN df USING (img_id)""")  # fmt: skip
def ssim(spark, sf_dir):
    a, b = _pixels(spark, sf_dir)
    return images.compare_images(_raw(a), _raw(b), with_diff=False).select("img_id", F.round("similarity_score", 6).alias("similarity_score"), "pixel_diff_count", "passed")


@query("i4_diff_images", f"""WITH {_PX}, d AS (SELECT img_id, y, x, abs(px.r - py.r) AS d, py.r AS r, py.g AS g, py.b AS b FROM px JOIN py USING (img_id, y, x)), m AS (SELECT *, max(d) OVER (PARTITION BY img_id) AS top FROM d)
SELECT img_id, string_agg(CASE WHEN top > 0 AND floor(d / top::DOUBLE * 255) > 10 THEN 'FF0000' ELSE printf('%02X%02X%02X', r, g, b) END, '' ORDER BY y, x) AS rgb FROM m GROUP BY img_id""")  # fmt: skip
def diff_images(spark, sf_dir):
    a, b = _pixels(spark, sf_dir)
    return images.compare_images(_raw(a), _raw(b)).select("img_id", F.hex("diff_image").alias("rgb"))


# --- streaming ---


_LINES = I.EL.replace(I.MD, "md AS (SELECT doc_id, coalesce(text, '') AS md FROM documents)")
_LINE_COUNTS = _CT.replace(I.BX, f"{_LINES}, bx AS (SELECT *, NULL::INTEGER AS page, 1e0 AS x FROM el)")


# a text without lines only loses what empty blocks cost
@query("stream_text_scores", f"WITH {_LINE_COUNTS}, s AS ({_sums('doc_id')}), r AS ({_ratios('s')}) SELECT doc_id, round(coalesce({_TEXT}, 0.7e0), 6) AS text_score FROM documents LEFT JOIN r USING (doc_id)")
def stream_text_scores(spark, sf_dir):
    """The projection the stream runs, here over the whole table at once; tests run it as a stream."""
    return ingest.text_scores(I.table(spark, sf_dir, "documents")).select("doc_id", F.round("text_score", 6).alias("text_score"))
