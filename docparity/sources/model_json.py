"""Model answers: JSON in prose or fences to documents, and the prompts that ask for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docparity import schemas
from docparity.functions.text import strip

#: What a model is asked to return; every field may be missing.
ANSWER = (
    "struct<title:string,authors:array<string>,abstract:string,date:string,keywords:array<string>,"
    "content:array<struct<type:string,text:string,level:int>>,"
    "tables:array<struct<caption:string,label:string,data:array<array<string>>,rows:array<array<string>>>>,"
    "figures:array<struct<caption:string,label:string>>,links:array<struct<text:string,url:string>>>"
)
_FAILFAST = {"mode": "PERMISSIVE"}


def _parsed(text: Column, schema: str) -> Column:
    """The value, null if the text is no JSON of an object. A corrupt-record field tells bad JSON from one with null fields."""
    wide = schema[:-1] + ",__bad:string>"
    x = F.from_json(text, wide, {**_FAILFAST, "columnNameOfCorruptRecord": "__bad"})
    return F.when(F.startswith(F.ltrim(text), F.lit("{")) & x["__bad"].isNull() & x.isNotNull(), F.from_json(text, schema, _FAILFAST))


def _braced(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def json_or_embedded(raw: Column, schema: str = ANSWER) -> Column:
    """The answer as it stands, else what is between its first and last brace; null if neither is JSON."""
    return F.coalesce(_parsed(raw, schema), _parsed(_braced(raw), schema))


def json_or_error(raw: Column, schema: str = ANSWER) -> Column:
    """:func:`json_or_embedded`, but an error for an answer without JSON."""
    return F.coalesce(json_or_embedded(raw, schema), F.when(raw.isNotNull(), F.from_json(F.raise_error(F.lit("no JSON in the answer")).cast("string"), schema)))


def fenced_text(raw: Column) -> Column:
    """What is inside a code fence marked as JSON, else inside any fence, else the whole, trimmed."""
    tagged = F.regexp_extract(raw, r"(?s)```json\s*(.*?)```", 1)
    plain = F.regexp_extract(raw, r"(?s)```(.*?)```", 1)
    return strip(F.when(F.contains(raw, F.lit("```json")), tagged).when(F.contains(raw, F.lit("```")), plain).otherwise(raw))


def fenced_json(raw: Column, schema: str = ANSWER) -> Column:
    """(value, error, raw_response); the last two are null unless the text is no JSON."""
    value = _parsed(fenced_text(raw), schema)
    bad = value.isNull() & raw.isNotNull()
    return F.struct(value.alias("value"), F.when(bad, "invalid JSON").alias("error"), F.when(bad, raw).alias("raw_response"))


def _bbox_null() -> Column:
    return F.lit(None).cast(schemas.BBOX)


def to_document(doc_id: Column, answer: Column, category: Column | None = None, with_links: bool = False) -> Column:
    """A document struct; identifiers count from 0.

    Without ``category`` and ``with_links`` the category is null, table rows
    come from ``data`` and there are no labels, links or dates; with them the
    rows come from ``rows`` and all are kept.
    """
    label = (lambda e: e["label"]) if with_links else (lambda e: F.lit(None).cast("string"))
    many = lambda a, kind, make: F.coalesce(F.transform(a, make), F.array().cast(f"array<{kind}>")).cast(f"array<{kind}>")
    content = many(answer["content"], schemas.ELEMENT, lambda e, i: F.struct(
        F.concat(F.lit("vlm_c"), i.cast("string")).alias("id"), F.coalesce(e["type"], F.lit("paragraph")).alias("type"), F.coalesce(e["text"], F.lit("")).alias("content"),
        _bbox_null().alias("bbox"), e["level"].alias("level")))
    figures = many(answer["figures"], schemas.FIGURE, lambda e, i: F.struct(
        F.concat(F.lit("vlm_f"), i.cast("string")).alias("id"), e["caption"].alias("caption"), label(e).alias("label"), _bbox_null().alias("bbox")))
    rows = lambda e: F.coalesce(e["rows"] if with_links else e["data"], F.array().cast("array<array<string>>"))
    tables = many(answer["tables"], schemas.TABLE, lambda e, i: F.struct(
        F.concat(F.lit("vlm_t"), i.cast("string")).alias("id"), e["caption"].alias("caption"), label(e).alias("label"), _bbox_null().alias("bbox"), rows(e).alias("rows")))
    links = many(answer["links"], schemas.LINK, lambda e, i: F.struct(F.concat(F.lit("vlm_l"), i.cast("string")).alias("id"), F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["url"], F.lit("")).alias("url")))
    if not with_links:
        links = F.array().cast(f"array<{schemas.LINK}>")
    metadata = F.struct(
        answer["title"].alias("title"), F.transform(F.coalesce(answer["authors"], F.array().cast("array<string>")), lambda a: F.struct(a.alias("name"), F.lit(None).cast("string").alias("affiliation"))).alias("authors"),
        (F.try_to_timestamp(answer["date"]) if with_links else F.lit(None).cast("timestamp")).alias("date"), F.coalesce(answer["keywords"], F.array().cast("array<string>")).alias("keywords"),
        answer["abstract"].alias("abstract"), F.lit(None).cast("timestamp").alias("publish_date"),
    )
    return F.struct(
        doc_id.cast("string").alias("id"), F.lit("pdf").alias("format"), (F.lit(None) if category is None else category).cast("string").alias("category"),
        metadata.alias("metadata"), content.alias("content"), figures.alias("figures"), tables.alias("tables"), links.alias("links"),
    )


#: What a model says of the image of one table.
TABLE_ANSWER = f"struct<rows:array<array<string>>,caption:string,label:string,bbox:{schemas.BBOX}>"


def table_answer(raw: Column, table_id: Column | None = None) -> Column:
    """(value, error) of an answer to :func:`table_prompt`: one table under the given identifier; cells that are null are empty.

    An answer that is no JSON, or has no rows, is an error; a null one gives nulls.
    """
    v = _parsed(fenced_text(raw), TABLE_ANSWER)
    rows = F.transform(v["rows"], lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))
    name = F.lit("table_1") if table_id is None else table_id
    made = F.struct(name.alias("id"), v["caption"].alias("caption"), v["label"].alias("label"), v["bbox"].alias("bbox"), rows.alias("rows"))
    bad = raw.isNotNull() & v["rows"].isNull()
    return F.struct(F.when(v["rows"].isNotNull(), made).alias("value"), F.when(bad, "no table in the answer").alias("error"))


# --- prompts ---

_BASE = (
    "Read the page image and answer with one JSON object that has the fields title, authors, abstract, keywords, "
    "content (type, text, level), tables (caption, data) and figures (caption). Leave out what the page does not show."
)
_TABLE = (
    "Read the one table in this image and answer with one JSON object that has the fields rows (a list of rows, each a list of cells), "
    "caption, label and bbox (page, x, y, width, height). Give every cell its place; a cell without content is an empty string."
)
_BY_CATEGORY = {
    "academic_paper": "Mind the abstract, section headings, captions and references.",
    "blog_post": "Mind the author, the date of publication, tags and the main text.",
    "technical_documentation": "Mind code blocks, command lines, parameter tables and cross-references.",
}


def extraction_prompt(category: Column) -> Column:
    """The base instruction, with a sentence more for the categories that have one; null is any category."""
    more = None
    for name, text in _BY_CATEGORY.items():
        more = F.when(category == name, f" {text}") if more is None else more.when(category == name, f" {text}")
    return F.concat(F.lit(_BASE), more.otherwise(""))


def table_prompt() -> Column:
    """The instruction that goes with the image of one table."""
    return F.lit(_TABLE)
