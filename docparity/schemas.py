"""Nested document schema and the value sets of its enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("html", "pdf", "png", "jpg", "svg", "markdown", "latex", "docx", "pptx", "jupyter", "other")
CATEGORIES = (
    "academic_paper", "blog_post", "news_article", "technical_documentation", "book_chapter", "presentation",
    "report", "tutorial", "plot_visualization", "infographic", "webpage_general", "other",
)
QUALITIES = ("exact", "excellent", "good", "fair", "poor", "failed")

BBOX = "struct<page:int,x:double,y:double,width:double,height:double,confidence:double>"
ELEMENT = f"struct<id:string,type:string,content:string,bbox:{BBOX},level:int>"
FIGURE = f"struct<id:string,caption:string,label:string,bbox:{BBOX}>"
TABLE = f"struct<id:string,caption:string,label:string,bbox:{BBOX},rows:array<array<string>>>"
LINK = "struct<id:string,text:string,url:string>"
METADATA = "struct<title:string,authors:array<struct<name:string,affiliation:string>>,date:timestamp,keywords:array<string>,abstract:string,publish_date:timestamp>"
SOURCE = "struct<url:string,file_path:string,accessed_at:timestamp>"
DOCUMENT = (
    f"id string, format string, source {SOURCE}, category string, metadata {METADATA}, "
    f"content array<{ELEMENT}>, figures array<{FIGURE}>, tables array<{TABLE}>, links array<{LINK}>"
)
SPAN = "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double"


def checked(column: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value, or an error for one outside the enumeration; null stays null."""
    return F.when(column.isNull() | column.isin(*allowed), column).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), column)))


def bbox(page: Column, x: Column, y: Column, width: Column, height: Column, confidence: Column | None = None) -> Column:
    """A bounding box; confidence outside [0, 1] is an error."""
    c = F.lit(None).cast("double") if confidence is None else F.when(confidence.isNull() | confidence.between(0, 1), confidence).otherwise(F.raise_error(F.lit("confidence outside [0, 1]")).cast("double"))
    parts = (("page", page, "int"), ("x", x, "double"), ("y", y, "double"), ("width", width, "double"), ("height", height, "double"), ("confidence", c, "double"))
    return F.struct(*[v.cast(t).alias(n) for n, v, t in parts])
