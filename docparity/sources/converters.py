"""Converters that live outside Spark: PDF readers and models that turn a file into spans or markdown.

None is required. A converter is a function of a file's bytes; it is called in
Arrow batches on the executors, a file at a time, and a file that it fails on
is a row with an error. Whatever it needs (a model, say) it should load once per process.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docparity.schemas import SPAN
from docparity.sources.markdown import line_elements, merged_elements


def _converted(files: DataFrame, convert: Callable[[bytes], object], column: str) -> DataFrame:
    """(path, ``column``, error) of files (path, content): what ``convert`` makes of each, as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    made, error = convert(content.as_py()), None
                except Exception as e:  # a broken file must not end the job
                    made, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made], pa.string()), pa.array([error], pa.string())], ["path", column, "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, {column} string, error string")


def to_markdown(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """(path, markdown, error) of files (path, content)."""
    return _converted(files, convert, "markdown")


def to_json(files: DataFrame, convert: Callable[[bytes], object]) -> DataFrame:
    """(path, json, error): the whole structure a converter gives, as JSON; what JSON does not know stands there as text."""
    return _converted(files, lambda content: json.dumps(convert(content), ensure_ascii=False, separators=(",", ":"), default=str), "json")


#: What the second converter says of a file: whose tables have no rows yet, and which describes its pictures.
DESCRIBED = "struct<title:string,markdown:string,text:string,tables:int,pictures:array<string>>"


def described(answer: Column) -> Column:
    """Document parts of a ``DESCRIBED`` value: a title, a line an element, tables without rows, figures whose caption is their description.

    Without markdown the text is one paragraph; with neither there is no element. A
    null value gives empty parts. Identifiers count from 1.
    """
    e = line_elements(F.coalesce(answer["markdown"], F.lit("")))
    whole = F.when(answer["markdown"].isNull() & answer["text"].isNotNull(), F.array(F.struct(F.lit(1).alias("seq"), F.lit("paragraph").alias("type"), answer["text"].alias("content"), F.lit(None).cast("int").alias("level"))))
    named = lambda x: F.struct(F.concat(F.lit("elem_"), x["seq"].cast("string")).alias("id"), x["type"].alias("type"), x["content"].alias("content"), x["level"].alias("level"))
    numbers = F.when(answer["tables"] > 0, F.sequence(F.lit(1), answer["tables"])).otherwise(F.array().cast("array<int>"))
    tables = F.transform(numbers, lambda i: F.struct(F.concat(F.lit("table_"), i.cast("string")).alias("id"), F.array().cast("array<array<string>>").alias("rows")))
    figures = F.transform(F.coalesce(answer["pictures"], F.array().cast("array<string>")), lambda d, i: F.struct(F.concat(F.lit("figure_"), (i + 1).cast("string")).alias("id"), d.alias("caption")))
    return F.struct(answer["title"].alias("title"), F.transform(F.coalesce(whole, e), named).alias("content"), figures.alias("figures"), tables.alias("tables"))


def merged_or_whole(converted: DataFrame, merge: bool = True) -> DataFrame:
    """(path, elements, error): elements of the markdown; where it has none but is not blank, the whole text as one paragraph."""
    made = (merged_elements if merge else line_elements)(F.col("markdown"))
    whole = F.array(F.struct(F.lit(1).alias("seq"), F.lit("paragraph").alias("type"), F.coalesce("markdown", F.lit("")).alias("content"), F.lit(None).cast("int").alias("level")))
    return converted.select("path", F.when(F.size(made) > 0, made).otherwise(whole).alias("elements"), "error")


def to_spans(files: DataFrame, read: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Spans of files (path, content) as :mod:`docparity.sources.spans` wants them, and ``error``.

    ``read`` gives the spans of a file without their ``doc_id``, which is the
    path. A file it fails on is one row with ``error`` and nothing else; one without spans has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    rows = [(path, *span, None) for span in read(content.as_py())]
                except Exception as e:  # a broken file must not end the job
                    rows = [(path, *[None] * (len(_ARROW) - 2), f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, f"{SPAN}, error string")


def pdf_spans(files: DataFrame) -> DataFrame:
    """:func:`to_spans` of PDF files, with PyMuPDF; where that is not installed every file is a row that says so."""
    return to_spans(files, _pdf)


def _pdf(content: bytes) -> Iterator[tuple]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        for p, page in enumerate(pdf, 1):
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                if block["type"]:
                    yield p, b, 1, 0, 0, "", None, *block["bbox"]
                for k, line in enumerate(block.get("lines", [])):
                    for i, s in enumerate(line["spans"]):
                        yield p, b, 0, k, i, s["text"], s["size"], *block["bbox"]


def plain_spans(content: bytes, lines: int = 60, size: float = 10.0) -> Iterator[tuple]:
    """Spans of a file of plain text, for :func:`to_spans`: a line that is not blank is a block, so many lines a page, so many points a letter."""
    for n, line in enumerate(content.decode("utf-8").split("\n")):
        if line.strip():
            y = n % lines * 1.2 * size
            yield n // lines + 1, n % lines, 0, 0, 0, line, size, 0.0, y, len(line) * size / 2, y + size


_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in f"{SPAN}, error string".split(", "))])
