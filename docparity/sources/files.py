"""Files as sources: listings, pages, images as data URIs, settings, scraped pages as rows, cached answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docparity.functions.text import data_uri, format_of

VIEWPORTS = [("mobile", 375, 667), ("tablet", 768, 1024), ("desktop", 1920, 1080)]


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): a whole file a row; several files of a folder in one task."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf", first: int = 20) -> DataFrame:
    """(path, name, format, size) of the first files by path; contents are not read. Empty files are left out, as Spark reads none."""
    found = read_binary(spark, path, pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), format_of(F.col("path")).alias("format"), F.col("length").alias("size"))
    return found.orderBy("path").limit(first)


def images_as_uris(files: DataFrame) -> DataFrame:
    return files.select("path", data_uri(F.col("content")).alias("uri"))


def scraped(pages: DataFrame) -> DataFrame:
    """(page_id, id, success, error): a page without HTML is a row with an error, not a failure of the job."""
    from docparity.sources.html import document_id

    ok = F.col("html").isNotNull() & (F.trim("html") != "")
    return pages.select("page_id", F.when(ok, document_id(F.col("url"))).otherwise("error").alias("id"), F.coalesce(ok, F.lit(False)).alias("success"), F.when(~F.coalesce(ok, F.lit(False)), "no content").alias("error"))


def renderings(pages: DataFrame, viewports: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Every page with every viewport; the viewports are a handful of literal rows."""
    v = pages.sparkSession.createDataFrame(viewports or VIEWPORTS, "viewport string, width int, height int")
    return pages.crossJoin(F.broadcast(v))


@dataclass(frozen=True)
class ModelConfig:
    """Settings of the model service, from the session's ``docparity.model.*``."""

    key: str | None = None
    model: str = "default"
    max_tokens: int = 8000
    temperature: float = 0.1
    retries: int = 3
    delay: float = 1.0

    @classmethod
    def from_session(cls, spark: SparkSession) -> ModelConfig:
        found = {k: spark.conf.get(f"docparity.model.{k}", None) for k in cls.__dataclass_fields__}
        kinds = {"max_tokens": int, "temperature": float, "retries": int, "delay": float}
        return cls(**{k: kinds.get(k, str)(v) for k, v in found.items() if v is not None})

    def validate(self) -> tuple[bool, str]:
        if not self.key:
            return False, "no key"
        if self.max_tokens <= 0 or not 0 <= self.temperature <= 2:
            return False, "max_tokens or temperature out of range"
        return True, "ok"
