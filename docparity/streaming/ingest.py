"""Documents as a stream: every per-document operator is a projection and runs on a stream as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docparity.functions import text as T
from docparity.sources.markdown import line_elements


def read_documents(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def text_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``text_score`` of its lines, summed within the row, so neither state nor shuffle is needed."""
    lines = F.transform(line_elements(F.col(text)), lambda e: F.struct(e["content"].alias("text"), T.clean_text(e["content"]).alias("clean")))
    counts = F.transform(lines, lambda c: F.struct(*[v.alias(k) for k, v in T.element_counts(c["text"], c["clean"]).items()]))
    total = F.aggregate(counts, F.struct(*[F.lit(0).cast("long").alias(k) for k in T.ADDITIVE]), lambda a, x: F.struct(*[(a[k] + x[k]).alias(k) for k in T.ADDITIVE]))
    scored = docs.withColumn("__dp_total", total)
    return scored.withColumn("text_score", T.text_score(T.text_ratios({k: F.col("__dp_total")[k] for k in T.ADDITIVE}))).drop("__dp_total")


def windowed_scores(scored: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", key: str = "source") -> DataFrame:
    """Counts and mean scores by window and key; rows later than ``late`` are left out, so state is bounded."""
    return scored.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("text_score").alias("avg_score"), F.count_if(F.col("text_score") < 0.65).alias("weak"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, all there is now; the checkpoint makes a later call go on from there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
