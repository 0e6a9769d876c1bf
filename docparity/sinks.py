"""Sinks: documents and reports as JSON, one output a document, the three files of a comparison run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(*columns: str) -> Column:
    """One JSON object a row, nulls kept, pretty-printed."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": "true"})


def write_json(df: DataFrame, path: str) -> None:
    """A row a line; for whole corpora, splittable by the reader."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_converted(docs: DataFrame, path: str, key: str = "doc_id", body: str = "text", suffix: str = "md") -> None:
    """One folder a document (``key=value``) with one text file each, written by the executors. ``suffix`` is the folder's last part."""
    docs.select(F.col(key), F.col(body).alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/{suffix}")


def write_workflow(tool: DataFrame, model: DataFrame, comparison: DataFrame, path: str) -> None:
    for name, df in (("tool", tool), ("vlm", model), ("comparison", comparison)):
        write_json(df, f"{path}/{name}")


def write_binary_files(images: DataFrame, path: str, name: str = "img_id", content: str = "diff_image") -> int:
    """Difference images and baselines as files of a mounted folder, written by the executors under another name first. Files written."""

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for n, c in zip(batch.column(name).to_pylist(), batch.column(content).to_pylist()):
                own = os.path.join(path, f".{n}.{os.getpid()}")
                with open(own, "wb") as f:
                    f.write(c)
                os.replace(own, os.path.join(path, str(n)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return images.where(F.col(content).isNotNull()).select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
