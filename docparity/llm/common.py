"""What the operators of this subpackage share: cutting lineage, the shared folder, slicing Arrow batches."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session in one process (tests) may leave the setting out; it then
    gets a folder of its own. A cluster without it is an error, since a folder
    of one machine would not be seen by the others.
    """
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docparity-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set(_CONF, f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder not used before, below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor costs no recomputation of what is upstream."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage, so that shuffle files of steps that are over go now and not when its heap is full."""
    for _ in range(2):  # what the first collection lets go of may hold other steps
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, longer if a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_lengths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in ``column`` each, never less than a row; bounds what a worker holds."""
    if not batch.num_rows:
        return
    part = np.cumsum(byte_lengths(batch.column(column))) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for i, j in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(int(i), int(j - i))


def _filesystem(uri: str):
    """(file system, path, whether it is a mounted one) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, True
    found, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return found, path, isinstance(found, fs.LocalFileSystem)


def write_whole(uri: str, parts: Iterator[bytes]) -> int:
    """Write a file of the shared folder under another name first, so a task that dies or runs twice leaves no half of it. Bytes written."""
    found, path, _ = _filesystem(uri)
    found.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with found.open_output_stream(own, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    found.move(own, path)
    return size


def open_stream(uri: str):
    """A readable stream on a file of the shared folder."""
    found, path, _ = _filesystem(uri)
    return found.open_input_stream(path, compression=None)


def open_mapped(uri: str) -> np.ndarray:
    """The bytes of a file: mapped where the shared folder is mounted, read into memory where it is an object store."""
    found, path, mounted = _filesystem(uri)
    if mounted:
        return np.memmap(path, dtype=np.uint8, mode="r")
    with found.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)
