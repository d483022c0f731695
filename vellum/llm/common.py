"""What the operators of this folder share: tables, scratch folders and row-wise helpers."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, cut to the columns that an operator reads; others, whatever their names, are never read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in tests where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        root = f"file://{tempfile.gettempdir()}/vellum-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def put_file(folder: str, name: str, raw: bytes) -> None:
    """Write beside, then rename: a reader never sees half a file, and a repeated task puts the same file there."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    ctx = TaskContext.get()
    own = f"{path}/.{name}.{ctx.taskAttemptId() if ctx else 0}"
    with fs.open_output_stream(own) as f:
        f.write(raw)
    fs.move(own, f"{path}/{name}")


def save_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put_file(folder, name, out.getvalue())


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read()), allow_pickle=False))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables that a computation writes and reads on its way, and drops once what it leads to is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch(spark, "tables")

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        return written(df, tag, self.folder)

    def drop(self) -> None:
        remove(self.spark, self.folder)


def written(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """df stored in the shared folder and read again: this cuts the lineage, so that a lost executor costs no recomputation.

    The shuffle files that led to it are of no further use; Spark removes them once the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = f"{folder}/{tag}-{uuid.uuid4().hex}" if folder else scratch(spark, tag)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker at once, where the session sets no limit of its own.
BATCH_BYTES = "8m"


#: Caches of this folder's modules, which a worker empties when its task ends: the next one may be another operator's.
CACHES: list[Callable[[], None]] = []


@lru_cache(1)
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Empty the caches and give memory back to the system: workers live on from stage to stage beside the executor's heap."""
    for empty in CACHES:
        empty()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def in_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes: ten thousand texts at once may be more than a worker can hold."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in (None, "9223372036854775807b", "9223372036854775807"):
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in order, cut so that one piece holds about most_bytes of text, or a single row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def row_op(fn: Callable[[dict], dict], schema: pa.Schema, text: str = "text") -> Callable:
    """mapInArrow function from one of columns: fn gets lists by column name and returns lists by column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_pydict(fn(batch.to_pydict()), schema=schema)

    return run
