"""What the operators share: the shared folder, cut lineage, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a temporary folder serves a
    local master; on a cluster that would be another folder on each machine, so it is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tenderspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def collected(spark: SparkSession) -> None:
    """Have the driver collect garbage if its heap has grown past half of its bound.  Iterations leave plans, broadcasts and
    shuffles behind; Spark deletes what nothing reads any more when it is collected, and the heap gives memory back."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder: later stages survive the loss of executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    collected(df.sparkSession)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows of a file that `stored` writes, where it knows how many rows there are at most.
FILE_ROWS = 1 << 16


def stored(df: DataFrame, name: str = "t", most: int | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: known size, pruned columns, no lineage.

    `most`: a bound of its rows, if known; no more tasks write it than so many rows need, so that the last steps of an
    iteration, whose tables are small, don't write a file for each partition of a shuffle."""
    path = scratch(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    df.write.parquet(path)
    collected(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as a shuffle has: for a small table whose rows are about to become many."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of `taken`, in any case."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


#: Bytes of a batch that goes to Python, and the setting's own default.
BATCH, _UNSET = 4 << 20, "67108864b"


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of about BATCH bytes (a longer row stands alone), unless the session sets its own size.

    The buffers of a batch stand outside the heap, several times over, for each core of an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) == _UNSET:
        df.sparkSession.conf.set(name, str(BATCH))
    return df.mapInArrow(run, schema)


def buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, memoryview(data) if data is not None else memoryview(b"")


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each row's UTF-8 bytes, one at a time."""
    at, data = buffers(column)
    for i in range(len(at) - 1):
        yield bytes(data[at[i] : at[i + 1]])


def chunks(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    at, _ = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slim(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others, whatever they are called, are never read."""
    return df.select(*[F.col(f"`{n}`") for n in names])
