"""Readers, writers, views and publication of tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

POINTER = "_CURRENT"


# -- readers ----------------------------------------------------------------------------------------------------------


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file or a folder of parts."""
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, thousands: Sequence[str] = ()) -> DataFrame:
    """With a header; columns in `thousands` lose their commas and become doubles."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.regexp_replace(c, ",", "").try_cast("double") for c in thousands}) if thousands else df


def delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """All columns as strings, no header; lines with another number of fields are dropped."""
    fields = F.split("value", f"\\Q{sep}\\E", -1)
    rows = spark.read.text(path).select(fields.alias("f")).where(F.size("f") == len(columns))
    return rows.select(*[F.nullif(F.col("f")[k], F.lit("")).alias(c) for k, c in enumerate(columns)])


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or a typed empty one where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else empty(spark, schema)


def describe(df: DataFrame) -> DataFrame:
    """One row a column: its place, name, type, and whether it may be null."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "place int, column_name string, column_type string, nullable boolean")


def row_count(spark: SparkSession, path: str) -> int:
    """From the Parquet footers alone, in a session of its own, so that no setting of the caller's changes."""
    own = spark.newSession()
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", "csv,json,orc,text")
    return own.read.parquet(path).count()


# -- files ------------------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """What stands under a folder: name, bytes, files, time of the last change, in order of names."""
    fs, p, _ = _fs(spark, path)
    out = []
    for s in fs.listStatus(p):
        total = fs.getContentSummary(s.getPath())
        out.append((s.getPath().getName(), total.getLength(), total.getFileCount(), s.getModificationTime()))
    return sorted(out)


def is_fresh(spark: SparkSession, path: str, hours: float = 12, force: bool = False, now: float | None = None) -> bool:
    """A published table that is not older than `hours`; never when forced."""
    fs, p, _ = _fs(spark, f"{path}/{POINTER}")
    if force or not fs.exists(p):
        return False
    return (now or time.time()) - fs.getFileStatus(p).getModificationTime() / 1000 <= hours * 3600


# -- publication ------------------------------------------------------------------------------------------------------


def _write(df: DataFrame, path: str, compression: str, partition_by: Sequence[str], single: bool) -> None:
    out = (df.coalesce(1) if single else df).write.option("compression", compression)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def publish(df: DataFrame, path: str, compression: str = "zstd", partition_by: Sequence[str] = (), single: bool = False, keep: int = 2) -> None:
    """Write a new version beside the others, then point to it.

    The pointer is a small file that is replaced in one atomic rename, so there is a whole table at any time, a failed write
    leaves the old one, and of two writers the later one wins.  The last `keep` versions stay for those who still read them.
    """
    spark = df.sparkSession
    fs, p, new = _fs(spark, path)
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _write(df, f"{path}/{version}", compression, partition_by, single)
    staged = new(f"{path}/.{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(new(f"{path}/{POINTER}")), options)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-"))
    for old in versions[:-keep]:
        if old != version:
            fs.delete(new(f"{path}/{old}"), True)


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that is published under `path`."""
    fs, p, _ = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return f"{path}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> DataFrame:
    where = current(spark, path)
    if where is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(where)


def publish_if_stale(build: Callable[[], DataFrame], path: str, spark: SparkSession, hours: float = 12, force: bool = False) -> bool:
    """Build and publish unless the table is fresh; tells whether it did."""
    if is_fresh(spark, path, hours, force):
        return False
    publish(build(), path)
    return True


def unload(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Parts of a query's result, as many as its partitions."""
    _write(df, path, compression, (), False)


def merge(spark: SparkSession, source: str, path: str, compression: str = "zstd") -> None:
    """Parts of a folder as one file."""
    _write(spark.read.parquet(source), path, compression, (), True)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# -- names ------------------------------------------------------------------------------------------------------------


def view(df: DataFrame, name: str) -> DataFrame:
    """Create the view, or replace it: queries that start afterwards see the new one."""
    df.createOrReplaceTempView(name)
    return df


def published_view(spark: SparkSession, path: str, name: str, schema: StructType | str) -> DataFrame:
    """A view of the published version, or of a typed empty table before there is one."""
    return view(published(spark, path) if current(spark, path) else empty(spark, schema), name)


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def create_table(df: DataFrame, name: str) -> DataFrame:
    """A table of the catalogue from a query; an old one of that name is replaced."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def run(spark: SparkSession, sql: str, parameters: Sequence | dict = ()) -> DataFrame:
    """A parameterised statement: values are bound, never pasted into the text."""
    return spark.sql(sql, args=parameters if isinstance(parameters, dict) else list(parameters)) if parameters else spark.sql(sql)
