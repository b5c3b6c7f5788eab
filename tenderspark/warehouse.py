"""Stored marts: each is built once from a source folder, published as Parquet, and read by all queries afterwards."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize
from .plans import adapter, marts
from .sources import io

#: Folder of the marts under the session's warehouse; spark.tenderspark.marts names another one.
FOLDER, SETTING = "tenderspark-marts", "spark.tenderspark.marts"


class Warehouse:
    """Marts of one source folder.

    They stand under a key of what the folder holds (names, sizes and times of its tables) and of the builders' code, so a
    changed source or a changed builder is never answered from an old mart.  Rows are dealt by ranges of the mart's key and
    sorted by it, so a filter on the key prunes files and row groups.
    """

    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source = spark, source.rstrip("/")
        root = spark.conf.get(SETTING, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{FOLDER}"
        code = "".join(inspect.getsource(m) for m in (normalize, adapter, marts))
        mark = hashlib.sha256(repr((self.source, io.listing(spark, self.source), code)).encode()).hexdigest()
        self.root = f"{root}/{mark[:24]}"

    def mart(self, name: str, build: Callable[[], DataFrame], key: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.root}/{name}"
        if io.current(self.spark, path) is None:
            df = build()
            order = [*partition_by, *key]
            if order:
                df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            io.publish(df, path, partition_by=partition_by)
        return io.published(self.spark, path)

    def refresh(self, names: Sequence[str], builders: dict[str, Callable[[], DataFrame]], hours: float = 12, force: bool = False) -> list[str]:
        """Publish anew those marts that are not fresh; tells which."""
        return [n for n in names if io.publish_if_stale(builders[n], f"{self.root}/{n}", self.spark, hours, force)]

    def sizes(self) -> DataFrame:
        """Rows of each published mart, from the footers."""
        found = [n for n, *_ in io.listing(self.spark, self.root)] if io.exists(self.spark, self.root) else []
        rows = [(n, io.row_count(self.spark, io.current(self.spark, f"{self.root}/{n}"))) for n in found if io.current(self.spark, f"{self.root}/{n}")]
        return self.spark.createDataFrame(rows, "mart string, n long").orderBy(F.col("mart"))
