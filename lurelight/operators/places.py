"""Places of rows in an order, without all rows meeting in one task.

Rows go to ranges of the order; the ranges are written, so that their limits are
fixed, and counted; a row's place is its place in its range behind the counts of the
ranges before it. Only ranges that hold a wanted place are ordered.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a range, about.
RANGE = 50_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share;
    only on one machine, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lurelight-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Ordered:
    """``rows`` in the order of some columns, ready to be numbered."""

    def __init__(self, rows: DataFrame, order: list[Column | str], size: int = RANGE):
        self.order, n = order, rows.count()
        path = shared_folder(rows.sparkSession, "ordered")
        rows.repartitionByRange(max(1, math.ceil(n / size)), *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
        self.rows = rows.sparkSession.read.schema(StructType([*rows.schema, StructField("_range", IntegerType())])).parquet(path)
        counts = sorted((r["_range"], r["n"]) for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row a range
        self.starts, self.n = {}, 0
        for at, k in counts:
            self.starts[at], self.n = self.n, self.n + k
        self._ends = {at: self.starts[at] + k for at, k in counts}

    def numbered(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The rows with their ``place`` from 0, of those places from ``first`` to
        before ``last``."""
        last = self.n if last is None else last
        some = [at for at, start in self.starts.items() if start < last and self._ends[at] > first]
        table = self.rows.sparkSession.createDataFrame([(at, self.starts[at]) for at in some], "_range int, _start long")
        d = self.rows.filter(F.col("_range").isin(some)) if some else self.rows.limit(0)
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)) - 1 + F.col("_start")
        return d.join(F.broadcast(table), "_range").withColumn("place", place).drop("_range", "_start").filter((F.col("place") >= first) & (F.col("place") < last))
