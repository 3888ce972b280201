"""Written tables that cut lineage, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, as in
    tests on one machine, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lurelight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python at most. Texts are long, and
#: a batch is held several times on both sides.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


class Scratch:
    """Parquet tables of one operator call. ``drop`` removes those that the
    returned DataFrame does not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def near(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it has at most so many (short) rows; else as it
    is, and Spark joins it by a shuffle. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (doc_id), with their
    columns in their order; a null id stays."""
    gone = near(ids)
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
