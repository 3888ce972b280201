"""Labelled corpora as files: JSON lines by part, read strictly, and compared.

A line that is no item is a row of its own with the reason, so a damaged file neither
stops a job nor passes unseen; the gate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas

PARTS = ["positives", "adversarial", "negatives", "constructed"]


def part_of() -> Column:
    """The file that an item belongs to."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    positive = flag(F.col("expected") == "malicious") | flag(F.col("label") == "positive")
    return F.when(flag("constructed"), "constructed").when(flag("adversarial"), "adversarial").when(positive, "positives").otherwise("negatives")


def write(items: DataFrame, path: str, files: int = 1) -> None:
    """Items (schemas.CORPUS) as JSON lines, a folder for each part and up to
    ``files`` files in it. Absent fields are left out."""
    d = items.withColumn("part", part_of())
    spread = F.pmod(F.xxhash64("id", "domain"), F.lit(files))
    d.repartition("part", spread).sortWithinPartitions("part", "id").write.partitionBy("part").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """part, the fields of schemas.CORPUS, and broken: null for an item, else why the
    line is none: not JSON, without a name, or labelled with neither or two words."""
    damaged = "_damaged"
    schema = StructType([*schemas.CORPUS, StructField(damaged, StringType()), StructField("part", StringType())])
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", damaged).json(path)
    expected, label = F.col("expected"), F.col("label")
    known = F.coalesce(expected.isin("malicious", "benign"), F.lit(True)) & F.coalesce(label.isin("positive", "negative"), F.lit(True)) & F.coalesce(expected, label).isNotNull()
    agree = F.coalesce((expected == "malicious") == (label == "positive"), F.lit(True))
    why = F.when(F.col(damaged).isNotNull(), "json").when(F.coalesce(F.col("domain"), F.lit("")) == "", "domain").when(~known, "label").when(~agree, "contradiction").when(~F.col("part").isin(PARTS), "part")
    return d.select("part", *[f.name for f in schemas.CORPUS], why.alias("broken"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The items of a corpus that has no broken line; else an error when it is read."""
    d = lines(spark, path)
    fail = F.raise_error(F.concat(F.lit("broken line of the corpus: "), "broken")).cast("boolean")
    return d.filter(F.when(F.col("broken").isNotNull(), fail).otherwise(True)).drop("broken")


def changes(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The items of two evaluations that differ: key, change (added, removed,
    changed) and the names of the columns that did. Keys are unique on either side; two
    nulls are equal."""
    a, b = (d.select(*key, F.struct(*columns).alias(n)) for d, n in ((before, "_a"), (after, "_b")))
    d = a.join(b, key, "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differ) > 0, "changed")
    none = F.array().cast("array<string>")
    return d.select(*key, kind.alias("change"), F.when(kind == "changed", differ).otherwise(none).alias("columns")).filter("change is not null")
