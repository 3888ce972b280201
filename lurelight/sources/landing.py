"""Landed files of the four kinds of sources, as batches or streams.

A fetcher outside Spark lands what it gets; the stream's checkpoint is the
cursor, and the files taken in one batch are bounded. ``spark.read`` and
``spark.readStream`` take the same options, so each reader serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import decode

FILE = "path string, modificationTime timestamp, length bigint, content binary"
ENTRIES = "entries array<struct<leaf_input:string,extra_data:string>>"


def _reader(spark: SparkSession, stream: bool, files: int | None):
    r = spark.readStream if stream else spark.read
    return r.option("maxFilesPerTrigger", files) if stream and files else r


def messages(spark: SparkSession, path: str, stream: bool = False, files: int | None = 20) -> DataFrame:
    """JSON lines of the live stream as entries."""
    return decode.stream_messages(_reader(spark, stream, files).text(path))


def search_results(spark: SparkSession, path: str, stream: bool = False, files: int | None = 20) -> DataFrame:
    """JSON lines of the identity search as entries."""
    return decode.search_rows(_reader(spark, stream, files).schema(schemas.SEARCH_ROW).json(path))


def tile_index(path: Column) -> Column:
    """Index of a data tile from its path: .../tile/data/x001/x234/067, a partial
    one with .p/ and its width behind."""
    digits = F.regexp_extract(path, "/data/((?:x\\d{3}/)*\\d{3})(?:\\.p/\\d+)?$", 1)
    return F.when(digits != "", F.regexp_replace(digits, "[x/]", "").cast("long"))


def tiles(spark: SparkSession, path: str, log: dict[str, str], cursor: int = 0, stream: bool = False, files: int | None = 20, width: int = 256) -> DataFrame:
    """Data tiles of one log as entries. ``log``: description, operator,
    submission_url, monitoring_url. Files that are no tiles are left out."""
    r = _reader(spark, stream, files).format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(path)
    d = r.select(F.col("content").alias("tile"), (tile_index(F.col("path")) * width).alias("base_index")).filter("base_index is not null")
    d = d.withColumns({c: F.lit(log.get(c)).cast("string") for c in ("description", "operator", "submission_url", "monitoring_url")})
    return decode.log_tiles(d.withColumn("cursor", F.lit(cursor).cast("long")))


def log_pages(spark: SparkSession, path: str, log: dict[str, str], stream: bool = False, files: int | None = 20) -> DataFrame:
    """Pages of an indexed log as entries; a page's file is named by the index of
    its first entry: 1200.json."""
    r = _reader(spark, stream, files).option("wholetext", "true").text(path)
    page = F.from_json("value", ENTRIES)["entries"]
    start = F.regexp_extract(F.col("_metadata.file_name"), "^(\\d+)", 1).try_cast("bigint")
    d = r.select(start.alias("start"), F.posexplode(page).alias("i", "e")).filter("start is not null")
    d = d.select(F.unbase64("e.leaf_input").alias("leaf_input"), (F.col("start") + F.col("i")).alias("cert_index"))
    return decode.log_leaves(d.withColumns({c: F.lit(log.get(c)).cast("string") for c in ("description", "operator", "submission_url", "monitoring_url")}))
