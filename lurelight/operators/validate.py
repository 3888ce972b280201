"""Expectations on reference tables: each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN, SUFFIX, NAME = "^[a-z0-9][a-z0-9-]*$", "^[a-z]{2,}(\\.[a-z]{2,})*$", "^[a-z0-9-]+(\\.[a-z0-9-]+)+$"


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def mismatches(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    return rows.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def outside(rows: DataFrame, column: str, low, high) -> DataFrame:
    return rows.filter(~F.coalesce(F.col(column).between(low, high), F.lit(False)))


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(F.col(key).alias(column)), column, "left_anti")


def shared_tokens(brands: DataFrame) -> DataFrame:
    """Tokens of more than one brand."""
    return brands.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_distinct("id").alias("brands")).filter("brands > 1")


def unverified_metadata(entries: DataFrame) -> DataFrame:
    """Verified allowlist entries (verified, verified_at, source) that do not say when
    and by which https address."""
    said = (F.coalesce("verified_at", F.lit("")) != "") & F.startswith(F.coalesce("source", F.lit("")), F.lit("https://"))
    return entries.filter(F.coalesce("verified", F.lit(False)) & ~said)


def unordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns do not ascend."""
    return rows.filter(~reduce(lambda a, b: a & b, [F.coalesce(F.col(x) <= F.col(y), F.lit(False)) for x, y in zip(columns, columns[1:])]))


def cap_below_top(rows: DataFrame, group: str, value: str, cap: Column, n: int = 3) -> DataFrame:
    """Groups whose ``n`` largest values add up to more than the cap (an aggregate
    or a literal)."""
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value)))).filter(F.col("_r") <= n)
    return top.groupBy(group).agg(F.sum(value).alias("top_sum"), cap.alias("cap")).filter("top_sum > cap").drop("cap")


def reference_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(expectation, broken rows) over the frames of ``reference.frames``."""
    b, k, s, a = (tables[n] for n in ("brands", "keywords", "schemes", "allowlist"))
    w, t = tables["weights"], tables["thresholds"]
    single = w.filter(~F.col("name").isin("keyword_cap")).withColumn("all", F.lit("all")).crossJoin(F.broadcast(t.select("cap")))  # one row
    tokens = b.select("id", F.explode("tokens").alias("token"))
    tlds = b.select("id", F.explode("known_tlds").alias("tld"))
    checks = {
        "brand_ids_unique": duplicates(b, "id"),
        "brand_tokens": mismatches(tokens, "token", TOKEN),
        "brand_tokens_own": shared_tokens(b),
        "brand_distance": outside(b, "max_edit_distance", 0, 2),
        "brand_tlds": mismatches(tlds, "tld", SUFFIX),
        "keywords_unique": duplicates(k, "token"),
        "keyword_tokens": mismatches(k, "token", TOKEN),
        "scheme_ids_unique": duplicates(s, "id"),
        "scheme_distance": outside(s, "max_edit_distance", 0, 2),
        "scheme_registrable": mismatches(s, "official_registrable", NAME),
        "allowlist_registrable": mismatches(a, "registrable", NAME),
        "allowlist_brand": orphans(a, "brand", b, "id"),
        "allowlist_unique": duplicates(a, "registrable", "brand"),
        "weights_not_negative": outside(w, "points", 0, 1_000_000),
        "thresholds_ordered": unordered(t, "medium", "high", "critical"),
        "cap_above_top_three": cap_below_top(single, "all", "points", F.max("cap")),
    }
    parts = [d.agg(F.lit(n).alias("expectation"), F.count("*").alias("broken")) for n, d in checks.items()]
    return reduce(DataFrame.unionByName, parts)
