"""Health of logs and sources, and circuit breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .findings import latest

STALE_MINUTES, LAG_ENTRIES = 20, 100_000
BREAKS_AT, OPEN_MINUTES = 3, 30
STATUSES = ["ok", "degraded", "stale", "failed"]
#: Streams and searches, which have a run but no cursor.
SINGLE = {"certstream": "websocket", "crtsh": "http"}


def status(errors: Column, checked_at: Column, lag: Column, now: Column) -> Column:
    """``errors``: array of messages."""
    n = F.coalesce(F.size(errors), F.lit(0))
    fatal = F.exists(errors, lambda e: F.contains(e, F.lit("circuit")) | F.contains(e, F.lit("invalid")))
    return (
        F.when((n > 0) & fatal, "failed")
        .when(n > 0, "degraded")
        .when(checked_at < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES"), "stale")
        .when(lag > LAG_ENTRIES, "degraded")
        .otherwise("ok")
    )


def log_health(logs: DataFrame, cursors: DataFrame, now: Column) -> DataFrame:
    """``logs`` with the cursor found by id, submission or monitoring address, in
    that order, and their status. Cursors join once, on exploded keys."""
    keys = logs.select("log_id", F.posexplode(F.array("log_id", "submission_url", "monitoring_url")).alias("place", "key"))
    found = keys.join(cursors, "key").groupBy("log_id").agg(F.min_by(F.struct("tree_size", "next_index", "checked_at", "last_error"), "place").alias("c"))
    out = logs.join(found, "log_id", "left").select(*[c for c in logs.columns], F.coalesce("c.tree_size", F.lit(0)).cast("long").alias("tree_size"), F.coalesce("c.next_index", F.lit(0)).cast("long").alias("next_index"), F.coalesce("c.checked_at", "refreshed_at").alias("last_checked_at"), "c.last_error")
    out = out.withColumn("lag_entries", F.greatest(F.lit(0), F.col("tree_size") - F.col("next_index")))
    errors = F.when(F.col("last_error") != "", F.array("last_error")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("status", status(errors, F.col("last_checked_at"), F.col("lag_entries"), now))


def run_health(runs: DataFrame, now: Column) -> DataFrame:
    """source, protocol, status of the two single sources by their latest run; a
    source that never ran counts as ok."""
    last = latest(runs.select("source", "checked_at", "errors"), "source", "checked_at")
    names = runs.sparkSession.createDataFrame(list(SINGLE.items()), "source string, protocol string")
    said = F.coalesce(F.transform("errors", lambda e: e["message"]), F.array().cast("array<string>"))
    return names.join(last, "source", "left").select("source", "protocol", status(said, F.col("checked_at"), F.lit(None).cast("long"), now).alias("status"))


def overall(statuses: DataFrame) -> DataFrame:
    """One row over ``statuses`` (status): healthy, degraded or down."""
    good = F.bool_or(F.col("status").isin("ok", "degraded"))
    return statuses.agg(F.when(F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)), "healthy").when(good, "degraded").otherwise("down").alias("overall"))


def protocol_counts(statuses: DataFrame) -> DataFrame:
    """protocol, total and a count for each status."""
    return statuses.groupBy("protocol").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def breakers(runs: DataFrame, key: str, at: str, ok: str, breaks_at: int = BREAKS_AT) -> DataFrame:
    """Stretches of failures: (key, first, last, failures, opened) where
    ``failures`` consecutive failures ran without a success between them, and
    ``opened`` says whether they open the circuit."""
    order = Window.partitionBy(key).orderBy(at)
    island = F.sum(F.col(ok).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = runs.withColumn("_island", island).filter(~F.col(ok))
    out = rows.groupBy(key, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("failures"))
    return out.withColumn("opened", F.col("failures") >= breaks_at).drop("_island")
