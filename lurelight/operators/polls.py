"""Composites: a poll from entries to tables, mining of hard negatives,
evaluation of a labelled corpus, the status page's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import idna
from ..reference import Reference
from . import findings, health, quality
from .logs import round_robin  # noqa: F401  (rotation belongs to polls)
from .score import score_certificates, score_distinct_hosts

#: A source's name in listings.
LABELS = {"certstream": "CertStream", "direct_ct": "Direct CT", "static_ct": "Static CT", "crtsh": "crt.sh"}


def source_label(source: Column) -> Column:
    out = source
    for name, label in LABELS.items():
        out = F.when(source == name, label).otherwise(out)
    return out


def source_runs(polled: DataFrame, entries: DataFrame, errors: DataFrame, checked_at: Column) -> DataFrame:
    """A run record for each source of ``polled`` (source, duration_ms), whether
    it gave something or failed: ``entries`` (source), ``errors`` (source,
    message). A failure is a row, never an exception. A source without entries
    and errors is on standby."""
    n = entries.groupBy("source").agg(F.count("*").cast("int").alias("scanned_entries"))
    said = errors.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("message"))).alias("errors"))
    none = F.array().cast("array<struct<message:string>>")
    d = polled.join(n, "source", "left").join(said, "source", "left").withColumns({"scanned_entries": F.coalesce("scanned_entries", F.lit(0)), "errors": F.coalesce("errors", none)})
    standby = (F.col("scanned_entries") == 0) & (F.size("errors") == 0)
    return d.select(
        "source",
        source_label(F.col("source")).alias("label"),
        checked_at.cast("timestamp").alias("checked_at"),
        ((F.size("errors") == 0) & (F.col("scanned_entries") >= 0)).alias("ok"),
        "scanned_entries",
        F.lit(0).alias("matched"),
        F.lit(0).alias("persisted"),
        F.col("duration_ms").cast("int").alias("duration_ms"),
        "errors",
        F.when(standby, F.to_json(F.struct(F.lit("standby").alias("state")))).alias("details"),
    )


def poll(entries: DataFrame, runs: DataFrame, ref: Reference, as_of: Column, tables: dict[str, findings.KeyedTable], run_path: str, name: str | None = None) -> DataFrame:
    """Scores the entries of all sources, merges findings and sightings, appends
    the runs with their counts, and returns the poll's status. State goes last,
    so a poll that breaks off is repeated and merges the same rows. A poll of the
    same ``name`` is the same poll again: its runs are not appended twice."""
    name = name or uuid.uuid4().hex
    entries = idna.ascii_entries(entries)
    ranked = entries.withColumns({"arrival": findings.arrival(entries), "run_source": F.col("source")})
    scored = score_certificates(ranked, ref, as_of).persist()
    rows = findings.sightings(scored).persist()
    tables["findings"].merge(findings.unique_findings(scored.drop("run_source")), name)
    tables["sources"].merge(rows, name)
    done = findings.summarize_runs(runs, scored.select(F.col("run_source").alias("source")), rows.select("source"))
    findings.Batches(entries.sparkSession, run_path, runs.schema).add(done, name)
    status = findings.poll_status(done)
    status = entries.sparkSession.createDataFrame(status.collect(), status.schema)  # one row; its reader scores nothing again
    if "state" in tables:
        state = status.select(F.lit("ct_poll_status").alias("key"), F.to_json(F.struct("*")).alias("value"), as_of.cast("timestamp").alias("updated_at"))
        tables["state"].merge(state, name)
    rows.unpersist()
    scored.unpersist()
    return status


def mine(hosts: DataFrame, ref: Reference, as_of: Column, low: int = 25, high: int = fixed.CRITICAL) -> DataFrame:
    """Hard negatives among the names of certificates: ``hosts`` (ord, host, and
    what else is wanted of the source). Each host is scored once."""
    scored = score_distinct_hosts(hosts, ref, as_of)
    return quality.band_candidates(scored.select(*hosts.columns, "registrable", "score", "severity", "suppressed"), low, high)


def tail_tiles(size: Column, tiles: int = 120, width: int = 256) -> Column:
    """Indexes of a log's last full tiles, oldest first."""
    full = F.floor(size / width)
    return F.when(full > 0, F.sequence(F.greatest(full - tiles, F.lit(0)), full - 1)).otherwise(F.array().cast("array<bigint>"))


def find_log(logs: DataFrame, part: str) -> DataFrame:
    """The first log, by description, whose description holds the text; one row,
    or an error when it is read."""
    hit = logs.filter(F.instr(F.lower("description"), part.lower()) > 0).orderBy("description").limit(1)
    n = hit.agg(F.count("*").alias("n"))
    return hit.join(F.broadcast(n.filter(F.assert_true(F.col("n") == 1, F.lit(f"no log like {part}")).isNull()).drop("n")), how="cross")  # one row


def evaluate(items: DataFrame, ref: Reference, as_of: Column) -> dict[str, DataFrame]:
    """Threshold sweep and groups over the headline items of a labelled corpus
    (schemas.CORPUS), and what passes of the adversarial and constructed ones."""
    d = items.withColumnRenamed("domain", "host").drop("registrable")
    scored = score_distinct_hosts(d, ref, as_of).withColumn("positive", quality.is_positive(F.col("expected"), F.col("label")))
    sets = quality.split_sets(scored)
    every = scored.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("adversarial", "constructed")})
    return {"sweep": quality.sweep(sets["headline"]), "groups": quality.by_group(sets["headline"], "brand"), "passes": quality.passes(every), "composition": quality.composition(items)}


def status_page(logs: DataFrame, cursors: DataFrame, runs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Sources with their status, counts by protocol, and the overall word."""
    by_log = health.log_health(logs, cursors, now).select(F.coalesce("log_id", "description").alias("source"), "protocol", "status", "tree_size", "next_index", "lag_entries", "last_checked_at")
    every = by_log.unionByName(health.run_health(runs, now), allowMissingColumns=True)
    return {"sources": every, "protocols": health.protocol_counts(every), "overall": health.overall(every)}
