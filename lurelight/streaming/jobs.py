"""Streaming forms: entries to findings, deduplication, windows, breakers.

Offsets live in the query's checkpoint and sinks are keyed merges, so a replayed
batch changes nothing. There is no watermark unless one is asked for: keyed
merges keep every key, ``dropDuplicatesWithinWatermark`` bounds the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import idna
from ..operators.findings import KeyedTable, arrival, sightings, unique_findings
from ..operators.health import BREAKS_AT, OPEN_MINUTES
from ..operators.score import score_certificates
from ..reference import Reference

CADENCE = "5 minutes"


def write_findings(batch: DataFrame, ref: Reference, as_of: Column, findings: KeyedTable, sources: KeyedTable, name: str | None = None) -> None:
    """Scores one batch of entries and merges findings and sightings. A batch of
    the same name is the same batch again."""
    batch = idna.ascii_entries(batch)
    ranked = batch.withColumns({"arrival": arrival(batch), "run_source": F.col("source")})
    scored = score_certificates(ranked, ref, as_of).persist()
    findings.merge(unique_findings(scored.drop("run_source")), name)
    sources.merge(sightings(scored), name)
    scored.unpersist()


def run_findings(entries: DataFrame, ref: Reference, findings: KeyedTable, sources: KeyedTable, checkpoint: str, as_of: Column | None = None, once: bool = False) -> StreamingQuery:
    """Starts the job over a stream of entries; ``once`` drains what is there."""
    job = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # batches count from 0 at each checkpoint

    def write(batch: DataFrame, number: int) -> None:
        write_findings(batch, ref, as_of if as_of is not None else F.current_timestamp(), findings, sources, f"{job}.{number}")

    w = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=CADENCE)).start()


def deduplicated(stream: DataFrame, key: list[str], at: str | None = None, late: str | None = None) -> DataFrame:
    """First row of each key: for ever, or within a watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if at and late else stream.dropDuplicates(key)


def issuance(rows: DataFrame, at: str, width: str, *keys: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by time window and keys."""
    rows = rows.withWatermark(at, late) if late else rows
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("entries")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "entries")


def sessions(rows: DataFrame, at: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = rows.withWatermark(at, late) if late else rows
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("entries")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "entries")


BREAKER = "source string, checked_at timestamp, failures int, open boolean"


def breaker_states(runs: DataFrame, breaks_at: int = BREAKS_AT, minutes: int = OPEN_MINUTES) -> DataFrame:
    """A stream of runs (source, checked_at, ok) to the circuit's state after each:
    a success closes it, ``breaks_at`` failures in a row open it for ``minutes``.
    The runs of a batch count in the order of their times, in whatever order they
    come (of equal times the failure first). A run that is older than the last one
    of an earlier batch comes too late: it changes nothing and gives no row. Runs
    without a time or an outcome give none either."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, until, last = state.get if state.exists else (0, 0.0, float("-inf"))
        out, seen = [], last
        for at, ok in sorted((at, bool(ok)) for pdf in batches for at, ok in zip(pdf["checked_at"], pdf["ok"])):
            now = at.timestamp()
            if now < last:
                continue
            failures = 0 if ok else failures + 1
            until = 0.0 if ok else now + 60 * minutes if failures >= breaks_at else until
            seen = max(seen, now)
            out.append((key[0], at, failures, until > now))
        yield pd.DataFrame(out, columns=["source", "checked_at", "failures", "open"])
        state.update((failures, until, seen))

    known = runs.select("source", "checked_at", "ok").filter("checked_at is not null and ok is not null")
    return known.groupBy("source").applyInPandasWithState(step, BREAKER, "failures int, until double, last double", "append", GroupStateTimeout.NoTimeout)
