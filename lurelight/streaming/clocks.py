"""Circuits that close, and sources that fall silent, by the clock of the stream.

A run tells what a source did; that nothing came is told by time alone. Event-time
timers give the rows that no run causes: a circuit closes when no run came for
``minutes`` after its last failure, and a source without any run for ``silence`` minutes
is on standby. Needs the RocksDB state store (``with_timers``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import BREAKS_AT, OPEN_MINUTES, STALE_MINUTES

CHANGES = "source string, at timestamp, state string, by_run boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Circuit:
    """The state of one source; times in milliseconds. ``run`` and ``idle`` give the
    changes (time, state, by_run)."""

    def __init__(self, breaks_at: int, open_ms: int, silence_ms: int, state: tuple = (0, 0, 0, False, False)):
        self.breaks_at, self.open_ms, self.silence_ms = breaks_at, open_ms, silence_ms
        self.failures, self.until, self.last, self.open, self.standby = state

    def state(self) -> tuple:
        return self.failures, self.until, self.last, self.open, self.standby

    def due(self) -> list[tuple[int, str]]:
        """What happens next if no run comes."""
        out = [(self.until, "closed")] if self.open else []
        if self.last and not self.standby:
            out.append((self.last + self.silence_ms, "standby"))
        return sorted(out)

    def idle(self, to: int) -> Iterator[tuple[int, str, bool]]:
        """Time passes up to and including ``to`` without a run."""
        while (due := self.due()) and due[0][0] <= to:
            at, what = due[0]
            self.open, self.standby = self.open and what != "closed", self.standby or what == "standby"
            yield at, what, False

    def run(self, at: int, ok: bool) -> Iterator[tuple[int, str, bool]]:
        yield from self.idle(at)
        if self.standby:
            self.standby = False
            yield at, "active", True
        self.last, self.failures = at, 0 if ok else self.failures + 1
        if ok and self.open:
            self.open = False
            yield at, "closed", True
        elif self.failures >= self.breaks_at:
            self.until = at + self.open_ms
            if not self.open:
                self.open = True
                yield at, "opened", True


class Clock(StatefulProcessor):
    """Runs wait until the watermark has passed them, so they count in the order of
    their times in whatever order they come; one timer a source stands for the first
    of them, or for what happens if none comes. The runs of a batch wait as one value,
    twice a run's time and one more if it was good, since each value of a state is sent
    to its store and back by itself."""

    def __init__(self, breaks_at: int, open_ms: int, silence_ms: int):
        self.limits = breaks_at, open_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.circuit = handle.getValueState("circuit", "failures int, until long, last long, open boolean, standby boolean")
        self.waiting = handle.getListState("waiting", "runs binary")

    def _settled(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """All that is certain at the watermark, and a timer for what comes next."""
        c = Circuit(*self.limits, *([tuple(self.circuit.get())] if self.circuit.exists() else []))
        held = [np.frombuffer(bytes(r[0]), "<i8") for r in self.waiting.get()] if self.waiting.exists() else []
        runs = np.sort(np.concatenate(held)) if held else np.array([], "<i8")
        settled = int(np.searchsorted(runs, 2 * watermark + 1, "right"))
        out = [change for run in runs[:settled].tolist() for change in c.run(run >> 1, bool(run & 1))]
        out += c.idle(watermark)
        self.circuit.update(c.state())
        later = runs[settled:]
        if settled:
            self.waiting.put([(later.tobytes(),)]) if len(later) else self.waiting.clear()
        self._wake(c, int(later[0]) >> 1 if len(later) else None)
        if out:
            text = lambda x: pd.Series(x, dtype=object)
            at, state, by_run = zip(*out)
            yield pd.DataFrame({"source": text([key[0]] * len(out)), "at": pd.to_datetime(list(at), unit="ms"), "state": text(state), "by_run": list(by_run)})

    def _wake(self, c: Circuit, later: int | None) -> None:
        """One timer, for the first run that waits or what is due before it."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at = [t for t, _ in c.due()[:1]] + ([] if later is None else [later])
        if at:
            self.handle.registerTimer(min(at))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [pdf["checked_at"].to_numpy("datetime64[ms]").astype("<i8") * 2 + pdf["ok"].to_numpy(bool) for pdf in rows]
        self.waiting.appendValue((np.concatenate(new).astype("<i8").tobytes(),))
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def circuit_changes(runs: DataFrame, late: str = "10 minutes", breaks_at: int = BREAKS_AT, minutes: int = OPEN_MINUTES, silence: int = STALE_MINUTES) -> DataFrame:
    """A stream of runs (source, checked_at, ok) to the changes of each source
    (CHANGES): opened, closed, standby, active. Runs count in the order of their times,
    of equal times the failure first; those later than the watermark are left out, and so
    are runs without a time or an outcome. Changes come when the watermark passes
    them."""
    known = runs.select("source", "checked_at", "ok").filter("checked_at is not null and ok is not null").withWatermark("checked_at", late)
    clock = Clock(breaks_at, 60_000 * minutes, 60_000 * silence)
    return known.groupBy("source").transformWithStateInPandas(clock, CHANGES, "Append", "EventTime")


def changes_of(runs: DataFrame, breaks_at: int = BREAKS_AT, minutes: int = OPEN_MINUTES, silence: int = STALE_MINUTES) -> DataFrame:
    """The same over a finished table of runs, by windows: what a drained stream gives
    once its watermark has passed everything."""
    from pyspark.sql import Window

    by = Window.partitionBy("source").orderBy("checked_at", "ok")
    d = runs.select("source", "checked_at", "ok").filter("checked_at is not null and ok is not null")
    d = d.withColumn("_i", F.sum(F.col("ok").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stretch = Window.partitionBy("source", "_i").orderBy("checked_at", "ok")
    d = d.withColumn("_n", F.when(~F.col("ok"), F.count_if(~F.col("ok")).over(stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(0))
    span = lambda m: F.expr(f"INTERVAL {m} MINUTES")
    d = d.withColumns({"_t": F.lag("checked_at").over(by), "_m": F.lag("_n").over(by), "_next": F.lead("checked_at").over(by)})
    was_open = (F.col("_m") >= breaks_at) & (F.col("checked_at") < F.col("_t") + span(minutes))
    change = lambda when, at, state, by_run: F.when(when, F.struct(at.alias("at"), F.lit(state).alias("state"), F.lit(by_run).alias("by_run")))
    at = F.col("checked_at")
    every = F.array(
        change(F.col("_t").isNotNull() & (at >= F.col("_t") + span(silence)), at, "active", True),
        change(~F.col("ok") & (F.col("_n") >= breaks_at) & ~F.coalesce(was_open, F.lit(False)), at, "opened", True),
        change(F.col("ok") & was_open, at, "closed", True),
        change((F.col("_n") >= breaks_at) & F.coalesce(F.col("_next") >= at + span(minutes), F.lit(True)), at + span(minutes), "closed", False),
        change(F.coalesce(F.col("_next") >= at + span(silence), F.lit(True)), at + span(silence), "standby", False),
    )
    return d.select("source", F.explode(F.filter(every, lambda c: c.isNotNull())).alias("c")).select("source", "c.*")
