import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lurelight.streaming import clocks

SCHEMA = "source string, checked_at timestamp, ok boolean"
ZERO = datetime(2026, 1, 1)


def at(minute):
    return ZERO + timedelta(minutes=minute)


def changes(d):
    return sorted((r.source, int((r["at"] - ZERO).total_seconds() // 60), r.state, r.by_run) for r in d.collect())


def plain(runs, end=None):
    """The changes by one circuit for each source."""
    out = []
    for source in {r[0] for r in runs}:
        c = clocks.Circuit(3, 30, 20)
        for _, m, ok in sorted(r for r in runs if r[0] == source):
            out += [(source, *x) for x in c.run(m, ok)]
        out += [(source, *x) for x in c.idle(10**9 if end is None else end)]
    return sorted(out)


def test_circuits():
    fail = [("a", m, False) for m in (1, 2, 3)]
    assert plain(fail) == [("a", 3, "opened", True), ("a", 23, "standby", False), ("a", 33, "closed", False)]
    assert plain([*fail, ("a", 10, True)]) == [("a", 3, "opened", True), ("a", 10, "closed", True), ("a", 30, "standby", False)]
    # a failure while it is open prolongs it, one after it closed opens it again
    assert ("a", 45, "closed", False) in plain([*fail, ("a", 15, False)])
    assert [x[1:3] for x in plain([*fail, ("a", 33, False)])] == [(3, "opened"), (23, "standby"), (33, "active"), (33, "closed"), (33, "opened"), (53, "standby"), (63, "closed")]


def test_windows(spark):
    rng = random.Random(4)
    runs = [(rng.choice("abc"), m, rng.random() < 0.4) for m in rng.sample(range(1, 900), 160)] + [("solo", 5, True)]
    d = spark.createDataFrame([(s, at(m), ok) for s, m, ok in runs] + [("a", None, True), ("b", at(3), None)], SCHEMA)
    assert changes(clocks.changes_of(d)) == plain(runs)
    assert clocks.changes_of(d.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    """Runs in any order over several triggers, with restarts; late ones are left out."""
    rng, path, out = random.Random(9), str(tmp_path / "in"), str(tmp_path / "out")
    runs = sorted(((rng.choice("ab"), m, rng.random() < 0.3) for m in rng.sample(range(1, 400), 90)), key=lambda r: r[1])

    def put(rows):
        d = spark.createDataFrame([(s, at(m), ok) for s, m, ok in rows], SCHEMA)
        d.orderBy(F.hash("checked_at")).repartition(2).write.mode("append").parquet(path)

    def drain():
        d = clocks.circuit_changes(spark.readStream.schema(SCHEMA).parquet(path))
        with clocks.with_timers(spark):
            d.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return changes(spark.read.parquet(out).filter("source <> 'clock'"))

    half = [r for r in runs if r[1] < 200]
    put(half)
    some = drain()
    newest = max(m for _, m, _ in half)
    assert some == [x for x in plain(half, newest - 10) if x[1] <= newest - 10]  # what is certain
    put([r for r in runs if r[1] >= 200] + [("a", 1, True), ("b", 2, True)])  # two come far too late
    drain()
    put([("clock", 100_000, True)])
    assert drain() == plain(runs) == drain()


def test_runs_of_a_batch_wait_as_one_value():
    """However many runs come at once, the state gets one value of them."""
    import pandas as pd

    class State:
        def __init__(self):
            self.values, self.calls = [], 0

        exists = lambda self: bool(self.values)
        get = lambda self: list(self.values)

        def update(self, v):
            self.values = [v]

        def appendValue(self, v):
            self.values.append(v)
            self.calls += 1

        def appendList(self, vs):
            self.values += vs
            self.calls += len(vs)

        def put(self, vs):
            self.values = list(vs)

        def clear(self):
            self.values = []

    class Value(State):
        get = lambda self: self.values[0]

    class Handle:
        timers = []
        listTimers = lambda self: list(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    rng = random.Random(3)
    runs = [("a", m, rng.random() < 0.4) for m in rng.sample(range(1, 900), 300)]
    clock = clocks.Clock(3, 30 * 60_000, 20 * 60_000)
    clock.handle, clock.circuit, clock.waiting = Handle(), Value(), State()
    rows = pd.DataFrame({"checked_at": pd.to_datetime([at(m) for _, m, _ in runs]), "ok": [ok for _, _, ok in runs]})
    zero = int(pd.Timestamp(ZERO).value // 1_000_000)
    out = list(clock.handleInputRows(("a",), iter([rows[:120], rows[120:]]), Times(0)))
    assert not out and clock.waiting.calls == 1
    out = [x for minute in (200, 10**6) for x in clock.handleExpiredTimer(("a",), Times(zero + minute * 60_000), None)]
    got = sorted((r.source, int((r.at - pd.Timestamp(ZERO)).total_seconds() // 60), r.state, r.by_run) for d in out for r in d.itertuples())
    assert got == plain(runs) and not clock.waiting.values
