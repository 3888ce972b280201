import base64
import json

from pyspark.sql import functions as F

from lurelight.operators import polls
from lurelight.sources import offsets

from .test_operators import cert, u


def record(name="posb-login.top"):
    whole = cert(name, [name])
    return u(1_700_000_000_000, 8) + u(0, 2) + u(len(whole), 3) + whole + u(0, 2) + u(0, 2)


def leaf():
    whole = cert("posb-login.top", ["posb-login.top"])
    return base64.b64encode(b"\0\0" + u(1_700_000_000_000, 8) + u(0, 2) + u(len(whole), 3) + whole).decode()


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())


def page(n):
    return {"entries": [{"leaf_input": leaf(), "extra_data": ""}] * n}


def test_units():
    at = lambda rest: (x := offsets.unit("l", rest, rest)) and (x.first, x.end, x.tile)
    assert at("1200.json") == (1200, 1201, False) and at("start=7/part-0.txt") == (7, 8, False)
    assert at("tile/data/x001/x234/067") == (1234067 * 256, 1234068 * 256, True) and at("tile/data/002.p/9") == (512, 521, True)
    assert [at(x) for x in ("head.json", "tile/names/001", "checkpoint", "a/7.json")] == [None] * 4


def test_admission():
    of = lambda *at: [offsets.Unit("l", str(a), a, a + 1, False) for a in at]
    units = {"a": of(0, 10, 20), "b": of(5)}
    one = offsets.admitted(units, {}, 1)
    assert one == {"a": 1, "b": 6}
    two = offsets.admitted(units, one, 1)
    assert two == {"a": 11, "b": 6} and [x.first for x in offsets.between(units, one, two)] == [10]
    assert offsets.admitted(units, two, None) == {"a": 21, "b": 6} and offsets.admitted({}, two, 3) == two
    # a log whose files went keeps its cursor; a new one begins at its first unit
    assert offsets.admitted({"c": of(3)}, two, 1) == {"a": 11, "b": 6, "c": 4}


def test_stream_with_restarts(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for start in (0, 3, 6, 9):
        put(root / "one" / f"{start}.json", page(3))
    put(root / "two" / "tile" / "data" / "000.p" / "2", record() * 2)
    put(root / "bad" / "0.json", b"not json")
    put(root / "bad" / "4.json", page(1))
    put(root / "_unfinished" / "0.json", page(9))

    def drain():
        s = offsets.landed_logs(spark, str(root), True, 2, str(tmp_path / "cursors" / "c.json")).select("log", "cert_index", "cursor", (F.col("error").isNotNull()).alias("bad"), F.octet_length("tile").alias("tile"))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.log, r.cert_index) for r in spark.read.parquet(out).collect() if not r.bad)

    first = [("bad", 4), *[("one", i) for i in range(6)], ("two", 0)]
    assert drain() == first
    assert json.loads((tmp_path / "cursors" / "c.json").read_text()) == {"bad": 5, "one": 4, "two": 2}
    every = sorted([*first, *[("one", i) for i in range(6, 12)]])
    assert drain() == every
    put(root / "two" / "tile" / "data" / "000", record() * 256)  # the whole tile comes later
    assert drain() == sorted([*every, ("two", 0)]) and drain() == sorted([*every, ("two", 0)])
    last = [r.cursor for r in spark.read.parquet(out).filter("log = 'two'").collect()]
    assert sorted(last) == [0, 2]
    assert [(r.log, r.bad) for r in spark.read.parquet(out).filter("bad").collect()] == [("bad", True)]


def test_batches_and_entries(spark, tmp_path):
    put(tmp_path / "one" / "5.json", page(2))
    put(tmp_path / "two" / "tile" / "data" / "001", record() * 3)
    put(tmp_path / "two" / "tile" / "data" / "002", b"cut")
    put(tmp_path / "three" / "0.json", {"entries": [{"leaf_input": "?"}]})
    d = offsets.landed_logs(spark, str(tmp_path)).cache()
    logs = spark.createDataFrame([("one", "Log one", "Op", "https://one/", None), ("two", "Log two", "Op", None, "https://two/")], "log string, description string, operator string, submission_url string, monitoring_url string")
    got = sorted((r.log_name, r.cert_index, r.source, r.source_ref) for r in offsets.entries(d, logs).collect())
    assert got == [("Log one", i, "direct_ct", f"https://one/:{i}") for i in (5, 6)] + [("Log two", i, "static_ct", f"https://two/:{i}") for i in (256, 257, 258)]
    said = offsets.errors(d, F.lit("direct_ct"))
    assert [r.message.split(": ")[:2] for r in said.collect()] == [["three", "0.json"]]
    # a broken log is a row of the run, and the others' entries stay
    polled = spark.createDataFrame([("direct_ct", 3)], "source string, duration_ms int")
    run = polls.source_runs(polled, offsets.entries(d, logs).filter("source = 'direct_ct'").select("source"), said, F.lit("2026-01-01")).first()
    assert not run.ok and run.scanned_entries == 2 and len(run.errors) == 1
    d.unpersist()
    assert offsets.landed_logs(spark, str(tmp_path / "nothing")).count() == 0


def test_partitions_hold_many_units(spark, tmp_path, monkeypatch):
    """A partition for each of many small files would be a task for each; large tiles
    still go apart, and no unit is lost."""
    of = lambda n, size: [offsets.Unit("l", str(i), i, i + 1, False, 0, size) for i in range(n)]
    for n, size, parts in ((0, 1, 0), (1, 1, 1), (32, 1, 32), (33, 1, 17), (20_000, 1, 100), (64, 20 << 20, 64)):
        got = offsets.dealt(of(n, size))
        assert len(got) == parts and [u.first for p in got for u in p.units] == list(range(n))
    monkeypatch.setattr(offsets, "BATCH_ROWS", 4)
    for i in range(3):
        put(tmp_path / "one" / f"{i * 3}.json", page(3))
    put(tmp_path / "one" / "9.json", b"no page")
    units = offsets.landed(str(tmp_path))["one"]
    made = list(offsets.batches(str(tmp_path), units))
    assert [b.num_rows for b in made] == [4, 4, 2] and [i for b in made for i in b["cert_index"].to_pylist()] == list(range(10))
    assert made[-1]["error"].to_pylist()[0] is None and made[-1]["error"].to_pylist()[1].startswith("9.json: ")
    for i in range(300):
        put(tmp_path / "many" / f"{i}.json", page(1))
    d = offsets.landed_logs(spark, str(tmp_path))
    assert d.rdd.getNumPartitions() <= offsets.PARTS and d.filter("error is null").count() == 309


def test_landed_pages_are_read_back(spark, tmp_path):
    value = json.dumps(page(2))
    pages = spark.range(30).select(F.concat(F.lit("l"), F.col("id") % 3).alias("log"), (F.col("id") * 2).alias("start"), F.lit(value).alias("value"))
    for _ in range(2):  # again: the same files
        offsets.land_pages(pages, str(tmp_path / "in"))
    d = offsets.landed_logs(spark, str(tmp_path / "in"))
    assert sorted((r.log, r.cert_index, r.error) for r in d.collect()) == sorted((f"l{i % 3}", i * 2 + k, None) for i in range(30) for k in range(2))
