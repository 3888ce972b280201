import hashlib
import json
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lurelight import reference, schemas
from lurelight.operators import findings, health, logs, places, quality
from lurelight.sources import certificates, decode
from lurelight.streaming import jobs


def now():
    return F.lit("2026-08-22 12:00:00").cast("timestamp")


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def der(cn, names, serial=b"\x05"):
    name = lambda v: tlv(0x30, tlv(0x31, tlv(0x30, tlv(0x06, b"\x55\x04\x03"), tlv(0x0C, v.encode()))))
    alt = tlv(0x30, *[tlv(0x82, x.encode()) for x in names])
    ext = tlv(0xA3, tlv(0x30, tlv(0x30, tlv(0x06, b"\x55\x1d\x11"), tlv(0x04, alt))))
    validity = tlv(0x30, tlv(0x17, b"260801000000Z"), tlv(0x17, b"270801000000Z"))
    return tlv(0x30, tlv(0xA0, tlv(2, b"\x02")), tlv(2, serial), tlv(0x30), name("Issuer"), validity, name(cn), tlv(0x30), ext)


def cert(*a, **k):
    return tlv(0x30, der(*a, **k), tlv(0x30), tlv(0x03, b"\0"))


def u(n, k):
    return n.to_bytes(k, "big")


def test_certificate_names():
    c = certificates.certificate(cert("Dbs-Login.example", ["*.a.com", "b.org", "plain"]))
    assert c["dns_names"] == ["a.com", "b.org", "dbs-login.example"] and c["not_before"] == "2026-08-01T00:00:00.000Z" and c["cert_serial"] == "05"
    assert c["issuer_aggregated"] == "CN=Issuer" and c["cert_issuer_dn_sha256"] == hashlib.sha256(b"CN=Issuer").hexdigest()
    assert [certificates.certificate(x) for x in (b"", b"\x30\x05\x01", None)] == [None] * 3


def test_leaves_and_tiles_agree(spark):
    tbs, whole = der("posb-login.top", ["posb-login.top"]), cert("posb-login.top", ["posb-login.top"])
    pre = b"\0\0" + u(1700000000000, 8) + u(1, 2) + b"k" * 32 + u(len(tbs), 3) + tbs
    plain = b"\0\0" + u(1700000000000, 8) + u(0, 2) + u(len(whole), 3) + whole
    rows = [(plain, 1), (pre, 2), (plain[:-1], 3), (b"", 4), (None, 5)]
    d = spark.createDataFrame(rows, "leaf_input binary, cert_index long").withColumns({c: F.lit(c) for c in ("description", "operator", "submission_url", "monitoring_url")})
    got = {r.cert_index: r for r in decode.log_leaves(d).collect()}
    assert set(got) == {1, 2} and got[1].dns_names == ["posb-login.top"] and got[2].entry_types == ["precert"] and got[1].seen == 1.7e9
    record0 = u(1, 8) + u(0, 2) + u(len(whole), 3) + whole + u(0, 2) + u(0, 2)
    record1 = u(2, 8) + u(1, 2) + b"k" * 32 + u(len(tbs), 3) + tbs + u(2, 2) + b"xx" + u(len(whole), 3) + whole + u(1, 2) + b"c"
    bad = u(3, 8) + u(0, 2) + u(2, 3) + b"zz" + u(0, 2) + u(0, 2)
    tile = record0 + record1 + bad + record0 + u(4, 8) + u(9, 2) + record0
    t = spark.createDataFrame([(tile, 512, 513), (b"", 0, 0), (None, 0, 0)], "tile binary, base_index long, cursor long").withColumns({c: F.lit(c) for c in ("description", "operator", "submission_url", "monitoring_url")})
    got = sorted((r.cert_index, r.entry_types[0]) for r in decode.log_tiles(t).collect())
    assert got == [(513, "precert"), (515, "x509")]
    # a precertificate and its final certificate are one finding
    ref = reference.default()
    from lurelight.operators.score import score_certificates

    ids = {r.id for r in score_certificates(decode.union_sources(decode.log_leaves(d), decode.log_tiles(t)), ref, now()).collect()}
    assert len(ids) == 1


def test_stream_messages_and_search_rows(spark):
    full = {"message_type": "certificate_update", "data": {"cert_index": 7, "seen": 1.7e9, "leaf_cert": {"subject": {"CN": "a.com"}, "issuer": {"aggregated": "/CN=I"}, "not_before": 1700000000, "fingerprint": "F", "all_domains": ["*.a.com", "A.com.", "b"]}}}
    values = [json.dumps(full), json.dumps({"message_type": "dns_entries", "data": ["c.com", "x"]}), json.dumps({"message_type": "heartbeat"}), "not json", json.dumps({"message_type": "dns_entries", "data": ["x"]})]
    got = decode.stream_messages(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert sorted(r.common_name for r in got) == ["a.com", "c.com"]
    a = next(r for r in got if r.common_name == "a.com")
    assert a.not_before == "2023-11-14T22:13:20.000Z" and a.cert_fingerprint == "F" and a.cert_index == 7
    rows = spark.createDataFrame([(9, "*.A.com\nb.org\na.com", None, "I", "2026-08-20T00:00:00", "2026-08-01T00:00:00", "", None), (10, "x", None, None, None, None, None, None)], schemas.SEARCH_ROW)
    r = decode.search_rows(rows).collect()
    assert len(r) == 1 and r[0].dns_names == ["a.com", "b.org"] and r[0].is_wildcard and r[0].cert_serial == "9"


def test_log_lists(spark):
    op = {"operators": [{"name": "Op", "logs": [{"log_id": "1", "key": "", "description": "d", "url": "https://a", "state": {"usable": {"timestamp": "t"}}}], "tiled_logs": [{"log_id": "2", "submission_url": "https://s", "monitoring_url": "https://m/", "state": {"retired": {"timestamp": "t"}}}]}]}
    a = logs.parse_list_a(spark.read.schema(logs.LIST_A).json(spark.sparkContext.parallelize([json.dumps(op)])), now())
    got = {r.log_id: r for r in a.collect()}
    assert got["1"].submission_url == "https://a/" and got["1"].protocol == "rfc6962" and got["2"].state == "retired" and got["2"].monitoring_url == "https://m/"
    b = logs.parse_list_b(spark.createDataFrame([("2", "", None, "x", None, "https://z", None, None, None, None, None), ("", "", None, "x", None, None, None, None, None, None, None)], logs.LIST_B), now())
    m = {r.log_id: r for r in logs.merge_lists(b, a).collect()}
    assert set(m) == {"1", "2"} and m["2"].protocol == "static-ct-api" and m["2"].monitoring_url == "https://m/" and m["2"].operator == "Op" and m["2"].submission_url == "https://z/"
    assert {r.log_id for r in logs.selected(logs.merge_lists(b, a), now()).collect()} == {"1", "2"}
    r = spark.range(1).select(logs.fetch_range(F.lit(None).cast("long"), F.lit(1000)).alias("a"), logs.fetch_range(F.lit(5000), F.lit(1000)).alias("b"), logs.tile_range(F.lit(100), F.lit(600)).alias("t")).first()
    assert (r.a.start, r.a.end) == (744, 791) and (r.b.start, r.b.end) == (1000, 999) and (r.t.first, r.t.last, r.t.cursor, r.t.lag) == (0, 2, 600, 0)


def test_statuses(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    none = F.array().cast("array<string>")
    cases = [
        (health.status(none, at("2026-08-22 11:59:00"), F.lit(50), now()), "ok"),
        (health.status(none, at("2026-08-22 11:59:00"), F.lit(150_000), now()), "degraded"),
        (health.status(none, at("2026-08-22 11:30:00"), F.lit(0), now()), "stale"),
        (health.status(F.array(F.lit("circuit open")), at("2026-08-22 11:59:00"), F.lit(0), now()), "failed"),
        (health.status(F.array(F.lit("timeout")), F.lit(None).cast("timestamp"), F.lit(0), now()), "degraded"),
    ]
    assert list(spark.range(1).select(*[c for c, _ in cases]).first()) == [want for _, want in cases]
    runs = spark.createDataFrame([("certstream", datetime(2026, 8, 22, 11, 59), [("invalid",)])], "source string, checked_at timestamp, errors array<struct<message:string>>")
    got = {r.source: r.status for r in health.run_health(runs, now()).collect()}
    assert got == {"certstream": "failed", "crtsh": "ok"}
    assert health.overall(health.run_health(runs, now())).first()[0] == "degraded"


def test_limits_and_empty_inputs(spark):
    assert [findings.clamp_limit(x, 50) for x in (None, "x", 0, "7", 500, -3)] == [50, 50, 50, 7, 100, 1]
    runs = spark.createDataFrame([], schemas.SOURCE_RUN)
    assert findings.poll_status(runs).first().health == "healthy"
    items = spark.createDataFrame([], "score int, suppressed boolean, positive boolean, lang string")
    assert [r.f1 for r in quality.sweep(items).collect()] == [0.0] * 7 and quality.by_group(items, "lang").count() == 0


def test_merges_into_keyed_tables(spark, tmp_path):
    t = findings.KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, v string").schema, ["k"])
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string"))
    t.merge(spark.createDataFrame([(3, "b"), (99, "c")], "k long, v string"))
    t.merge(spark.createDataFrame([], "k long, v string"))
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 21 and got[3] == "b" and got[99] == "c" and got[4] == "a"


def keyed(spark, path, **options):
    batch = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    return findings.KeyedTable(spark, str(path), batch().schema, ["k"], **options), batch, lambda d: {r.k: r.v for r in d.collect()}


def broken(spark, batch):
    """Rows whose job fails inside a task."""
    return batch((1, "x"), (2, "x")).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost executor"))).otherwise(F.col("v")))


def test_keyed_tables_survive_breaks_and_replays(spark, tmp_path):
    t, batch, rows = keyed(spark, tmp_path / "t", grace=0)
    t.merge(batch((1, "a"), (2, "a")), "one")
    with pytest.raises(Exception, match="lost executor"):
        t.merge(broken(spark, batch), "new")  # a new batch that breaks
    assert rows(t.read()) == {1: "a", 2: "a"}
    t.merge(batch((2, "b")), "two")
    t.merge(batch((1, "a"), (2, "a")), "one")  # a replay takes its old place
    t.merge(broken(spark, batch), "one")  # and none of it runs
    assert rows(t.read()) == {1: "a", 2: "b"}
    # a writer that stopped before its batch was complete
    (tmp_path / "t" / "batch=000000000003-three-0" / "_temporary").mkdir(parents=True)
    assert rows(t.read()) == {1: "a", 2: "b"}
    t.merge(batch((2, "c")), "three")
    want = {1: "a", 2: "c"}
    assert rows(t.read()) == want
    # a compaction that stopped before the old batches went, and one that went through
    copies = tmp_path / "copy"
    shutil.copytree(tmp_path / "t", copies)
    t.compact()
    assert rows(t.read()) == want
    shutil.copytree(copies, tmp_path / "t", dirs_exist_ok=True)
    assert rows(t.read()) == want
    t.merge(batch((1, "d")), "four")
    assert rows(t.read()) == {1: "d", 2: "c"}


def test_replays_after_compactions(spark, tmp_path):
    t, batch, rows = keyed(spark, tmp_path / "t", grace=0)
    t.merge(batch((1, "old")), "old")
    t.merge(batch((1, "new")), "new")
    t.compact()
    t.clean()
    assert not list((tmp_path / "t").glob("batch=*"))
    t.merge(batch((1, "old")), "old")  # its name went into the base
    assert rows(t.read()) == {1: "new"}
    t.merge(batch((2, "more")), "more")
    t.compact()
    for name in ("old", "new", "more"):
        t.merge(batch((1, "again")), name)
    assert rows(t.read()) == {1: "new", 2: "more"} and t.read().select("v").columns == ["v"]
    t.compact()  # nothing behind the base
    assert rows(t.read()) == {1: "new", 2: "more"}
    assert rows(t.get(k=2)) == {2: "more"} and rows(t.get(k=9)) == {}


def test_compactions_that_break(spark, tmp_path, monkeypatch):
    t, batch, rows = keyed(spark, tmp_path / "t")
    t.merge(batch((1, "a"), (2, "a")))
    t.merge(batch((2, "b")))
    whole = t._rows
    monkeypatch.setattr(t, "_rows", lambda *a: whole(*a).withColumn("v", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        t.compact()
    monkeypatch.setattr(t, "_rows", whole)
    assert rows(t.read()) == {1: "a", 2: "b"}
    t.compact()
    assert rows(t.read()) == {1: "a", 2: "b"} and t._base() is not None


def test_readers_across_compactions(spark, tmp_path):
    t, batch, rows = keyed(spark, tmp_path / "t", most=3, grace=3600)
    t.merge(batch((1, "a"), (2, "a")))
    t.merge(batch((2, "b")))
    before = t.read()  # lists two batches
    t.merge(batch((3, "c")))  # the third compacts by itself
    assert t._base() is not None and t._behind(t._base()) == []
    t.compact()
    assert rows(before) == {1: "a", 2: "b"}
    assert rows(t.read()) == {1: "a", 2: "b", 3: "c"}
    between = t.read()  # reads the base
    for n in range(3):
        t.merge(batch((n, "d")))
    assert rows(between) == {1: "a", 2: "b", 3: "c"} and rows(t.read()) == {0: "d", 1: "d", 2: "d", 3: "c"}
    t.grace = 0
    t.clean()
    assert len(list((tmp_path / "t").glob("b*"))) == 1 and rows(t.read()) == {0: "d", 1: "d", 2: "d", 3: "c"}


def test_appended_batches(spark, tmp_path):
    t = findings.Batches(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long").schema)
    assert t.read().count() == 0
    assert t.add(spark.range(3).withColumnRenamed("id", "k"), "a") and not t.add(spark.range(9).withColumnRenamed("id", "k"), "a")
    assert t.add(spark.range(2).withColumnRenamed("id", "k")) and t.read().count() == 5


def test_stream_to_findings(spark, tmp_path):
    ref = reference.default()
    rows = spark.createDataFrame([(i, [h], "01", "dn", 1.0e9 + i, s) for i, (h, s) in enumerate([("posb-login.top", "crtsh"), ("posb-login.top", "certstream"), ("ordinary.example", "crtsh")])], "entry_id long, dns_names array<string>, cert_serial string, cert_issuer_dn_sha256 string, seen double, source string")
    e = decode.as_entries(rows, {c: F.col(c) for c in rows.columns})
    e.write.parquet(str(tmp_path / "in"))
    f = findings.KeyedTable(spark, str(tmp_path / "f"), schemas.FINDING, ["id"])
    s = findings.KeyedTable(spark, str(tmp_path / "s"), schemas.FINDING_SOURCE, ["finding_id", "source", "source_ref"])
    for _ in range(2):  # the second run finds nothing new
        jobs.run_findings(spark.readStream.schema(schemas.ENTRY).parquet(str(tmp_path / "in")), ref, f, s, str(tmp_path / "check"), now(), once=True).awaitTermination()
    got = f.read().collect()
    assert len(got) == 1 and got[0].source.name == "certstream" and got[0].observed_at == datetime(2001, 9, 9, 1, 46, 40)
    assert sorted(r.source for r in s.read().collect()) == ["certstream", "crtsh"]


def test_breaker_stream(spark, tmp_path):
    runs = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, i), ok) for i, ok in enumerate([False, False, False, True, False])], "source string, checked_at timestamp, ok boolean")
    runs.orderBy(F.hash("checked_at")).repartition(3).write.parquet(str(tmp_path / "r"))  # in any order
    q = jobs.breaker_states(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.failures, r.open) for r in spark.table("breaker").orderBy("checked_at").collect()] == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_breakers_count_by_time_and_leave_late_runs(spark, tmp_path):
    schema, path, check = "source string, checked_at timestamp, ok boolean", str(tmp_path / "r"), str(tmp_path / "c")
    put = lambda *r: spark.createDataFrame([("a", datetime(2026, 1, 1, 0, m), ok) for m, ok in r], schema).write.mode("append").parquet(path)

    def drain():
        s = jobs.breaker_states(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", check).trigger(availableNow=True).start()
        s.awaitTermination()
        return [(r.checked_at.minute, r.failures, r.open) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("checked_at").collect()]

    put((3, False), (1, True), (2, False), (10, False))
    assert drain() == [(1, 0, False), (2, 1, False), (3, 2, False), (10, 3, True)]
    put((5, True), (12, False), (11, True))  # the run of minute 5 is late
    assert drain() == [(1, 0, False), (2, 1, False), (3, 2, False), (10, 3, True), (11, 0, False), (12, 1, False)]


def test_merged_lists_keep_their_order(spark):
    log = lambda i, place, **k: {"log_id": i, "place": place, "operator": "Op", "description": str(place), "protocol": "rfc6962", "monitoring_url": "m"} | k
    frame = lambda *rows: spark.createDataFrame(list(rows), "log_id string, place long, operator string, description string, protocol string, monitoring_url string")
    a = frame(log("1", 9), log("1", 10), log("2", 1, operator=logs.MANY), log("", 2))
    b = frame(
        log("2", 3, protocol="static-ct-api", monitoring_url="x"), log("2", 2, operator="B"), log("2", 4, protocol="static-ct-api", monitoring_url="y", operator="C"),
        log("3", 8, operator=logs.MANY), log("3", 9, operator="D", description="later"), log("3", 7, operator=logs.MANY, description="first"),
    )
    got = {r.log_id: tuple(r)[1:] for r in logs.merge_lists(a.repartition(3), b.repartition(3)).select("log_id", "operator", "description", "protocol", "monitoring_url").collect()}
    assert got == {"1": ("Op", "10", "rfc6962", "m"), "2": ("B", "1", "static-ct-api", "y"), "3": ("D", "first", "rfc6962", "m")}


def test_rotation(spark):
    d = spark.createDataFrame([(f"t{i}",) for i in range(7)], "token string")
    for start, batch in ((0, 3), (5, 4), (20, 2), (3, 9), (6, 1)):
        got = [(r.token, r.place, r.next_index) for r in logs.round_robin(d, ["token"], start, batch).collect()]
        assert sorted(got) == sorted((f"t{i}", i, (start + batch) % 7) for i in {(start + k) % 7 for k in range(batch)})
    assert logs.round_robin(d.filter("false"), ["token"], 3, 2).count() == 0


def test_places_by_ranges(spark):
    d = spark.createDataFrame([(f"t{i % 40:02d}", i) for i in range(200)], "token string, i int").repartition(5)
    every = places.Ordered(d, ["token", "i"], size=17)
    want = [tuple(r) for r in d.orderBy("token", "i").collect()]
    assert len(every.starts) > 5
    got = {r.place: (r.token, r.i) for r in every.numbered().collect()}
    assert [got[i] for i in range(200)] == want
    some = sorted((r.place, r.i) for r in every.numbered(30, 95).collect())
    assert some == [(i, want[i][1]) for i in range(30, 95)] and every.numbered(5, 5).count() == 0
    assert places.Ordered(d.limit(0), ["token"]).numbered().count() == 0


def test_logs_in_the_readers_order(spark):
    names = ["Banana", "apple", "Zed", "éclair", "a-b", "ab"]
    rows = [(str(i), "", n, "d", None, f"https://{i}", None, None, None, None, None) for i, n in enumerate(names)]
    d = logs.legacy_logs(logs.parse_list_b(spark.createDataFrame(rows, logs.LIST_B), now()), now())
    assert [(r.operator, r.place) for r in d.collect()] == [(n, i) for i, n in enumerate(["a-b", "ab", "apple", "Banana", "éclair", "Zed"])]


def test_sessions_and_bounded_dedup(spark):
    rows = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, m)) for m in (0, 3, 20)], "source string, at timestamp")
    assert sorted(r.entries for r in jobs.sessions(rows, "at", "5 minutes", "source").collect()) == [1, 2]
    assert jobs.issuance(rows, "at", "10 minutes", "source", slide="5 minutes").agg(F.sum("entries")).first()[0] == 6


def test_findings_against_a_plain_union(spark, tmp_path):
    import random

    rng, kinds = random.Random(5), ["x509", "precert", None]
    rows = []
    for i in range(400):
        pick = lambda most, of: None if rng.random() < 0.1 else [rng.choice(of) for _ in range(rng.randrange(most))]
        doms = pick(6, ["a.com", "b.com", "c.com", "d.com", "e.com", None])
        rows.append((rng.choice(["x", "y", "z", *map(str, range(60))]), datetime(2026, 8, 1 + rng.randrange(28)), rng.randrange(100), pick(3, kinds), doms, rng.choice([None, 0, 7]), rng.choice([None, "", f"s{i}"]), rng.choice([None, f"d{i}"]), i))
    rng.shuffle(rows)
    ddl = "id string, observed_at timestamp, score int, entry_types array<string>, domains array<string>, san_count int, cert_serial string, cert_issuer_dn_sha256 string, arrival long"
    spark.createDataFrame(rows, ddl).repartition(5).write.parquet(f"{tmp_path}/f")
    d = findings.unique_findings(spark.read.parquet(f"{tmp_path}/f"))
    assert d.columns == [c.split()[0] for c in ddl.split(", ")][:-1]
    want = {}
    for r in sorted(rows, key=lambda r: r[-1]):
        want.setdefault(r[0], []).append(r)
    got = {r.id: r for r in d.collect()}
    assert set(got) == set(want)
    for id_, rs in want.items():
        union = lambda k: list(dict.fromkeys(v for r in rs for v in r[k] or []))  # noqa: B023, E731
        first = lambda k: next((r[k] for r in rs if r[k]), None)  # noqa: B023, E731
        g = got[id_]
        assert (g.entry_types, g.domains, g.score, g.observed_at) == (union(3), union(4), rs[0][2], min(r[1] for r in rs))
        assert (g.cert_serial, g.cert_issuer_dn_sha256, g.san_count) == (first(6), first(7), len(union(4)) if len(rs) > 1 else rs[0][5])
