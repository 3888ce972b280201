from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lurelight import reference, schemas
from lurelight.operators import findings, polls, quality
from lurelight.sources import decode


def at():
    return F.lit("2026-08-22 12:00:00").cast("timestamp")


def test_poll(spark, tmp_path):
    ref = reference.default()
    rows = [(1, ["posb-login.top"], "01", "dn", 1.0e9, "crtsh"), (2, ["posb-login.top", "dbs.com.sg"], "01", "dn", 2.0e9, "direct_ct"), (3, ["fine.example"], "02", "dn", 1.0e9, "direct_ct")]
    e = spark.createDataFrame(rows, "entry_id long, dns_names array<string>, cert_serial string, cert_issuer_dn_sha256 string, seen double, source string")
    e = decode.as_entries(e, {c: F.col(c) for c in e.columns})
    polled = spark.createDataFrame([("certstream", 5), ("direct_ct", 6), ("static_ct", 7), ("crtsh", 8)], "source string, duration_ms int")
    errors = spark.createDataFrame([("static_ct", "tile missing")], "source string, message string")
    runs = polls.source_runs(polled, e.select("source"), errors, at())
    t = {n: findings.KeyedTable(spark, str(tmp_path / n), s, k) for n, s, k in (("findings", schemas.FINDING, ["id"]), ("sources", schemas.FINDING_SOURCE, ["finding_id", "source", "source_ref"]), ("state", schemas.STATE, ["key"]))}
    status = polls.poll(e, runs, ref, at(), t, str(tmp_path / "runs")).first()
    assert (status.ok, status.health, status.scanned_entries, status.sources, status.errors) == (True, "partial", 3, 4, 1)
    f = t["findings"].read().collect()
    assert len(f) == 1 and f[0].source.name == "direct_ct" and f[0].domains == ["posb-login.top", "dbs.com.sg"] and f[0].san_count == 2 and f[0].observed_at == datetime(2001, 9, 9, 1, 46, 40)
    assert sorted(r.source for r in t["sources"].read().collect()) == ["crtsh", "direct_ct"]
    assert "partial" in t["state"].read().filter("key = 'ct_poll_status'").first().value
    done = {r.source: r for r in spark.read.schema(schemas.SOURCE_RUN).parquet(str(tmp_path / "runs")).collect()}
    assert (done["direct_ct"].matched, done["direct_ct"].persisted, done["direct_ct"].scanned_entries) == (1, 1, 2)
    # the same poll again changes nothing, and its status needs no scoring
    again = polls.poll(e, runs, ref, at(), t, str(tmp_path / "twice"), "p1")
    polls.poll(e, runs, ref, at(), t, str(tmp_path / "twice"), "p1")
    assert findings.Batches(spark, str(tmp_path / "twice"), schemas.SOURCE_RUN).read().count() == 4
    assert "LocalTableScan" in again._jdf.queryExecution().executedPlan().toString() or "Scan ExistingRDD" in again._jdf.queryExecution().executedPlan().toString()
    assert not done["static_ct"].ok and done["certstream"].details == '{"state":"standby"}' and done["certstream"].label == "CertStream"


def test_mining_and_logs(spark):
    ref = reference.default()
    hosts = spark.createDataFrame([(1, "a.secure-parcel.example"), (2, "posb-login.top"), (3, "b.secure-parcel.example"), (4, "dbs.com.sg"), (5, "com.sg")], "ord long, host string")
    got = polls.mine(hosts, ref, at(), 20, 70).collect()
    assert [(r.registrable, r.host, r.score) for r in got] == [("secure-parcel.example", "a.secure-parcel.example", 20)]
    r = spark.range(1).select(polls.tail_tiles(F.lit(1030), 2).alias("a"), polls.tail_tiles(F.lit(100)).alias("b")).first()
    assert r.a == [2, 3] and r.b == []
    logs = spark.createDataFrame([("x", "Beta Log 2026"), ("y", "Alpha Log 2026")], "log_id string, description string")
    assert polls.find_log(logs, "log 2026").first().log_id == "y"
    with pytest.raises(Exception, match="no log like"):
        polls.find_log(logs, "gamma").collect()


def test_evaluation(spark):
    ref = reference.default()
    positive = quality.positives(spark).withColumns({"expected": F.lit("malicious"), "label": F.lit("positive")})
    negative = spark.createDataFrame([(a.registrable, a.brand, "benign", "negative") for a in ref.allowlist], "domain string, brand string, expected string, label string")
    got = polls.evaluate(quality.corpus(positive, quality.adversarial(spark), negative, quality.constructed(spark)), ref, at())
    m = got["sweep"].filter("threshold = 70").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (128, 0, len(ref.allowlist), 32) and m.precision == 1.0
    p = got["passes"].first()
    assert tuple(p) == (60, 26, 21, 14)  # caught, and left alone, as published
    assert {r.label: r["items"] for r in got["composition"].filter("not adversarial and not constructed").collect()} == {"positive": 160, "negative": len(ref.allowlist)}
    assert quality.gate(got["sweep"].filter("threshold = 70"), 0.88, F.lit(0)).first().passed


def test_status_page(spark):
    logs = spark.createDataFrame([("1", "Op", "d", "rfc6962", "https://a/", "https://a/", "", "usable", None, None, datetime(2026, 8, 22, 11, 59))], schemas.LOG)
    cursors = spark.createDataFrame([("https://a/", 300_000, 10, datetime(2026, 8, 22, 11, 59), None)], schemas.CURSOR)
    page = polls.status_page(logs, cursors, spark.createDataFrame([], schemas.SOURCE_RUN), at())
    assert {r.source: r.status for r in page["sources"].collect()} == {"1": "degraded", "certstream": "ok", "crtsh": "ok"}
    assert page["overall"].first()[0] == "degraded" and page["protocols"].count() == 3
