import pytest
from pyspark.sql import functions as F

from lurelight import reference, schemas
from lurelight.operators import quality, validate
from lurelight.operators.score import score_certificates, score_hosts
from lurelight.reference import Scheme
from lurelight.sources.decode import as_entries


def as_of_day():
    return F.lit("2026-08-22").cast("timestamp")


@pytest.fixture(scope="module")
def ref():
    return reference.default()


def scored(spark, ref, hosts, as_of=None):
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r.host: r for r in score_hosts(d, ref, as_of_day() if as_of is None else as_of).collect()}


def test_golden_hosts(spark, ref):
    got = scored(spark, ref, [
        "www.dbs.com.sg", "dbs.com.sg", "internet-banking.dbs.com.sg", "dbs-secure-login.example", "cdc-voucher-claim.example", "ordinary-example.com", "dbs.com.sg.evil.xyz", "singpass.gov.sg.auth-portal.cfd",
        "login.dbs.secure-verify.top", "dsb-secure-login-verify.xyz", "cdcv0ucher.xyz", "cdcvouchr.top", "cdcvoucher-claim-portal-2026.xyz", "dbs-cdcvoucher-login-claim-portal-verify.xyz",
    ])
    kinds = {h: [s.type for s in r.signals] for h, r in got.items()}
    for h in ("www.dbs.com.sg", "dbs.com.sg", "internet-banking.dbs.com.sg"):
        assert got[h].suppressed and got[h].score == 0 and kinds[h] == ["allowlist"]
    r = got["dbs-secure-login.example"]
    assert r.score >= 60 and r.severity == "critical" and r.scoring_version == 2 and "dbs" in {s.brand for s in r.signals}
    assert got["cdc-voucher-claim.example"].score >= 45
    assert got["ordinary-example.com"].score == 0 and got["ordinary-example.com"].severity == "none"
    for h in ("dbs.com.sg.evil.xyz", "singpass.gov.sg.auth-portal.cfd"):
        assert got[h].score >= 70 and {"subdomain_brand_squat", "brand_in_path_position"} <= set(kinds[h])
    assert got["login.dbs.secure-verify.top"].score >= 70 and "subdomain_brand_squat" in kinds["login.dbs.secure-verify.top"]
    assert {"brand:fuzzy", "tld:mismatch", "combo_brand_keyword"} <= set(kinds["dsb-secure-login-verify.xyz"])
    for h in ("cdcv0ucher.xyz", "cdcvouchr.top"):
        assert "cdc_vouchers" in {s.scheme for s in got[h].signals}
    assert got["cdcvoucher-claim-portal-2026.xyz"].score >= 70 and kinds["cdcvoucher-claim-portal-2026.xyz"][-1] == "combo_scheme_keyword"
    assert got["dbs-cdcvoucher-login-claim-portal-verify.xyz"].score == 150
    assert [s.points for s in got["dbs-cdcvoucher-login-claim-portal-verify.xyz"].signals if s.type == "kw"] == [10, 10, 5]


def test_published_quality(spark, ref):
    """128 of the 160 phishing hosts reach the alert threshold."""
    made = quality.positives(spark)
    assert made.count() == 160
    hosts = score_hosts(made.withColumnRenamed("domain", "host"), ref, as_of_day())
    m = quality.sweep(hosts.withColumn("positive", F.lit(True))).filter("threshold = 70").first()
    assert (m.tp, m.fn) == (128, 32)


def test_season(spark, ref):
    r = ref.with_(schemes=(Scheme("s", "S", ("voucher",), 1, "", "2026-08-01", "2026-08-31"), Scheme("bad", "B", ("voucher",), 0, "", "soon", "later")))
    inside, outside = (scored(spark, r, ["my-voucher.example"], F.lit(d).cast("timestamp"))["my-voucher.example"] for d in ("2026-08-31", "2026-09-01"))
    assert [s.type for s in inside.signals] == ["scheme", "scheme_seasonal_boost", "scheme"]
    assert [s.type for s in outside.signals] == ["scheme", "scheme"]


def test_certificates(spark, ref):
    rows = [
        (1, ["www.dbs.com.sg", "dbs-secure-login.example", "*.posb-verify.xyz"], "01", "dn", None, "2026-08-01", 1.0e9),
        (2, ["ordinary-example.com"], "02", "dn", None, None, 1.0e9),
        (3, ["posb-login.top"], None, None, "ff", None, 0.0),
        (4, ["posb-login.top"], None, None, None, "2026-08-01", 1.0e9),
        (5, None, None, None, None, None, None),
        (6, ["posb-login.top"], "01", "dn", "aa", None, 2.0e9),
    ]
    d = spark.createDataFrame(rows, "entry_id long, dns_names array<string>, cert_serial string, cert_issuer_dn_sha256 string, cert_fingerprint string, not_before string, seen double")
    e = as_entries(d, {c: F.col(c) for c in d.columns}, ["entry_id"]).toDF(*[f.name for f in schemas.ENTRY], "row")
    got = {r.row: r for r in score_certificates(e, ref, as_of_day()).collect()}
    assert set(got) == {1, 3, 4, 6}
    f = got[1]
    assert f.domains == ["www.dbs.com.sg", "dbs-secure-login.example", "posb-verify.xyz"] and f.san_count == 3
    assert f.registrable == "dbs-secure-login.example" and "www.dbs.com.sg" not in {s.domain for s in f.signals}
    assert f.matched_brands[:1] == ["dbs"] and "posb" in f.matched_brands
    import hashlib

    assert f.id == hashlib.sha256(b"dn|01|dbs-secure-login.example").hexdigest()[:32]
    assert got[3].id == hashlib.sha256(b"ff|posb-login.top").hexdigest()[:32]
    assert got[4].id == hashlib.sha256(b"posb-login.top|posb-login.top||2026-08-01").hexdigest()[:32]


def test_certificates_in_four_exchanges(spark, ref, tmp_path):
    """Repeated certificates give equal findings, each with its own columns."""
    names = [["posb-login.top", "dbs-secure-login.example"], ["ordinary-example.com"], ["dbs-secure-login.example"], None, []]
    d = spark.createDataFrame([(i, names[i % 5]) for i in range(50)], "i long, dns_names array<string>")
    e = as_entries(d, {"entry_id": F.col("i") % 5, "dns_names": F.col("dns_names")}, ["i"]).toDF(*[f.name for f in schemas.ENTRY], "row")
    e.write.parquet(f"{tmp_path}/e")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = score_certificates(spark.read.parquet(f"{tmp_path}/e"), ref, as_of_day())
        got = {r.row: r for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == [i for i in range(50) if i % 5 in (0, 2)]
    assert all(got[i].id == got[i % 5].id and got[i].signals == got[i % 5].signals for i in got)
    assert {s.domain for s in got[0].signals} == set(names[0]) and [s.domain for s in got[0].signals] == sorted((s.domain for s in got[0].signals), key=names[0].index)
    final = plan.split("== Initial Plan ==")[-1]
    assert final.count("Exchange hashpartitioning") == 4 and final.count("FileScan") == 3


def test_international_certificates(spark, ref):
    names = {1: ["ｐｏｓｂ-login.top", "posb-login.top"], 2: ["bücher.posb-login.top"], 3: ["*.bücher.example"]}
    d = spark.createDataFrame(list(names.items()), "entry_id long, dns_names array<string>")
    e = as_entries(d, {c: F.col(c) for c in d.columns}, ["entry_id"]).toDF(*[f.name for f in schemas.ENTRY], "row")
    got = {r.row: r for r in score_certificates(e, ref, as_of_day()).collect()}
    assert set(got) == {1, 2}
    assert got[1].domains == ["posb-login.top"] and got[1].matched_brands == ["posb"]
    assert got[2].domains == ["xn--bcher-kva.posb-login.top"] and got[2].registrable == "posb-login.top"


def test_reference_tables_are_sound(spark, ref):
    assert validate.reference_report(reference.frames(spark, ref)).filter("broken > 0").count() == 0


def test_reference_from_files(spark, tmp_path):
    import json

    docs = {
        "brands": {"brands": [{"id": "a", "display": "A", "category": "c", "tokens": ["alpha"], "max_edit_distance": 1}]},
        "keywords": {"keywords": [{"token": "login", "category": "c", "affix": True}]},
        "schemes": {"schemes": []},
        "allowlist": {"entries": [{"registrable": "alpha.com", "brand": "a", "verified": False}]},
        "scoring": {"version": 9, "thresholds": {"dashboard_min": 1, "digest_min": 2, "alert_min": 3}, "weights": {"kw": 4}, "caps": {"total": 7}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    r = reference.load(spark, **{name: str(tmp_path / f"{name}.json") for name in docs})
    assert r.scoring.version == 9 and r.scoring.weights["kw"] == 4 and r.scoring.weights["brand:exact"] == 35 and r.verified() == []
    assert scored(spark, r, ["alpha.com"])["alpha.com"].score == 7


def test_broken_tables_are_told(spark, ref):
    from lurelight.reference import Allowed, Brand, Keyword, Scoring

    bad = ref.with_(
        brands=(*ref.brands, Brand("dbs", "D", "bank", ("Bad Token", "dbs"), 3, known_tlds=("x1",)), Brand("other", "O", "bank", ("posb",))),
        keywords=(*ref.keywords, Keyword("login", "credential")),
        allowlist=(*ref.allowlist, Allowed("nodots", "nobody")),
        scoring=Scoring(medium=60, high=50, cap=10, weights={**ref.scoring.weights, "kw": -1}),
    )
    broken = {r.expectation for r in validate.reference_report(reference.frames(spark, bad)).filter("broken > 0").collect()}
    assert broken >= {"brand_ids_unique", "brand_tokens", "brand_tokens_own", "brand_distance", "brand_tlds", "keywords_unique", "allowlist_registrable", "allowlist_brand", "weights_not_negative", "thresholds_ordered", "cap_above_top_three"}


def test_unread_signals_are_not_sent(spark):
    """What nobody reads of a hit stays out of the exchange by certificates."""
    from lurelight.plans import neutral  # names of the driver's tables

    d = spark.createDataFrame([(1, ["widget.promo.com", "old.sg"])], "n int, names array<string>")
    found = score_certificates(as_entries(d, {"dns_names": F.col("names"), "source": F.lit("direct_ct")}, ["n"]), neutral.REFERENCE, as_of_day())
    plan = found.select("n", "matched_brands")._jdf.queryExecution().optimizedPlan().toString()
    sets = [line for line in plan.splitlines() if "collect_set(" in line]
    assert len(sets) == 1 and "signals" not in sets[0] and "schemes" not in sets[0] and "brands" in sets[0]
    r = found.first()
    assert r.matched_brands == list(dict.fromkeys(s.brand for s in r.signals if s.brand)) and {s.domain for s in r.signals} <= {"widget.promo.com", "old.sg"} and r.signals
