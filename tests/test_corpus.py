import pytest
from pyspark.sql import functions as F

from lurelight import schemas
from lurelight.operators import quality, validate
from lurelight.reference import default, frames
from lurelight.sources import corpus


def items(spark):
    every = quality.corpus(quality.positives(spark).withColumns({"expected": F.lit("malicious"), "label": F.lit("positive")}), quality.adversarial(spark), quality.trusted_negatives(spark), quality.constructed(spark))
    d = every.withColumn("id", F.concat_ws("-", F.lit("i"), "domain"))
    return d.select(*[(F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CORPUS])


def test_round_trip(spark, tmp_path):
    d = items(spark)
    corpus.write(d, str(tmp_path / "c"), files=2)
    back = corpus.read(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.drop("part").collect())) == sorted(map(str, d.collect()))
    assert {r.part: r["count"] for r in back.groupBy("part").count().collect()} == {"positives": 160, "adversarial": 60, "negatives": 43, "constructed": 21}
    # damage is found, and the strict reader stops at it
    (tmp_path / "c" / "part=negatives" / "more.json").write_text('{"id": "x", "dom\n{"id": "y"}\n{"id": "z", "domain": "z.sg", "expected": "maybe"}\n{"id": "q", "domain": "q.sg", "expected": "benign", "label": "positive"}\n{"id": "n", "domain": "n.sg"}\n')
    (tmp_path / "c" / "part=others").mkdir()
    (tmp_path / "c" / "part=others" / "o.json").write_text('{"id": "o", "domain": "o.sg", "expected": "benign"}\n')
    said = corpus.lines(spark, str(tmp_path / "c")).filter("broken is not null")
    assert sorted((r.id or "", r.broken) for r in said.collect()) == [("", "json"), ("n", "label"), ("o", "part"), ("q", "contradiction"), ("y", "domain"), ("z", "label")]
    with pytest.raises(Exception, match="broken line"):
        corpus.read(spark, str(tmp_path / "c")).count()


def test_changes(spark):
    before = spark.createDataFrame([(1, 5, None), (2, 6, True), (3, 7, True), (4, None, None)], "id int, score int, hit boolean")
    after = spark.createDataFrame([(1, 5, False), (2, 6, True), (4, None, None), (5, 1, True)], "id int, score int, hit boolean")
    got = {r.id: (r.change, r.columns) for r in corpus.changes(before, after, ["id"], ["score", "hit"]).collect()}
    assert got == {1: ("changed", ["hit"]), 3: ("removed", []), 5: ("added", [])}


def test_negatives(spark):
    d = quality.trusted_negatives(spark)
    assert {r.category: r["count"] for r in d.groupBy("category").count().collect()} == {"tranco_sg": 31, "legitimate_government": 12}
    a = quality.allowlist_negatives(frames(spark, default())["allowlist"])
    assert a.columns == d.columns and a.select("category", "expected").distinct().collect() == [("allowlisted", "benign")] and a.count() == len(default().allowlist)


def test_rollup(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 3)], "k string, m string, v int")
    out = quality.rollup(d, ["k", "m"], total=F.sum("v"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    got = {(r.level, r.k, r.m): (r["items"], r.total) for r in out.collect()}
    assert got[0, "a", None] == (1, 1) and got[1, "a", None] == (2, 3) and got[2, None, "x"] == (2, 5) and got[2, None, None] == (1, 1) and got[3, None, None] == (3, 6) and len(got) == 8
    assert {(r.level, r["items"]) for r in quality.rollup(d, ["k"]).collect()} == {(0, 2), (0, 1), (1, 3)}


def test_metadata(spark):
    rows = [(1, True, "2026-08-14", "https://a"), (2, True, "", "https://a"), (3, True, "2026-08-14", "http://a"), (4, False, None, None), (5, None, None, None), (6, True, None, None)]
    d = spark.createDataFrame(rows, "i int, verified boolean, verified_at string, source string")
    assert sorted(r.i for r in validate.unverified_metadata(d).collect()) == [2, 3, 6]


def test_hand_made_parts_and_built_in_tables(spark):
    """Items by category as published, and no broken expectation of the built-in tables."""
    count = lambda d: {r.category: r["count"] for r in d.groupBy("category").count().collect()}
    assert count(quality.positives(spark)) == {"credential_phish": 105, "subdomain_squat": 35, "scheme_phish": 20}
    assert sum(count(quality.adversarial(spark)).values()) == 60 and sum(count(quality.constructed(spark)).values()) == 21
    assert validate.reference_report(frames(spark, default())).filter("broken > 0").count() == 0
    first = [r.domain for r in quality.positives(spark).filter("brand = 'dbs' and category <> 'scheme_phish'").collect()]
    assert first[0] == "dbs-login-verify.cfd" and "dbs.com.sg.verify-login-portal-1.xyz" in first
