"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lurelight.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).lower()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(names).collect())
    if name in catalog.ORACLES:
        want = db.execute(entry.oracle_sql()[name])
        at = [d[0] for d in want.description]
        assert sorted(at) == names
        assert rows == sorted(tuple(plain(r[at.index(n)]) for n in names) for r in want.fetchall())


@pytest.mark.parametrize("name", ["stream_dedup", "stream_entries_scored", "stream_windowed_issuance"])
def test_streams_are_written_to_the_shared_folder(spark, sf, name):
    d = entry.queries()[name](spark, sf)
    shared, files = spark.conf.get("spark.checkpoint.dir"), d.inputFiles()
    assert d.count() and files and all(shared in f and "/drained-" in f for f in files)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scoring_does_not_shuffle(spark, sf):
    from pyspark.sql import functions as F

    from lurelight.operators.score import score_hosts
    from lurelight.plans import neutral

    d = score_hosts(neutral.part_hosts(catalog.read(spark, sf, "part")), neutral.REFERENCE, F.current_timestamp())
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_certificates_are_sent_once(spark, tmp_path):
    """The top hosts of orders with repeated, tied, suppressed and scoreless names;
    nothing sorts or groups the orders' rows before they are sent."""
    from pyspark.sql import functions as F

    from lurelight.operators.score import score_hosts
    from lurelight.plans import neutral

    parts = [(1, "widget red", "PROMO", 0), (2, "widget red", "PROMO", 5), (3, "new promo", "X", 0), (4, "hot promo", "X", 0), (5, "a standard", "SG", 0), (6, "plain", "Y", 1), (7, "red", "STANDARD", 2)]
    lines = [(1, 1), (1, 2), (1, 6), (1, 6), (2, 3), (2, 4), (2, 4), (3, 6), (4, 7), (4, 6), (5, 7), (6, 99), (7, None), *[(8, p) for p in (7, 3, 1, 4, 2)]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    hosts = {r.id: r.host for r in catalog.part_hosts(spark, tmp_path).collect()}
    scores = {r.host: r for r in score_hosts(spark.createDataFrame([(h,) for h in set(hosts.values())], "host string"), neutral.REFERENCE, catalog.season()).collect()}
    assert any(s.suppressed for s in scores.values()) and any(not s.suppressed and s.score == 0 for s in scores.values())
    assert scores[hosts[3]].score == scores[hosts[4]].score > 0
    want = set()
    for order in {o for o, _ in lines}:
        names = {hosts[p] for o, p in lines if o == order and p in hosts}
        live = [scores[n] for n in names if not scores[n].suppressed and scores[n].score > 0]
        if live:
            top = min(live, key=lambda s: (-s.score, s.host))
            want.add((order, top.host, top.registrable, top.score, top.severity, len(names)))
    got = catalog.QUERIES["certificate_top_host"](spark, str(tmp_path)).select("l_orderkey", "host", "registrable", "score", "severity", "names")
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) >= 3 and dict(got.dtypes)["names"] == "bigint"
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above, below = plan.split("REPARTITION_BY_COL")
    assert "Aggregate" not in above and "l_orderkey" in above and "SortAggregate" not in below and "collect_set" not in below and "SortMergeJoin [l_partkey" not in below


def test_names_are_not_grouped_before_they_are_sent(spark, sf):
    """Certificates are made of rows that were sent as they came, once for all that read them."""
    d = catalog._certificates(spark, sf)
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    above, below = plan.split("REPARTITION_BY_COL")
    assert "collect_set" in above and "Aggregate" not in below
    assert {r.entry_id: tuple(r.dns_names) for r in d.collect()} == {r.o: tuple(sorted(r.n)) for r in spark.sql(f"SELECT l_orderkey o, collect_set(host) n FROM parquet.`{sf}/lineitem.parquet` JOIN {{p}} ON l_partkey = id GROUP BY 1", p=catalog.part_hosts(spark, sf)).collect()}
