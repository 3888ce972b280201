import random

import pytest
from pyspark.sql import functions as F

from lurelight import schemas
from lurelight.functions import idna, suffix
from lurelight.sources import decode


@pytest.mark.parametrize(
    "name, want, own",
    [
        ("faß.de", "xn--fa-hia.de", "faß.de"), ("fass.de", "fass.de", "fass.de"), ("bücher.example", "xn--bcher-kva.example", "bücher.example"), ("BÜCHER。example", "xn--bcher-kva.example", "bücher.example"),
        ("βόλος.com", "xn--nxasmm1c.com", "βόλος.com"), ("xn--nxasmm1c.com", "xn--nxasmm1c.com", "βόλος.com"), ("xn--dbs-hia.com", None, None), ("日本語.jp", "xn--wgv71a119e.jp", "日本語.jp"),
        ("ﬁne.com", "fine.com", "fine.com"), ("so\u00adft.de", "soft.de", "soft.de"), ("ｗｗｗ．a.com", "www.a.com", "www.a.com"), ("u\u0308.de", "xn--tda.de", "ü.de"), ("א.com", "xn--4db.com", "א.com"),
        ("xn--", None, None), ("xn--a.com", None, None), ("xn--fa-hiaü.de", None, None), ("xn--BCHER-KVA.de", "xn--bcher-kva.de", "bücher.de"), ("\u0301a.com", None, None), ("a\u200db.com", None, None), ("\u0915\u094d\u200d\u0937.com", "xn--11b3cwj.com".replace("xn--11b3cwj", "xn--" + "\u0915\u094d\u200d\u0937".encode("punycode").decode()), "\u0915\u094d\u200d\u0937.com"),
        ("1א.com", None, None), ("a.com", None, None), ("ü b.de", None, None), ("ü%.de", None, None),
    ],
)
def test_forms(name, want, own):
    assert idna.to_ascii(name) == want and idna.to_unicode(name) == own


def test_normalised(spark):
    rows = ["*.FAß.de.", "plain.com", "xn--", "*.example.com.", "invalid host/name", "", None, "xn--fa-hia.de"]
    got = [(r.name, r.unicode, r.wildcard) for r in idna.normalised(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string"), "raw").orderBy("i").collect()]
    assert got == [("xn--fa-hia.de", "faß.de", True), ("plain.com", "plain.com", False), (None, None, False), ("example.com", "example.com", True), (None, None, False), (None, None, False), (None, None, False), ("xn--fa-hia.de", "faß.de", False)]


def test_entries(spark):
    rows = [(1, ["*.faß.de", "a.com", None], ["ü.org"], "b.com\nΣας.gr", None, "Faß.de"), (2, ["A.com"], None, None, "x.com", None), (3, None, None, None, "ß.de", None), (4, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "entry_id long, dns_names array<string>, domains array<string>, name_value string, domain string, common_name string")
    e = decode.as_entries(d, {c: F.col(c) for c in d.columns})
    got = {r.entry_id: (r.dns_names, r.domains, r.name_value, r.domain, r.common_name) for r in idna.ascii_entries(e).collect()}
    assert idna.ascii_entries(e).schema == e.schema and e.columns == [f.name for f in schemas.ENTRY]
    assert got[1] == (["xn--fa-hia.de", "a.com", None], ["xn--tda.org"], "b.com\nxn--" + "σας".encode("punycode").decode() + ".gr", None, "xn--fa-hia.de")
    assert got[2] == (["A.com"], None, None, "x.com", None) and got[3][3] == "xn--zca.de" and got[4] == (None,) * 5


def test_registrable_labels(spark):
    rows = {"www.dbs.com.sg": "dbs.com.sg", "-x.com": None, "a.x-.com": None, "x" * 63 + ".com": "x" * 63 + ".com", "x" * 64 + ".com": None, ".".join(["abc"] * 70) + ".com": None, "printer.local": None, "a..com": None, "": None, "com": None, "a-b.com": "a-b.com", "xn--dbs-hia.com": "xn--dbs-hia.com"}
    d = spark.createDataFrame([(h,) for h in rows] + [(None,)], "host string")
    rules = ["com", "sg", "com.sg"]
    want = {**rows, None: None}
    assert {r.host: r.r for r in d.select("host", suffix.registrable(F.col("host"), rules).alias("r")).collect()} == want
    assert {r.host: r.registrable for r in suffix.with_registrable_trie(d, "host", rules).collect()} == want
    joined = suffix.with_registrable(d, "host", spark.createDataFrame([(r,) for r in rules], "rule string"))
    assert {r.host: r.registrable for r in joined.collect()} == want


def test_three_forms_agree(spark, monkeypatch, tmp_path):
    """Random rules and hosts over few labels: plan, structure and join."""
    rng, labels = random.Random(2), ["a", "b", "c", "dd"]
    name = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    names = {name(rng.randrange(1, 4)) for _ in range(25)}
    rules = sorted({rng.choice(["", "", "*."]) + n for n in names} | {"!" + rng.choice(labels) + "." + r[2:] for r in ["*.a", "*.b.c"]} | {"*.a", "*.b.c"})
    hosts = spark.createDataFrame([(name(rng.randrange(1, 6)),) for _ in range(300)], "host string").distinct()
    table = spark.createDataFrame([(r,) for r in rules], "rule string")
    one = {r.host: (r.suffix, r.registrable) for r in suffix.with_registrable_by_size(hosts, "host", table).collect()}
    monkeypatch.setattr(suffix, "MOST_RULES", 3)
    plan = suffix.with_registrable_by_size(hosts, "host", table)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r.host: (r.suffix, r.registrable) for r in plan.collect()} == one
    (tmp_path / "list.dat").write_text("// public\n\nCOM  // note\n*.ck\n!www.ck\n公司.cn\nxn--\n")
    assert sorted(r.rule for r in suffix.rule_table(spark, str(tmp_path / "list.dat")).collect()) == ["!www.ck", "*.ck", "com", "xn--55qx5d.cn"]


def test_tails_are_not_sent(spark):
    """The join of tails and rules sends a host and a number of labels, no list of labels."""
    hosts = spark.createDataFrame([("a.b.com",), ("x.ck",), ("com",), ("www.ck",), ("-.com",), (None,)], "host string")
    rules = spark.createDataFrame([("com",), ("*.ck",), ("!www.ck",)], "rule string")
    d = suffix.with_registrable(hosts, "host", rules)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "posexplode" not in plan
    got = {r.host: (r.suffix, r.registrable) for r in d.collect()}
    assert got == {"a.b.com": ("com", "b.com"), "x.ck": ("x.ck", None), "com": ("com", None), "www.ck": ("ck", "www.ck"), "-.com": (None, None), None: (None, None)}
