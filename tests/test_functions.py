import random

from pyspark.sql import functions as F

from lurelight import fixed_values as fixed
from lurelight.functions import binary, distance, suffix, text

RULES = fixed.SUFFIXES.split()


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


def osa(a, b):
    d = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distances_against_a_table(spark):
    r, rows = random.Random(5), []
    for _ in range(4000):
        letters = r.choice(["ab", "abc", "abcd"])
        rows.append(tuple("".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(2)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[distance.within(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (0, 1, 2)], *[distance.window_within(F.col("a"), F.col("b"), k).alias(f"w{k}") for k in (0, 1, 2)])
    for x in got.collect():
        for k in (0, 1, 2):
            assert x[f"k{k}"] == (osa(x.a, x.b) <= k), x
            part = bool(x.a and x.b) and any(osa(x.a[i : i + w], x.b) <= k for w in range(max(1, len(x.b) - k), min(len(x.a), len(x.b) + k) + 1) for i in range(len(x.a) - w + 1))
            assert x[f"w{k}"] == part, x


def test_traces_lose_no_match():
    r = random.Random(6)
    for _ in range(30_000):
        t = "".join(r.choice("abcd") for _ in range(r.randint(3, 9)))
        k, w = r.choice([1, 2]), list(t)
        i = 0
        for _ in range(k):  # edits from left to right, none on a swapped pair
            if i >= len(w):
                break
            i = r.randrange(i, len(w))
            kind = r.choice("sdix")
            if kind == "x" and i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
                i += 2
            elif kind == "d":
                del w[i]
            else:
                w[i : i + (kind == "s")] = [r.choice("abcde")]
                i += 1
        text = "zz" + "".join(w) + "zz"
        assert any(all(p in text for p in parts) for parts in distance.traces(t, k)), (t, text, k)


def test_registrable_domains(spark):
    cases = {
        "www.dbs.com.sg": "dbs.com.sg", "dbs.com.sg": "dbs.com.sg", "com.sg": None, "sg": None, "internet-banking.posb.com.sg": "posb.com.sg", "nus.edu.sg": "nus.edu.sg", "a.b.c.singpass.gov.sg": "singpass.gov.sg",
        "dbs.com.sg.evil.xyz": "evil.xyz", "xn--dbs-hia.com": "xn--dbs-hia.com", "a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "": None, "a..com": None,
    }
    d = spark.createDataFrame([(h,) for h in cases], "host string")
    got = {r.host: r.r for r in d.select("host", suffix.registrable(F.col("host"), RULES).alias("r")).collect()}
    assert got == cases
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    usual = d.filter("host <> '' and host not like '%..%'")
    assert {r.host: r.registrable for r in suffix.with_registrable(usual, "host", rules).collect()} == {h: r for h, r in cases.items() if h and ".." not in h}
    labels = suffix.subdomain_labels(F.col("v"), suffix.registrable(F.col("v"), RULES))
    assert one(spark, "a.b.dbs.com.sg", labels)[0] == ["a", "b"]
    assert one(spark, "dbs.com.sg", labels)[0] == []


def test_names(spark):
    v = F.col("v")
    for raw, name, wild in [("*.Example.com.", "example.com", True), ("", None, False), ("invalid host/name", None, False), (None, None, False), (" A.b ", "a.b", False), ("a..", "a.", False)]:
        r = one(spark, raw, text.normalise_name(v).alias("n"), text.is_wildcard(v).alias("w"))
        assert (r.n, r.w) == (name, wild), raw
    assert one(spark, "X.y-z.", text.compact(v))[0] == "xyz"
    assert one(spark, "dbsbank", text.decompose(v, ["bank", "dbs", "dbsbank"]))[0] == ["dbsbank", "dbs", "bank"]
    got = text.to_ascii_names(spark.createDataFrame([("bücher.example",), ("plain.example",), (None,)], "host string"), "host")
    assert sorted(r[0] or "" for r in got.collect()) == ["", "plain.example", "xn--bcher-kva.example"]


def test_international_names(spark):
    names = ["bücher.example", "DBS银行.com", "ocbc.中国", "пример.испытание", "ａｂｃ.example", "x。example", "plain_name.example", "a..b"]
    rows = spark.createDataFrame([(n,) for n in names], "v string").select("v", text.ascii_host(F.col("v")).alias("a")).collect()
    for v, a in rows:
        dotted = v.lower().replace("。", ".")
        want = dotted if dotted.isascii() else ".".join(x.encode("idna").decode() for x in dotted.split("."))
        assert a == want, v
    assert one(spark, None, text.ascii_host(F.col("v")))[0] == ""
    assert one(spark, "é" * 70 + ".example", text.ascii_host(F.col("v")))[0] == "é" * 70 + ".example"  # no such form: a label of over 63


def test_times(spark):
    v = F.col("v")
    assert one(spark, "1700000000", text.iso_time(v))[0] == "2023-11-14T22:13:20.000Z"
    assert one(spark, "2026-08-14T00:00:00Z", text.iso_time(v))[0] == "2026-08-14T00:00:00.000Z"
    assert [one(spark, x, text.iso_time(v))[0] for x in ("", "0", "never", None)] == [None] * 4


def test_binary(spark):
    paths = {0: "000", 5: "005", 1234: "x001/234", 1234067: "x001/x234/067", 2282206: "x002/x282/206"}
    for index, path in paths.items():
        assert one(spark, str(index), binary.tile_path(F.col("v").cast("long")))[0] == path
    note = "log.example\n1234\nabc=\n\n— log.example c2ln\n"
    c = one(spark, note, binary.checkpoint(F.col("v")))[0]
    assert (c.origin, c.tree_size, c.root_hash, [s.signature for s in c.signatures]) == ("log.example", 1234, "abc=", ["c2ln"])
    assert one(spark, "no blank line", binary.checkpoint(F.col("v")))[0] is None
    assert one(spark, "o\nx\nr\n\n— a b", binary.checkpoint(F.col("v")))[0] is None
    names = one(spark, "DNS:*.A.com, DNS:b.org, IP:1.2.3.4, DNS:plain", binary.dns_names(F.col("v")))[0]
    assert names == ["a.com", "b.org"]
