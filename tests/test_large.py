"""Scores by joins against scores by the plan, and the inverted index against trying all."""

import random

import pytest
from pyspark.sql import functions as F

from lurelight.operators import large
from lurelight.operators.score import score_hosts
from lurelight.plans import catalog, neutral
from lurelight.reference import Brand, Keyword, Scheme, default

LETTERS = "abcd"


def alignment(a, b):
    """Optimal string alignment by the table."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def holds(text, token, k):
    if k == 0:
        return token in text
    return any(alignment(text[i : i + w], token) <= k for w in range(max(1, len(token) - k), len(token) + k + 1) for i in range(len(text) - w + 1))


@pytest.mark.parametrize("index_rows", [200_000, 0])
def test_held(spark, monkeypatch, index_rows):
    """Short and long tokens, edits at every place; once with the index shuffled and
    its frequent signatures dealt out."""
    monkeypatch.setattr(large, "INDEX_ROWS", index_rows)
    monkeypatch.setattr(large, "DEALT", 5)
    rng = random.Random(index_rows)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    tokens = [(i, 0, word(rng.randrange(1, 12)), rng.choice([0, 1, 2])) for i in range(70)]
    texts = {word(rng.randrange(1, 20)) for _ in range(60)}
    for _, _, t, _ in tokens[:40]:  # swaps and other edits within tokens
        x = list(t)
        for _ in range(2):
            i = rng.randrange(len(x))
            if i + 1 < len(x) and rng.random() < 0.6:
                x[i], x[i + 1] = x[i + 1], x[i]
            else:
                x[i : i + rng.choice([0, 1])] = rng.choice([[], ["a"], ["b"]])
            x = x or ["c"]
        texts.add(word(3) + "".join(x) + word(2))
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.text, r.place) for r in large.held(d, spark.createDataFrame(tokens, "place long, tok int, compact string, most int")).collect()}
    assert got == {(x, i) for x in texts for i, _, t, k in tokens if holds(x, t, k)}


def scores(d):
    return {r.host: (r.registrable, r.score, r.severity, r.suppressed, [s.asDict() for s in r.signals]) for r in d.collect()}


def test_ten_thousand_tokens(spark, sf):
    """Equal to the projection, and no join tries all tokens."""
    hosts = neutral.part_hosts(catalog.read(spark, sf, "part")).select("host").distinct().limit(40)
    rng = random.Random(1)
    parts = sorted({x for r in hosts.collect() for x in r.host.split(".") if len(x) > 2})

    def token():
        x = rng.choice(parts) if rng.random() < 0.05 else "".join(rng.choice("aeionrstlmkg") for _ in range(rng.randrange(3, 14)))
        i = rng.randrange(len(x))
        return x[:i] + rng.choice(["", x[i], "-", "q", x[i] * 2]) + x[i + 1 :] or "x"

    brands = tuple(Brand(f"b{i}", f"B{i}", "c", tuple({token() for _ in range(3)}), rng.choice([None, 0, 1, 2]), rng.random() < 0.2, False, (rng.choice(parts),), rng.choice([(), ("com",)])) for i in range(3_400))
    words = tuple(Keyword(token(), "k") for _ in range(300))
    lures = tuple(Scheme(f"s{i}", f"S{i}", (token(), token()), rng.choice([0, 1]), "", "1996-01-01", "1996-12-31") for i in range(100))
    ref = neutral.REFERENCE.with_(brands=neutral.REFERENCE.brands + brands, keywords=neutral.REFERENCE.keywords + words, schemes=neutral.REFERENCE.schemes + lures)
    assert sum(len(b.tokens) for b in ref.brands) > 10_000
    at = F.lit("1996-06-01").cast("timestamp")
    got = large.score_hosts(hosts, large.tables(spark, ref), ref.scoring, ref.suffixes, at)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert scores(got) == scores(score_hosts(hosts, ref, at))


def test_built_in_tables(spark):
    """The published brands and lures, allowlisted and odd hosts included."""
    ref, at = default(), F.lit("2026-01-15").cast("timestamp")
    rows = ["posb-login.top", "dbs.com.sg", "www.dbs.com.sg.verify.example", "secure-singpost-parcel.xyz", "", "nothing.example", "sinpgost-login.top", "www.lta.gov.sg"]
    hosts = spark.createDataFrame([(r, i) for i, r in enumerate([*rows, rows[0]])], "host string, n int")
    got = large.score_hosts(hosts, large.tables(spark, ref), ref.scoring, ref.suffixes, at)
    assert got.columns[:2] == ["host", "n"] and got.count() == len(rows) + 1
    assert scores(got) == scores(score_hosts(hosts, ref, at))


def test_empty_tables(spark):
    ref, at = neutral.REFERENCE, F.current_timestamp()
    none = {n: t.limit(0) for n, t in large.tables(spark, ref).items()}
    hosts = spark.createDataFrame([("widget.com",), (None,)], "host string")
    assert {r.score for r in large.score_hosts(hosts.filter("host is not null"), none, ref.scoring, ref.suffixes, at).collect()} == {0}
    assert large.score_hosts(hosts.limit(0), large.tables(spark, ref), ref.scoring, ref.suffixes, at).count() == 0
