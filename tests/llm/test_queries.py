"""The registered queries and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lurelight.llm import queries


def plain(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).lower()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    names, want = sorted(got.columns), db.execute(entry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    assert sorted(tuple(plain(v) for v in r) for r in got.select(names).collect()) == sorted(tuple(plain(r[at.index(n)]) for n in names) for r in want.fetchall())


@pytest.mark.parametrize("name", [f"op{i}_" for i in range(1, 11)])
def test_registered(spark, sf, name):
    found = [n for n in entry.queries() if n.startswith(name)]
    assert len(found) == 1
    ids = {"op6_": "conv_id"}.get(name, "doc_id")
    d = entry.queries()[found[0]](spark, sf)
    assert ids in d.columns
    if name not in ("op6_", "op7_", "op9_"):
        assert d.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(p.STAGES)
    strange = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**9)
    seen = docs.unionByName(strange)
    one = stages["language"](spark, seen, sf)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = stages["near_duplicates"](spark, one, sf)
    from tests.llm.test_operators import brute_components

    firsts = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()], 80).items() if d == c}
    assert {r.doc_id for r in two.collect()} == firsts
    three = stages["decontamination"](spark, two, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in two.collect() if any(t in r.text for t in items)}
    kept = {r.doc_id for r in three.collect()}
    from lurelight.llm.decontaminate import Search
    from tests.llm.test_operators import brute_contamination

    held = {d for d, _ in brute_contamination([(r.doc_id, r.text) for r in two.collect()], list(enumerate(items)), Search())}
    assert leaked and leaked <= held and kept == firsts - held
    four = stages["mixing"](spark, three, sf)
    assert ids(four) == expected_mix(three)
    last = p.run(spark, sf)
    assert sorted(tuple(r) for r in last.collect()) == expected_tokens(four)


def ids(d):
    return sorted((r.doc_id for r in d.collect()), key=lambda x: (x is not None, x or 0))


def expected_mix(docs):
    import corpus_pipeline as p
    from lurelight.llm import mixing
    from tests.llm.test_operators import brute_mix, words

    named = docs.select("doc_id", mixing.domain_of(F.coalesce("source", F.lit(""))).alias("d"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), "text").collect()
    taken = {d for d, _ in brute_mix([("" if r.doc_id is None else r.doc_id, (r.d, r.l, r.s), len(words(r.text))) for r in named], p.MIX)}
    return sorted((r.doc_id for r in named if ("" if r.doc_id is None else r.doc_id) in taken), key=lambda x: (x is not None, x or 0))


def expected_tokens(docs):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(queries.TOKENIZER), 0, []
    for r in sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: (r.doc_id, r.text or "")):
        own = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((r.doc_id, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    return sorted(out)


CLASHING = ["full", "mix_key", "mix_note", "mix_tokens", "left", "_letters", "key", "n", "range", "_msource", "a.b", "bucket", "root", "u", "size", "Score", "epoch"]


def test_stages_on_awkward_tables(spark, sf):
    """Nulls in all columns, empty and long texts, repeated rows and ids, extra columns of any name."""
    import corpus_pipeline as p
    from lurelight.llm import langid
    from tests.llm.test_operators import brute_components

    stages, item = dict(p.STAGES), spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    few = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    rows = [(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, " 1 2\n", None, "s", 5), (1003, f"so {item} it is", "en", "s", 9), (None, "nobody knows the number of this text", "en", "s", 1)]
    rows += [(1004, "word " * 30_000, "en", "s", 2), (1005, "word " * 30_000, "en", None, 2), (1006, "the same row comes twice", "en", "s", 3), (1006, "the same row comes twice", "en", "s", 3), (1007, "an id with two texts", None, "s", 1), (1007, "of which this is the other", None, "s", 1)]
    docs = few.unionByName(spark.createDataFrame(rows, few.schema))
    docs = docs.withColumns({c: F.lit(f"{c}!") for c in CLASHING})
    kept = lambda got, d: got.columns == d.columns and all(r[c] == f"{c}!" for r in got.collect() for c in CLASHING)

    one = stages["language"](spark, docs, sf)
    said = langid.predict(docs, langid.fit(docs)).filter(f"lang_pred <> 'und' and score >= {p.LEAST_SCORE}")
    assert kept(one, docs) and ids(one) == ids(said) and {1000, 1001, 1002}.isdisjoint(ids(one))
    two = stages["near_duplicates"](spark, docs, sf)
    firsts = {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.filter("doc_id is not null and doc_id <> 1007").collect()], 80).items() if d == c} | {1007, None}
    assert kept(two, docs) and ids(two) == [d for d in ids(docs) if d in firsts]
    three = stages["decontamination"](spark, docs, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert kept(three, docs) and 1003 not in ids(three) and not any(t in (r.text or "") for r in three.collect() for t in items)
    assert set(ids(docs)) - set(ids(three)) <= {r.doc_id for r in docs.collect() if any(" ".join(t.split()[:4]) in (r.text or "") for t in items)} | {1003}
    four = stages["mixing"](spark, docs, sf)
    assert kept(four, docs) and ids(four) == expected_mix(docs)
    assert sorted(tuple(r) for r in stages["tokens"](spark, docs, sf).collect()) == expected_tokens(docs)


def test_stages_on_empty_tables(spark, sf):
    import corpus_pipeline as p

    none = spark.read.parquet(f"{sf}/documents.parquet").filter("false").withColumns({c: F.lit(c) for c in CLASHING})
    for name, stage in p.STAGES:
        got = stage(spark, none, sf)
        assert got.count() == 0 and (name == "tokens" or got.columns == none.columns)
