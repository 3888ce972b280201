"""Fingerprint groups, vector codes and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lurelight.llm import resample, simhash, vectorcodes
from lurelight.llm.queries import op11_simhash, op12_vector_codes, op13_resample
from lurelight.llm.scratch import Scratch
from tests.llm.test_operators import awkward, empty, words

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# fingerprints


def brute_fingerprint(text):
    w = words((text or "").translate(LOW))
    runs = [w[i : i + 4] for i in range(len(w) - 3)] if len(w) >= 4 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits=4):
    """id -> smallest id reachable, links between all pairs of different values."""
    by, up = {}, {}
    for d, f in sorted(fps.items()):
        by.setdefault(f, d)
    up = {f: f for f in by}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    values = np.array(list(by), np.uint64)
    for i, f in enumerate(by):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            a, b = top(f), top(int(values[i + 1 + j]))
            if a != b:
                up[a] = b
    least = {}
    for f, d in by.items():
        least[top(f)] = min(d, least.get(top(f), d))
    return {d: least[top(f)] for d, f in fps.items()}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_position_sets():
    for matches in range(1, 9):
        for size in range(1, 5):
            sets = [set(s) for s in simhash.position_sets(matches, size)]
            assert all(any(s <= set(c) for s in sets) for c in combinations(range(8), matches))
    assert len(simhash.position_sets(4, 3)) == 20


def test_fingerprint_of_pieces(monkeypatch):
    text = "É Wort\t" + "Ab cd efg " * 50 + "x" * 300 + " end\x0b of it"
    want = brute_fingerprint(text)
    for block in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text.encode()) == signed(want)


def test_op11(spark, sf):
    docs = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root = brute_groups(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op11_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", root[d]) for d, f in docs.items()}


@pytest.mark.parametrize("size, block", [(3, 256), (3, 3), (4, 256)])
def test_groups(spark, size, block):
    """Chains, stars and copies, of which some share a posting with very many."""
    rng, fps = random.Random(size * block), []
    for _ in range(6):
        center = rng.getrandbits(64)
        fps += [center] * 5
        for _ in range(60):  # two or three steps of chains, and values that are just too far away
            f = center if rng.random() < 0.5 else rng.choice(fps)
            for b in rng.sample(range(64), rng.choice([1, 4, 5, 6])):
                f ^= 1 << b
            fps.append(f)
    fps += [(0xABCDEF << 40) | rng.getrandbits(40) for _ in range(150)]  # one posting, hardly a link
    rng.shuffle(fps)
    ids = dict(zip(rng.sample(range(10**6), len(fps)), fps))
    table = spark.createDataFrame([(d, signed(f)) for d, f in ids.items()], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.groups(table, size=size, block=block).collect()}
    assert got == brute_groups(ids)


def test_fingerprints_of_awkward_rows(spark):
    d = awkward(spark).unionByName(awkward(spark).filter("doc_id = 4"))
    rows = {r.doc_id: r for r in simhash.near_fingerprints(d).collect()}
    want = {r.doc_id: brute_fingerprint(r.text) for r in awkward(spark).collect() if r.doc_id is not None}
    assert {d: r.fp for d, r in rows.items()} == {d: signed(f) for d, f in want.items()}
    assert {d: r.component_id for d, r in rows.items()} == brute_groups(want)
    assert rows[1].fp == 0 and rows[3].component_id == 1
    assert simhash.near_fingerprints(empty(spark)).count() == 0


# vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label, codes, error), codebooks; all entries tried."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], k) for i, v, k in rows)
    kept = [(i, v, k) for i, v, k in kept if len(v) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    books = [[v[p * w : (p + 1) * w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(nearest(p, v[p * w : (p + 1) * w])[1], []).append(v[p * w : (p + 1) * w])
            for n, xs in of.items():
                new[p][n] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    out = []
    for i, v, k in kept:
        found = [nearest(p, v[p * w : (p + 1) * w]) for p in range(parts)]
        out.append((i, k, [n for _, n in found], sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("spread", [3, 40, 3000])
def test_tree(spread):
    """Every query has the entry of an exhaustive search, ties (of which a small
    spread has many) to the lower index."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 16, 17, 200, 256):
        entries, x = (rng.integers(-spread, spread, (m, 6)) for m in (n, 500))
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        who, best = vectorcodes.Tree(entries).nearest(x)
        assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_compress(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.choice([-1, 0.5, 0.25, rng.gauss(0, 1)]))) for _ in range(8)], rng.choice([None, 1, 2])) for i in rng.sample(range(1000), 60)]
    rows += [rows[0], (rows[1][0], rows[2][1], 1)]  # a repeated row and a repeated id
    wrong = [(2000, None, 1), (2001, [None, *[0.0] * 7], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf"), *[0.0] * 7], 2), (2004, [], 1), (2005, [1.0] * 7, 1), (2006, [1.0] * 4, 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + wrong], "vec_id long, embedding array<float>, label int, part string").repartition(3)
    got, books = vectorcodes.compress(table, entries=20)
    want, want_books = brute_codes(rows, entries=20)
    assert books.tolist() == want_books
    key = lambda r: (r[0], r[2], r[3], str(r[1]))
    assert sorted(((r.vec_id, r.label, r.codes, r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert vectorcodes.decoded(want[0][2], books).shape == (8,)
    few, _ = vectorcodes.compress(table, rounds=1)
    assert few.count() == len(rows)  # fewer rows than entries
    none, books = vectorcodes.compress(table.limit(0))
    assert none.count() == 0 and books.size == 0 and vectorcodes.code_digests(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vectorcodes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], table.drop("part").schema))[0].count()


def test_op12(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    d = op12_vector_codes(spark, sf)
    assert d.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and d.count() == len(rows)


# resampling


RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text, most):
    w = RUN.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent=25, least=20, most=2, size=10_000, seed=7):
    s, t = (Counter(b % size for x in texts for b in brute_buckets(x, most)[1]) for texts in ([x for _, x in docs], target))
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + size) / ((s[b] + 1) * (tt + size)))) for b in s}
    out = []
    for d, text in docs:
        if d is None:
            continue
        n, b = brute_buckets(text, most)
        weight = sum(gain[x % size] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append((n >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), d, len(b), weight))
    able = sorted((x for x in out if x[0]), key=lambda x: (-x[1], x[2], x[3], x[4]))
    drawn = {}
    for n, x in enumerate(able[: percent * len(able) // 100]):
        drawn.setdefault(x[1:], []).append(n + 1)
    left = {k: list(v) for k, v in drawn.items()}
    return sorted(((d, n, w, s, left[s, d, n, w].pop(0) if left.get((s, d, n, w)) else None) for _, s, d, n, w in out), key=str)


def test_ring(monkeypatch):
    text = "Ab, cd-é 12  " * 40 + "z" * 99 + " \n last"
    n, want = brute_buckets(text, 3)
    for block in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK", block)
        got = [s for _, states in resample.ring(text.encode(), 3) for s in states]
        assert Counter(got) == Counter(want)
        assert sum(len(s) for k, s in resample.ring(text.encode(), 3) if k == 1) == n
    assert not [s for _, states in resample.ring(b" .-", 2) for s in states]


def rows_of(d):
    return sorted((tuple(r) for r in d.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resample(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE", 7)  # many ranges
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma-ray", "delta", "ünit", "x1"]) for _ in range(n))
    docs = [(i, make(rng.randrange(0, 60))) for i in range(80)] + [(80, None), (81, ""), (None, "alpha beta"), (5, make(30))]
    docs += [docs[40], (7, docs[7][1])]  # repeated rows
    target = ["alpha beta", None, "x1 x1 x1", ""]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank int, bucket int").repartition(5)
    t = spark.createDataFrame([(x, 3) for x in target], "text string, n int")
    assert rows_of(resample.resample(d, t)) == brute_resample(docs, target)
    assert rows_of(resample.resample(d, t, most=3, buckets=50, percent=60, least_words=1)) == brute_resample(docs, target, 60, 1, 3, 50)
    assert rows_of(resample.resample(d, t.limit(0))) == brute_resample(docs, [])
    assert resample.resample(d.limit(0), t).count() == 0


def test_resample_of_awkward_rows(spark):
    got = resample.resample(awkward(spark), awkward(spark))
    assert rows_of(got) == brute_resample([(r.doc_id, r.text) for r in awkward(spark).collect()], [r.text for r in awkward(spark).collect()])


def test_op13(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert rows_of(op13_resample(spark, sf)) == brute_resample([(r.doc_id, r.text) for r in docs], [r.text for r in items])


def test_scratch_tables_are_kept_apart(spark):
    one, two = Scratch(spark, "a"), Scratch(spark, "a")
    assert one.base != two.base and one.table(spark.range(3)).filter(F.col("id") > 0).count() == 2
