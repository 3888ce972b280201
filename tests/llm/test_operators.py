"""Operators against brute force on small and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurelight.llm import chat, decontaminate, langid, mixing, neardup, planes, quality, repeats, rules, secrets, textbytes
from lurelight.llm.encode import Encoder
from lurelight.llm.queries import TOKENIZER, op6_chat, op7_decontaminate
from lurelight.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "É a\x0bb\x0cc d e f"), (7, "a " * 3000), (8, "a " * 3000), (9, "x" * 70_000 + " y"), (None, "lost"), (10, "no letters: 1 2 3"), (11, "\n\n\na  b\n"), (12, "日本語 テキスト"),
]


def awkward(spark, extra=True):
    """Nulls, empty and long texts, repeated rows; columns whose names clash with inner ones."""
    d = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    if extra:
        d = d.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1), "bucket": F.lit("b"), "tokens": F.lit(0), "n": F.lit(9), "key": F.lit("k"), "score": F.lit(1)})
    return d


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


# near duplicates


def brute_components(rows, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(low))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: (len(sets[d]), top(d)) for d in ids}


def near_copies(n=60, groups=3):
    """Groups of near copies whose members are often below the limit to the smallest id."""
    r, rows = random.Random(2), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(150)]
        for k in range(n):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = f"e{r.randrange(4)}"
            rows.append((g * 1000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("block", "percent", "dealt"), [(8, 85, 7), (256, 80, 512)])
def test_near_duplicates(spark, monkeypatch, block, percent, dealt):
    monkeypatch.setattr(neardup, "DEALT", dealt)
    rows = near_copies() + [(9000 + i, t) for i, t in enumerate(["a b c d e f", "A b C d e f", "a b c", "a b c", "", None])]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, block).collect()}
    want = brute_components(rows, percent)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_near_duplicates_awkward(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(awkward(spark)).collect()}
    assert got == brute_components([x for x in AWKWARD if x[0] is not None], 80)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_sample(spark, sf):
    d = sample(spark, sf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in d.collect()], 80)


def test_bands_leave_few_pairs_apart():
    assert [neardup.bands_for(p) for p in (80, 85)] == [28, 20]


def test_odd_sketch_tells_similarity():
    r = np.random.default_rng(1)
    for j in (0.9, 0.6):
        a = r.integers(0, 2**63, 2000).astype(np.uint64)
        same = int(len(a) * 2 * j / (1 + j))
        b = np.concatenate([a[:same], r.integers(0, 2**63, len(a) - same).astype(np.uint64)])
        bits = int(np.bitwise_count(neardup._odd(neardup._samples(a)) ^ neardup._odd(neardup._samples(b))).sum())
        assert (bits <= neardup.most_bits(0.85)) == (j > 0.85)


# tokens


def test_encoder_equals_tokenizer():
    e, r = Encoder(TOKENIZER, 50), random.Random(3)
    texts = ["", " ", "\n\n", "a\n\n\nb", "x <|endoftext|> y", "it's don't '  s", "hi.\nyou, ok?! yes.", "a\xa0b \xa0", "é日本 ½, Ⅷ.", "\t a"]
    texts += ["".join(r.choice([" ", "\n", "a", "b.", "'s", "é", ",", "1", "  ", "\n\n", "\t", " a"]) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts.append(" ".join(f"w{i % 977} x." for i in range(400_000)))  # cut on the way
    for t in texts:
        assert np.frombuffer(e.encode(t), e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 2), (9, 70_000), (5000, 50_257), (64, 2**32)):
        ids = r.integers(0, top, n).astype(np.uint32)
        p, sizes, payload = planes.pack(ids, 1000, kind)
        assert (planes.unpack(n, 1000, p, kind, sizes, payload) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, sf, kind):
    t = Encoder(TOKENIZER).tokenizer
    for d, chunk in ((awkward(spark).filter("doc_id <> 5"), 300), (sample(spark, sf), 20_000), (empty(spark), 100)):
        path = Scratch(spark, "t").base
        planes.write_tokens(d, path, TOKENIZER, kind, 128, chunk)
        got = {r.doc_id: r for r in planes.document_digests(spark, path).collect()}
        at = 0
        for r in sorted((r for r in d.select("doc_id", "text").collect() if r.doc_id is not None), key=lambda r: r.doc_id):
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            g = got.pop(r.doc_id)
            assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
        assert not got
        first = planes.read_tokens(spark, path).orderBy("doc_id").first()
        assert first is None or len(first.ids) % 4 == 0


# secrets


def brute_secrets(t, o):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        s, w = m[0], o.window
        if len(s) < w or not re.search("[0-9]", s) or any(re.search(a, s) for a in o.allow):
            continue
        k = 3 if re.fullmatch("[0-9a-fA-F]+", s) else 4 if re.fullmatch("[0-9A-Za-z]+", s) else 5
        least = (o.hex_bits, o.alnum_bits, o.base64_bits)[k - 3]
        hot = [i for i in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= least - 1e-10]
        if hot:
            out.append((m.start() + hot[0], k, m.start() + hot[-1] + w))
    said = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    out.sort()
    base = [x for x in out if x[1] < 3]
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(out))


def test_secrets(spark, sf):
    texts = [
        "password=abc", "token=secret=abcdefgh secret=token:abcdefgh", "\U0001f600é API_KEY: 'a.b_c-d=e' PassWord==xyzzy12", "AKIA" + "A" * 16 + " AKIA12 AKIAXAKIA" + "B" * 14, "deadbeef" * 3 + "x" + "0" * 24,
        "key aB3dE5gH7jK9mN1pQ3sT5vX7z and 550e8400-e29b-41d4-a716-446655440000 tokens", "\nſecret=abcdefgh ToKen=abcdefg", "a" * 24 + "1" + "a" * 23 + "Q9x8W7v6U5t4S3r2Q1p0", "token='" + "Zx9" * 400 + "'", "0123456789abcdefABCDEF0123", "password='hunter22' " * 40,
    ]
    d = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    for docs in (d.unionByName(awkward(spark, False)), sample(spark, sf)):
        o = secrets.Entropy()
        want = sorted((r.doc_id or -1, *brute_secrets(r.text, o)) for r in docs.collect())
        assert sorted((r[0] or -1, *r[1:]) for r in secrets.find_secrets(docs, o).collect()) == want
    assert secrets.find_secrets(empty(spark)).count() == 0 and secrets.find_secrets(awkward(spark)).count() == len(AWKWARD)


# repeats


def brute_repeats(rows, size):
    own = [(d, words(t)) for d, t in rows if d is not None]
    lo = {}
    for d, w in own:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            lo[k] = min(d, lo.get(k, d))
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if lo[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("size", "chars"), [(50, 1000), (12, 400), (50, 1 << 23)])
def test_repeats(spark, sf, size, chars):
    w = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(4, w(0, 200)), (5, w(100, 300)), (6, w(0, 49)), (7, w(0, 50) + " x " + w(0, 50)), (8, w(0, 50)), (8, w(10, 60)), (8, w(10, 60)), (9, "x " + w(20, 69) + " y"), (10, "x " + w(20, 70) + " y"), (11, "a " * 300), (12, "a " * 60), (13, "\n".join(["a"] * 49))]
    for d in (spark.createDataFrame(rows, "doc_id long, text string"), awkward(spark), sample(spark, sf)):
        want = brute_repeats([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], size)
        assert sorted(map(tuple, repeats.without_repeats(d, size, min(8, size), chars).collect())) == want
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_repeats_with_one_hash_for_all_words(spark, monkeypatch):
    """Words are compared themselves: hashes that tell nothing change no result."""
    r = random.Random(9)
    base = [f"k{i}" for i in range(40)]
    rows = []
    for d in range(12):
        w = list(base)
        w[r.randrange(40)] = f"x{d % 3}"
        rows.append((d, [hash_of_len(x) for x in w + base[:d]]))
    rows = [(d, " ".join(w)) for d, w in rows]
    table = pa.table({"bucket": pa.array([0] * 12, pa.int32()), "doc_id": [d for d, _ in rows], "rid": list(range(12)), "text": [t for _, t in rows]})

    def blind(data, offsets, hashed=True):
        w = textbytes.words(data, offsets)
        return w._replace(hash=np.full(len(w.doc), 7, np.uint64))

    monkeypatch.setattr(repeats, "words", blind)
    letters = repeats._letters(np.full(5, 7, np.uint64))
    found = pa.table({"phrase": pa.array([letters.tobytes()], pa.binary())})
    got = repeats._streamed(12, 5)(table, found).to_pylist()
    runs_of = [set(x["run"]) for x in got]
    assert all(len(x["run"]) >= 1 for x in got)
    for a in range(12):  # runs have equal digests only where their words are equal
        for b in range(12):
            wa, wb = got[a]["text"].split(), got[b]["text"].split()
            spans = lambda g, w: {tuple(w[s : s + n + 11]) for s, n in zip(g["start"], g["length"])}
            assert len(runs_of[a] & runs_of[b]) == len(spans(got[a], wa) & spans(got[b], wb))


def test_repeats_are_what_the_automata_find(monkeypatch):
    """Only confirmed passages go, wherever they stand, if their words are the same
    and a smaller id holds them first; letters may tell nothing."""
    digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
    letters = lambda t: repeats._letter(repeats.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hash)
    texts = [(1, "a b c d e f"), (5, "x a b c d y a b c"), (6, "b c d e é"), (7, ""), (8, "a b c d e f")]
    known = [("a b c", 1), ("a b c d", 1), ("c d e", 6), ("b c d e", 6), ("a b c", 4)]
    want = [(1, 6, 0, "a b c d e f"), (5, 9, 7, "x y"), (6, 5, 0, "b c d e é"), (7, 0, 0, ""), (8, 6, 5, "f")]

    def blind(data, offsets, hashed=True):
        w = textbytes.words(data, offsets)
        return w._replace(hash=np.full(len(w.doc), 7, np.uint64))

    for find in (textbytes.words, blind):
        monkeypatch.setattr(repeats, "words", find)
        docs = pa.table({"doc_id": [d for d, _ in texts], "text": [t for _, t in texts]})
        found = pa.table({"letters": [letters(t) for t, _ in known], "digest": [digest(t) for t, _ in known], "lo": [n for _, n in known]})
        got = repeats._resolved(docs, found)
        assert [tuple(r.values()) for r in got.to_pylist()] == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want]
        assert repeats._resolved(docs, found.slice(0, 0)).column("n_removed").to_pylist() == [0] * 5
        assert repeats._resolved(docs.slice(0, 0), found).num_rows == 0


def hash_of_len(x):
    return hashlib.md5(x.encode()).hexdigest()[:8]


# classifiers


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    m = quality.fit(docs, labels.filter(fold != 0))
    p = quality.score(docs, m).join(labels.filter(fold == 0), "doc_id").toPandas()
    good, bad = p[p.quality == 1].score.to_numpy(), p[p.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.8 and (good >= 0.3).mean() > 0.9
    again = quality.fit(docs, labels.filter(fold != 0))
    assert all((a == b).all() for a, b in zip(m.layers, again.layers)) and m.temperature == again.temperature
    for d in (awkward(spark), empty(spark)):
        s = [r.score for r in quality.score(d, m).collect()]
        assert len(s) == d.count() and all(0 <= x <= 1 for x in s)
    none = quality.fit(empty(spark), labels.filter("false"))
    assert {r.score for r in quality.score(awkward(spark), none).collect()} == {0.5}


def test_quality_against_plain_sums(spark, sf):
    """Word vectors, pooling, network and calibration step by step, without Spark."""
    o = quality.Options(rows=97, size=16, epochs=8)
    docs, labels = sample(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.fit(docs, labels, o)
    place, sign = quality._index(o)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = {r.doc_id: words((r.text or "").translate(low)) for r in docs.collect()}

    def row(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return int(textbytes.words(b, np.array([0, len(b)])).hash[0] % np.uint64(o.rows))

    known = {w: row(w) for t in texts.values() for w in t}
    total = np.zeros((o.rows, o.size))
    for t in texts.values():
        v = [known[w] for w in t]
        for i, a in enumerate(v):
            for j in range(max(0, i - o.around), min(len(v), i + o.around + 1)):
                if i != j:
                    np.add.at(total[a], place[v[j]], sign[v[j]])
    length = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(m.vectors, total / np.maximum(length, 1e-9), atol=1e-5)
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    for d, t in texts.items():
        x = m.vectors[[known[w] for w in t]].astype(float) if t else np.zeros((1, o.size))
        x = np.concatenate([x.mean(axis=0), x.std(axis=0), [np.log1p(len(t))]])
        z = (np.maximum(((x - m.mean) / m.spread) @ m.layers[0] + m.layers[1], 0) @ m.layers[2] + m.layers[3])[0]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z / m.temperature)), abs=2e-3)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    net = langid.fit(docs.filter(fold != 2), langid.Fit(steps=400))
    p = langid.predict(docs, net).join(docs.filter(fold == 2).select("doc_id", "lang"), "doc_id").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97 and p.score.between(0, 1).all()
    got = {r.doc_id: r.lang_pred for r in langid.predict(awkward(spark), net).collect()}
    assert len(got) == len(AWKWARD) and all(got[d] == "und" for d in (1, 2, 3)) and got[10] != "und" and got[12] in net.labels
    kept = langid.keep_known(awkward(spark), net, 0.0)
    assert kept.columns == awkward(spark).columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.fit(empty(spark)) is None and {r.lang_pred for r in langid.predict(awkward(spark), None).collect()} == {"und"}
    # tables by pairs of bytes are the convolution
    x = np.frombuffer(b"Some bytes of a window, padded." + bytes(net.window - 31), np.uint8)[None]
    pooled = []
    for w, b in zip(net.filters, net.bias):
        e = net.embed[x[0]]
        pooled.append(max_over(e, w) + b)
    z = np.maximum(np.concatenate(pooled), 0) @ net.out + net.out_bias
    assert np.allclose(langid.Scorer(net).probabilities(x)[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def max_over(e, w):
    return np.max([np.einsum("we,wef->f", e[i : i + len(w)], w) for i in range(len(e) - len(w) + 1)], axis=0)


# rules


def brute_rules(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_rule_statistics(spark, sf):
    texts = ["a b c a b c\n\na b c a b c\n a", "é|<é> \n\x0b x\n\x0b x\n x", "\n\na\n\n", "é é é é é é", "x\nx\nx", "# $ & <a>"]
    for d in (spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"), awkward(spark), sample(spark, sf)):
        got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(d).collect())
        assert got == sorted((r.doc_id, *brute_rules(r.text)) for r in d.select("doc_id", "text").collect() if r.doc_id is not None)


def test_quality_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = rules.quality_rules(docs, labels)
    p = judged.join(labels, "doc_id", "left").toPandas()
    assert not p[p.base_failed].kept.any() and ((p.n_words < 50) <= p.base_failed).all()
    fine = p[~p.base_failed]
    assert fine[fine.quality == 1].kept.mean() > 0.98
    good, bad = fine[fine.quality == 1].anomaly.to_numpy(), fine[fine.quality == 0].anomaly.to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.9  # short paths for odd texts
    assert rules.quality_rules(awkward(spark), labels).count() == len(AWKWARD) - 1 and rules.quality_rules(empty(spark), labels.filter("false")).count() == 0
    # without one of the classes nothing is rejected
    for one in (labels.filter("quality = 1"), labels.filter("quality = 0"), None):
        assert rules.quality_rules(docs, one).filter("not base_failed and not kept").isEmpty()


def test_quality_rules_on_rows_held_apart(spark):
    """Shares of labelled rows that took no part in setting the limits."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.quality: r for r in rules.outcome(rules.quality_rules(docs, labels), labels).collect()}
    assert got[0]["rows"] > 40 and got[0].rejected > 0.9 * got[0]["rows"] and got[1].rejected < 0.02 * got[1]["rows"]
    # bad for another reason: some documents in upper case are labelled so
    loud = F.pmod("doc_id", F.lit(50)) == 3
    strange = docs.withColumn("text", F.when(loud, F.upper("text")).otherwise(F.regexp_replace("text", "[#*$%&|<>]+", "")))
    ours = docs.select("doc_id", F.when(loud, 0).otherwise(1).alias("quality"))
    got = {r.quality: r for r in rules.outcome(rules.quality_rules(strange, ours), ours).collect()}
    assert got[0].rejected > 0.9 * got[0]["rows"] and got[1].rejected < 0.02 * got[1]["rows"]


def test_quality_rules_limit_against_brute_force(spark):
    """One forest over all statistics rejects the bad rows; its weights and limit
    are those of a plain computation over the labelled rows."""
    sf, o = "/root/testdata/sf0.01", rules.Forest()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = rules.quality_rules(docs, labels, o)
    p = judged.join(labels.select("doc_id", "quality", rules._apart(o).alias("apart")), "doc_id").filter("not base_failed").toPandas()
    assert labels.count() == labels.select("doc_id").distinct().count()
    used, apart = p[~p.apart], p[p.apart]
    clean = np.sort(used[used.quality == 1].anomaly.to_numpy())
    limit = min(v for v in clean if (clean > v).mean() <= o.clean_loss)
    assert ((p.anomaly <= limit) == p.kept).all()
    assert (~apart[apart.quality == 0].kept).mean() > 0.9 and (~apart[apart.quality == 1].kept).mean() < 0.04 and (apart.quality == 0).sum() > 5
    x = rules.features({c: used[c].to_numpy() for c in rules.COUNTS})
    bad, good = x[used.quality == 0], x[used.quality == 1]
    want = np.sqrt((bad.mean(0) - good.mean(0)) ** 2 / (bad.var(0) + good.var(0) + 1e-12))
    known = spark.createDataFrame(used[["quality", *rules.COUNTS]])
    assert rules.separation(known) == pytest.approx(want, rel=1e-6) and (want > 0).sum() > 5
    assert rules.separation(known.filter("quality = 1")) is None and rules.separation(known.filter("false")) is None


def test_forest_splits_by_weights():
    x = np.random.default_rng(3).normal(size=(200, 3))
    used = np.concatenate([t[0] for t in rules.grow_forest(x, rules.Forest(tree_rows=64), 20, np.array([3.0, 1.0, 0.0]))])
    n = np.bincount(used[used >= 0], minlength=3)
    assert n[2] == 0 and n[0] > 2 * n[1] > 0
    assert all(t[0][0] < 0 for t in rules.grow_forest(np.ones((5, 3)), rules.Forest(), 2))  # equal rows: nothing to split


def test_forest_paths_against_a_walk():
    r = np.random.default_rng(8)
    x, options = r.normal(size=(300, 3)), rules.Forest(tree_rows=64)
    forest = rules.grow_forest(x, options, 20)

    def walk(tree, row, at=0):
        feature, value, left = tree
        return value[at] if feature[at] < 0 else walk(tree, row, left[at] + (1 if row[feature[at]] > value[at] else 0))

    def depths(tree, at=0, d=0):
        feature, _, left = tree
        return [d] if feature[at] < 0 else depths(tree, left[at], d + 1) + depths(tree, left[at] + 1, d + 1)

    expected = 2 * sum(1 / i for i in range(1, 64)) - 2 * 63 / 64  # mean path of 64 rows, by its sum
    got = rules.anomaly(x, forest, 64)
    assert got == pytest.approx([2 ** (-np.mean([walk(t, row) for t in forest]) / expected) for row in x], rel=0.01)
    assert all(max(depths(t)) <= 6 for t in forest)
    assert rules.anomaly(np.array([[9.0, 9.0, 9.0]]), forest, 64)[0] > got.max()


# chats


def test_chats(spark, sf):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, None, None), (2, 1, "assistant", "a\\b\\\\"), (2, 1, "assistant", "<|im_end|><|im_start|>user<|im_sep|>x"), (2, None, "ro<|im_sep|>le\n", "\\<|im_end|>"),
        (3, 5, "assistant", "<|im_end"), (3, 6, "user", "|>"), (3, 7, "assistant", "<\\/s>"), (4, 0, "assistant", ""), (None, 0, "user", "x"), (5, 0, "assistant", "<<SYS>> <</SYS>> é😀 <<<s>>>"), (5, 0, "assistant", "<<SYS>> <</SYS>> é😀 <<<s>>>"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1))
    for x in (d, spark.read.parquet(f"{sf}/conversations.parquet"), d.filter("false")):
        source = defaultdict(list)
        for r in x.collect():
            if r.conv_id is not None:
                source[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
        formatted = chat.format_chats(x).cache()
        got = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
        assert set(got) == set(source)
        for c, t in source.items():
            loss, g = "".join(b for _, a, b in sorted(t) if a == "assistant"), got[c]
            assert g.identical and g.n_turns == len(t) and g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in sorted(t)).encode()).hexdigest()
            assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert op6_chat(spark, sf).filter("conv_id = -7").first().loss_chars == 21
    every = d.limit(9).select(*[chat.unescape(f(F.coalesce("text", F.lit("")))).alias(n) for n, f in (("a", chat.escape), ("b", chat.escape_all), ("c", lambda c: chat.escape(chat.escape_all(c))))], F.coalesce("text", F.lit("")).alias("t")).collect()
    assert all(r.a == r.b == r.t for r in every)
    # a reader for whom a backslash makes the next character literal ends every turn
    last = spark.createDataFrame([(i, 0, role, "a" + "\\" * n) for i, (role, n) in enumerate([("user", 1), ("user", 2), ("user", 3), ("user\\", 0)])], d.drop("span").schema)
    for r in chat.format_chats(last).collect():
        assert r.identical and re.sub(r"(?s)\\.", "", r.formatted).count(chat.END) == 1 and re.sub(r"(?s)\\.", "", r.formatted).count(chat.MIDDLE) == 1
    broken = chat.format_chats(d).withColumn("identical", F.col("conv_id") != 3)
    with pytest.raises(Exception, match="no round trip: conversation 3"):
        chat.checked(broken).collect()


# decontamination


def test_contamination(spark):
    r = random.Random(4)
    new = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    item, other = new(40), new(30)
    edited = [w if i % 6 else "zzz" for i, w in enumerate(item)]
    shorter = [w for i, w in enumerate(item) if i % 9]
    rows = [(1, new(300) + item + new(300)), (2, new(50) + [w.upper() + "!" for w in edited]), (3, shorter + new(20)), (4, new(400)), (5, item[:12] + new(100)), (6, other + new(3)), (7, []), (8, item)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (None, " ".join(item))] + [(100 + i, " ".join(item)) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, ", ".join(other)), (3, "too short"), (4, None), (None, " ".join(item)), (5, " ".join(item))], "item_id long, text string").withColumn("seed", F.lit(1))
    want = {(d, i) for d in (1, 2, 3, 8, *range(100, 140)) for i in (1, 5)} | {(6, 2)}
    for o in (decontaminate.Search(), decontaminate.Search(block_seeds=10)):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, o).collect()} == want
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0 and decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark), bench).count() == 0


def test_contamination_whatever_else_is_frequent(spark):
    r = random.Random(5)
    new = lambda n: [f"u{r.randrange(5000)}" for _ in range(n)]
    item = new(40)
    edited = [w if i % 6 != 5 else "zzz" for i, w in enumerate(item)]
    rows = [(i, new(30) + edited + new(30)) for i in range(40)] + [(100, item), (101, new(20) + item[3:9] + new(20))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: x.score for x in decontaminate.contaminated(docs, bench).collect()}
    want = {i: decontaminate.align(np.array([hash(x) for x in item]), np.array([hash(x) for x in w]), 0.5) / 40 for i, w in rows}
    assert got == pytest.approx({i: s for i, s in want.items() if s >= 0.5}) and set(got) == {*range(40), 100}


def test_contamination_of_short_items(spark):
    r = random.Random(6)
    new = lambda n: [f"s{r.randrange(50000)}" for _ in range(n)]
    item, three = new(15), new(3)
    spaced = [w if i not in (3, 7, 11) else "zzz" for i, w in enumerate(item)]
    rows = [(1, new(40) + spaced + new(40)), (2, new(9) + three + new(9)), (3, [three[0], "zzz", three[2]]), (4, new(80))]
    for k in range(20, 60):  # five of fifteen replaced: a score of 0.5
        at = set(r.sample(range(15), 5))
        rows.append((k, [w if i not in at else "zzz" for i, w in enumerate(item)]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(three))], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(docs, bench).collect()}
    score = lambda x, w: decontaminate.align(np.array([hash(v) for v in x]), np.array([hash(v) for v in w]), 0.5) / len(x)
    want = {(d, i): score(x, w) for d, w in rows for i, x in ((1, item), (2, three))}
    assert got == pytest.approx({k: s for k, s in want.items() if s >= 0.5})
    assert {(1, 1), (2, 2), (3, 2)} < set(got)


def brute_contamination(docs, items, o):
    """Alignments of all pairs."""
    low = lambda t: np.array([hash(w) for w in WORD.findall(re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()))])
    texts, own = [(d, low(t)) for d, t in docs if d is not None], [(i, low(t)) for i, t in items if i is not None]
    pairs = {}
    for d, w in texts:
        for i, x in own:
            if len(x) and np.isin(x, w).sum() >= o.score * len(x):  # an alignment has no more matches
                score = decontaminate.align(x, w, o.penalty) / len(x)
                if score >= o.score:
                    pairs[d, i] = max(score, pairs.get((d, i), 0))
    return pairs


def test_contamination_query(spark, sf):
    docs, items = sample(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in op7_decontaminate(spark, sf).collect()}
    assert got == pytest.approx(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], decontaminate.Search())) and got


def test_contamination_of_items_with_common_words(spark):
    """Items that share most of their n-grams with many others are found by the rare ones."""
    r = random.Random(12)
    common = [f"c{i}" for i in range(12)]
    items = [[x for _ in range(10) for x in (r.choice(common), r.choice(common), f"i{k}x{r.randrange(8)}")] for k in range(60)]
    docs = []
    for d in range(150):
        w = list(items[r.randrange(60)])
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = r.choice(common) if r.random() < 0.7 else "zzz"
        for _ in range(r.randrange(5)):
            del w[r.randrange(len(w))]
        docs.append((d, " ".join([r.choice(common) for _ in range(30)] + w + [r.choice(common) for _ in range(30)])))
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    o = decontaminate.Search()
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), o).collect()}
    want = brute_contamination(docs, items, o)
    assert got == pytest.approx(want) and len(want) > 60
    block = decontaminate.Block({np.array([hash(x) for x in t.split()], np.int64).view(np.uint64).tobytes(): [i] for i, t in items}, o)
    every = Counter(g for _, t in items for g in set(t.split()))
    block.choose({1: np.array([every[x] for x in sorted(every, key=lambda x: int(textbytes.grams(np.array([hash(x)], np.int64).view(np.uint64), 1)[0]))])})
    seeds, start, _ = block.seeds[1]
    assert len(seeds) < len(every) and np.diff(start).max() < max(every.values())  # the commonest are no seeds


@pytest.mark.parametrize("search", [decontaminate.Search(), decontaminate.Search(score=0.8), decontaminate.Search(score=0.7, penalty=1.0, hold=2), decontaminate.Search(score=0.6, penalty=0.0), decontaminate.Search(hold=1)])
def test_contamination_with_all_edits(spark, search):
    """Words put in, replaced and left out, up to the score's limit and beyond; no
    pair that brute force finds is lost."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 12, 20, 30]))] for _ in range(40)] + [["same"] * 9, ["same", "other"] * 4]
    docs = []
    for d in range(240):
        w = list(r.choice(items))
        for _ in range(r.randrange(len(w) + 2) if d % 2 else 0):  # put in, up to one in every gap
            w.insert(r.randrange(len(w) + 1), r.choice(["new", r.choice(vocabulary)]))
        for _ in range(r.randrange(len(w) // 2 + 1) if d % 3 else 0):
            w[r.randrange(len(w))] = "other"
        for _ in range(r.randrange(len(w) // 2 + 1) if d % 5 == 0 else 0):
            del w[r.randrange(len(w))]
        docs.append((d, " ".join([r.choice(vocabulary) for _ in range(12)] + w + [r.choice(vocabulary) for _ in range(12)])))
    for k, item in enumerate(items):  # a word in every gap
        docs.append((1000 + k, " new ".join(item)))
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(d, t, search).collect()}
    want = brute_contamination(docs, items, search)
    assert got == pytest.approx(want) and len(want) > 200


def test_alignment_against_a_table():
    def brute(a, b, p):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -p), h[i - 1, j] - p, h[i, j - 1] - p)
        return h.max()

    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (r.integers(0, 4, r.integers(1, 14)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b, 0.5) == pytest.approx(brute(a, b, 0.5))


# mixing


def brute_mix(rows, o):
    leaf = Counter()
    for _, k, n in rows:
        leaf[k] += n

    def fill(goal, members):
        if not any(w > 0 for _, w in members.values()):
            members = {k: (c, 1.0) for k, (c, _) in members.items()}
        got, left = dict.fromkeys(members, 0.0), goal
        todo = {k for k, (_, w) in members.items() if w > 0}
        while todo:
            level = left / sum(members[k][1] for k in todo)
            full = [k for k in todo if members[k][0] <= level * members[k][1]]
            if not full:
                for k in todo:
                    got[k] = level * members[k][1]
                return got
            for k in full:
                got[k], left = members[k][0], left - members[k][0]
            todo -= set(full)
        spare = {k: c for k, (c, w) in members.items() if w <= 0}
        if sum(spare.values()) and left > 0:
            got |= {k: min(1, left / sum(spare.values())) * c for k, c in spare.items()}
        return got

    def down(prefix, goal):
        depth = len(prefix)
        if depth == 3:
            return {prefix: min(math.ceil(goal), leaf[prefix] * o.epochs)}
        names = {k[depth] for k in leaf if k[:depth] == prefix}
        members = {n: (sum(v for k, v in leaf.items() if k[: depth + 1] == (*prefix, n)) * o.epochs, max(0.0, o.weights.get(mixing.LEVELS[depth], {}).get(n, o.default))) for n in names}
        return {k: v for n, g in fill(goal, members).items() for k, v in down((*prefix, n), g).items()}

    out = set()
    for k, budget in down((), sum(leaf.values()) * o.share).items():
        for e in range(o.epochs):
            left, so_far = budget - e * leaf[k], 0
            if left <= 0 and not (leaf[k] == 0 and e == 0):
                break
            own = sorted((int(hashlib.md5(f"{o.seed}:{e}:{d}".encode()).hexdigest()[:15], 16), d, n) for d, kk, n in rows if kk == k)
            for _, d, n in own:
                if so_far < left or left >= leaf[k]:
                    out.add((d, e))
                so_far += n
    return out


@pytest.mark.parametrize("o", [mixing.Mix(), mixing.Mix(share=0.8, epochs=2, weights={"lang": {"en": 1, "es": 3, "fr": 0}}), mixing.Mix(share=1.7, epochs=2, range_rows=9), mixing.Mix(share=0.05, weights={"domain": {"d0": 5}})])
def test_mixing(spark, sf, o):
    docs = sample(spark, sf).withColumn("lang", F.when(F.col("doc_id") % 20 == 1, None).otherwise(F.col("lang")))
    for d in (docs, awkward(spark).filter("doc_id is not null"), empty(spark)):
        rows = [(r.doc_id, (r.a, r.b, r.c), r.n) for r in d.select("doc_id", mixing.domain_of(F.coalesce("source", F.lit(""))).alias("a"), F.coalesce("lang", F.lit("")).alias("b"), F.coalesce("source", F.lit("")).alias("c"), mixing.tokens_of(F.col("text")).alias("n")).collect()]
        assert all(n == len(words(t)) for (_, _, n), t in zip(rows, [r.text for r in d.select("text").collect()]))
        got = mixing.mix(d, o)
        assert got.columns[: len(d.columns)] == d.columns
        assert sorted((r.doc_id, r.mix_epoch) for r in got.collect()) == sorted(brute_mix(rows, o))
