"""Near-duplicate groups: banded MinHash candidates, odd sketches, exact links.

1. Each document's set of distinct word shingles becomes MinHash samples. Some
   samples form bands (candidate keys); all of them are folded into an odd
   sketch: sample i flips one bit, so the population count of the XOR of two
   sketches estimates how many samples differ, and with that the similarity.
2. Documents with the same set collapse to the smallest id first, so groups of
   exact copies cost one row each.
3. In each band the members are paired with the band's smallest id. Pairs whose
   sketches allow the wanted similarity are confirmed on full sets; the pairs of
   an id that is the smallest of very many are dealt to several tasks. Last, bands
   whose members still are in several components are compared across components,
   first by sketches alone, then by the full sets of those documents that have a
   partner left; so no link between different texts is lost to the choice of
   centres, and a large group never expands into all its pairs.
4. Components come from hooking and pointer jumping over DataFrames.

Bands are as many as leave a pair of just the wanted similarity without a common
one with a probability of 4e-7 (20 for 0.85, 28 for 0.8).

Defined results: null and empty texts and texts without words have no shingle
and link with nothing. Repeated rows of a document id count once (the text with the
smallest fingerprint stays). An empty table gives an empty result. Other columns
are ignored. Documents with a null id are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, near
from .textbytes import LOWER, U64, grams, lists, mix, release, runs, sliced, words

SAMPLES, ROWS, BITS, SHINGLE, MISSED = 128, 4, 512, 5, 4e-7
#: Standard errors below the wanted similarity down to which a sketch still allows it.
MARGIN = 4.5
#: Pairs of one centre in a task, about.
DEALT = 512


def bands_for(percent: int) -> int:
    s = min(max(percent / 100, 0.01), 0.999)
    return min(SAMPLES // ROWS, math.ceil(math.log(MISSED) / math.log1p(-(s**ROWS)) - 1e-6))


_A = mix(np.arange(1001, 1001 + SAMPLES, dtype=U64)) | U64(1)
_B = mix(np.arange(5001, 5001 + SAMPLES, dtype=U64))


def shingle_sets(data, offsets, rows, k=SHINGLE):
    """The sorted distinct shingle hashes of each row of one slice."""
    w = words(LOWER[data], offsets)
    first = runs(w.doc, rows)
    every = grams(w.hash, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix(grams(w.hash[a:b], int(b - a)) + U64(int(b - a)))
        else:
            yield np.zeros(0, U64)


def _samples(s: np.ndarray) -> np.ndarray:
    low = None
    for i in range(0, len(s), 4096):
        v = ((s[i : i + 4096][None, :] ^ _B[:, None]) * _A[:, None]).min(axis=1)
        low = v if low is None else np.minimum(low, v)
    return low


_WEIGHTS = mix(np.arange(9001, 9001 + SAMPLES, dtype=U64)) | U64(1)


def _bands(v: np.ndarray, bands: int) -> np.ndarray:
    use = v[: bands * ROWS] * _WEIGHTS[: bands * ROWS]
    return mix(use.reshape(bands, ROWS).sum(axis=1, dtype=U64) + np.arange(bands, dtype=U64))


def _odd(v: np.ndarray) -> np.ndarray:
    at = (mix(v + np.arange(SAMPLES, dtype=U64) * U64(0x9E3779B97F4A7C15)) % U64(BITS)).astype(np.int64)
    parity = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(U64)


def sketches(docs: DataFrame, bands_of: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (fingerprint of the set), bands, odd."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            n, one, two, bands, odd = [], [], [], [], []
            for s in shingle_sets(data, offsets, rows.num_rows):
                n.append(len(s))
                one.append(int(mix(s).sum(dtype=U64)))
                two.append(int(mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64)))
                if len(s):
                    v = _samples(s)
                    bands.append(_bands(v, bands_of))
                    odd.append(_odd(v))
                else:
                    bands.append(np.zeros(0, U64))
                    odd.append(np.zeros(0, U64))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, U64).view(np.int64)),
                    pa.array(np.array(two, U64).view(np.int64)),
                    lists(np.concatenate(bands).view(np.int64), [len(x) for x in bands], pa.int64()),
                    lists(np.concatenate(odd).view(np.int64), [len(x) for x in odd], pa.int64()),
                ],
                names=["doc_id", "n", "s1", "s2", "bands", "odd"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>, odd array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, s1 as in ``sketches``, and the sorted shingle hashes as bytes."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            sets = list(shingle_sets(data, offsets, rows.num_rows))
            one = np.array([int(mix(s).sum(dtype=U64)) for s in sets], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(one), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s1", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s1 long, hashes binary")


def differing_bits(x, y):
    """Population count of the XOR of two odd sketches, as a Column."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return out


def most_bits(similarity: float) -> int:
    """Bits that the sketches of documents this similar differ in at most,
    but for MARGIN standard errors. A sample differs with probability 1 - J."""
    d = 1 - similarity
    samples = SAMPLES * d + MARGIN * math.sqrt(SAMPLES * d * similarity)
    flips = 2 * min(samples, SAMPLES)
    odd = BITS / 2 * (1 - (1 - 2 / BITS) ** flips)
    return math.ceil(odd + MARGIN * math.sqrt(odd * (1 - odd / BITS)) * 0.5)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _dealt(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, part): the pairs of a frequent u in several parts. Frequent ones are
    at most one in DEALT pairs."""
    hot = scratch.table(pairs.groupBy("u").agg(F.ceil(F.count("*") / DEALT).alias("parts")).filter("parts > 1"))
    return pairs.join(near(hot), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("part"))


def _with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (u, v, part) with the columns that ``of`` (doc_id, ...) has for both
    ends, named with u and v at the end. The centre's come once for each part."""
    mine = lambda end: of.select(F.col("doc_id").alias(end), *[F.col(c).alias(c + end) for c in of.columns if c != "doc_id"])
    centers = pairs.select("u", "part").distinct().join(mine("u"), "u")
    return pairs.join(mine("v"), "v").join(centers, ["u", "part"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, part) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        release()

    return _with_both(pairs, sets).select("u", "v", "hashesu", "hashesv").mapInArrow(run, "u long, v long")


def in_blocks(members: DataFrame, block: int, carried: list[str]) -> DataFrame:
    """Deals the members (i, key, doc_id, root, and what is carried) of bands that
    hold several components to pairs of blocks of about ``block`` rows. Members of a
    band's largest component meet only the other members, never each other."""
    of = members.groupBy("i", "key", "root").agg(F.count("*").alias("m"))
    of = of.groupBy("i", "key").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.max("m").alias("g"), F.sum("m").alias("all"), F.count("*").alias("roots")).filter("roots > 1 and all > 2")
    x = members.join(of, ["i", "key"])
    x = x.withColumn("gs", F.ceil(F.col("g") / block)).withColumn("ss", F.ceil((F.col("all") - F.col("g")) / block)).withColumn("giant", F.col("root") == F.col("top"))
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("giant"), F.col("gs")).otherwise(F.col("ss")))
    x = x.withColumn("mine", mine)
    # blocks of the rest: pairs (a, b) with a <= b; of the giant: (a, ss + j)
    straight = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ss") + F.col("gs") - 1), lambda j: F.struct(F.least("mine", j).alias("a"), F.greatest("mine", j).alias("b")))
    giant = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ss") - 1), lambda j: F.struct(j.alias("a"), (F.col("ss") + F.col("mine")).alias("b")))
    x = x.withColumn("to", F.explode(F.when(F.col("giant"), giant).otherwise(straight)))
    return x.select("i", "key", "to.a", "to.b", "doc_id", "root", *carried)


class _Group:
    """The members of two blocks in a task: which of them may be linked."""

    def __init__(self, t: pa.Table, percent: int, bits: int):
        rows = t.num_rows
        self.doc, self.root, self.n = (t.column(c).to_numpy() for c in ("doc_id", "root", "n"))
        self.odd = t.column("odd").combine_chunks().flatten().to_numpy().view(U64).reshape(rows, BITS // 64)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(rows, -1)
        self.band, self.percent, self.bits = t.column("i")[0].as_py(), percent, bits

    def partners(self, a: int) -> np.ndarray:
        """Later members that size, sketch and component let be linked with ``a``."""
        rest = slice(a + 1, len(self.doc))
        small, large = np.minimum(self.n[a], self.n[rest]), np.maximum(self.n[a], self.n[rest])
        fit = (self.root[rest] != self.root[a]) & (100 * small >= self.percent * large)
        fit &= np.bitwise_count(self.odd[a] ^ self.odd[rest]).sum(axis=1) <= self.bits
        if self.band:  # an earlier band that both share has compared them
            fit &= ~(self.bands[rest, : self.band] == self.bands[a, : self.band]).any(axis=1)
        return np.flatnonzero(fit) + a + 1


def _hopeful(blocks: DataFrame, percent: int, bits: int) -> DataFrame:
    """(i, key, a, b, doc_id) of the members with a partner in their pair of blocks."""

    def run(t: pa.Table) -> pa.Table:
        g, some = _Group(t, percent, bits), np.zeros(t.num_rows, bool)
        for a in range(t.num_rows - 1):
            at = g.partners(a)
            some[at] = True
            some[a] |= len(at) > 0
        return t.select(["i", "key", "a", "b", "doc_id"]).filter(pa.array(some))

    return blocks.groupBy("i", "key", "a", "b").applyInArrow(run, "i int, key long, a long, b long, doc_id long")


def _links(blocks: DataFrame, percent: int, bits: int) -> DataFrame:
    """Links between members of different components within each pair of blocks."""

    def run(t: pa.Table) -> pa.Table:
        u, v, g = [], [], _Group(t, percent, bits)
        sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("hashes")]
        up = {int(r): int(r) for r in g.root}

        def top(r):
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        for a in range(t.num_rows - 1):
            for b in g.partners(a):
                x, y = top(int(g.root[a])), top(int(g.root[b]))
                if x != y and similar(sets[a], sets[b], percent):
                    up[max(x, y)] = min(x, y)
                    u.append(int(g.doc[a]))
                    v.append(int(g.doc[b]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return blocks.groupBy("i", "key", "a", "b").applyInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v): each root is the smallest
    node that can be reached. Roots hook onto their smallest neighbouring root,
    pointers double until they are stable, edges shrink to those between roots."""
    e, done = scratch.table(edges.select("u", "v").filter("u <> v")), None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            up = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
            q = scratch.table(p.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            scratch.drop(p)
            p = q
            if p.filter("moved").isEmpty():
                break
        hop = p.select("node", "root")
        if done is None:
            done, old = scratch.table(hop), None
        else:
            old = done
            done = scratch.table(
                old.join(hop.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            )
        u, v = hop.select(F.col("node").alias("u"), F.col("root").alias("ru")), hop.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        nxt = scratch.table(e.join(u, "u").join(v, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        scratch.drop(e, q)
        if old is not None:
            scratch.drop(old)
        e = nxt
    return done if done is not None else edges.sparkSession.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document id of ``docs``
    (doc_id, text); see the module's text. ``percent``: a link needs
    100 * intersection >= percent * union of the shingle sets."""
    spark, bits = docs.sparkSession, most_bits(percent / 100)
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    one = Window.partitionBy("doc_id").orderBy("s1", "s2")
    raw = scratch.table(sketches(docs, bands_for(percent)))
    sk = scratch.table(raw.withColumn("r", F.row_number().over(one)).filter("r = 1").drop("r"))
    same = scratch.table(sk.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))

    reps = sk.join(same.select(F.col("rep").alias("doc_id")), "doc_id")
    keyed = reps.select("doc_id", F.posexplode("bands").alias("i", "key"))
    shared = keyed.groupBy("i", "key").agg(F.min("doc_id").alias("center"), F.count("*").alias("c")).filter("c > 1")
    member = scratch.table(keyed.join(shared, ["i", "key"]))  # of bands with several members
    every = scratch.table(member.filter("doc_id <> center").select(F.col("center").alias("u"), F.col("doc_id").alias("v")).distinct())
    allowed = F.expr(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)") & (differing_bits(F.col("oddu"), F.col("oddv")) <= bits)
    pairs = scratch.table(_with_both(_dealt(every, scratch), reps.select("doc_id", "n", "odd")).filter(allowed).select("u", "v", "part"))

    some = member.select("doc_id").distinct().join(sk.select("doc_id", "s1"), "doc_id")
    sets = docs.join(some.select("doc_id"), "doc_id", "left_semi")
    sets = scratch.table(full_sets(sets).join(some, ["doc_id", "s1"]).dropDuplicates(["doc_id"]).select("doc_id", "hashes"))

    edges = scratch.table(_confirmed(pairs, sets, percent))
    root = components(edges, scratch)
    left = member.select("i", "key", "doc_id").join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    several = left.groupBy("i", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo < hi and c > 2").select("i", "key")
    about = reps.select("doc_id", "n", "bands", "odd")
    blocks = scratch.table(in_blocks(left.join(several, ["i", "key"]).join(about, "doc_id"), block, ["n", "bands", "odd"]))
    # sets go only where sketches leave a partner
    more = scratch.table(_links(_hopeful(blocks, percent, bits).join(blocks, ["i", "key", "a", "b", "doc_id"]).join(sets, "doc_id"), percent, bits))
    if not more.isEmpty():
        old, root = root, components(edges.unionByName(more), scratch)
        if hasattr(old, "scratch_path"):
            scratch.drop(old)

    of_rep = scratch.table(same.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("component_id")))
    # a component's root is the smallest representative, and that the smallest of its copies
    out = scratch.table(
        sk.select("doc_id", "n", "s1", "s2")
        .join(of_rep, ["s1", "s2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
    scratch.drop(raw, sk, same, member, every, pairs, sets, edges, blocks, more, of_rep, *([root] if hasattr(root, "scratch_path") else []))
    return out
