"""SimHash near-duplicates by an inverted index over byte positions.

1. A document's fingerprint has 64 bits; a bit is set if it is set in over half of
   the hashes of its word shingles. Documents with the same fingerprint collapse to
   the smallest id first, so groups of copies cost one row each.
2. Fingerprints that differ in at most ``bits`` bits share at least 8 - ``bits`` of
   their 8 bytes at equal positions, the guaranteed minimum of matches. Postings of
   one byte would each hold a 256th of all fingerprints, so the index keeps postings
   of several positions at once: sets of positions of which every possible choice of
   the guaranteed matches contains one (20 sets of three positions for 4 bits).
3. In each posting the shared positional bytes of a pair are tallied; pairs that
   reach the minimum are verified by the population count of their XOR. First each
   member meets its posting's smallest id; postings whose members are in several
   components after that are compared in blocks, members of different components
   only. So no link is lost to the choice of centres, and a large group never
   expands into all its pairs.
4. Components come from hooking and pointer jumping over DataFrames.

Defined results: null and empty texts and those without words have the fingerprint
zero, which links like any other. Fewer words than a shingle has are one shingle. Long
texts are read in pieces of about a megabyte. Repeated rows of an id count once (the
smallest fingerprint as a signed number stays). An empty table gives an empty result.
Documents with a null id are left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .neardup import components, in_blocks
from .scratch import Scratch
from .textbytes import U64, sliced

SHINGLE, SEED, POSITIONS = 4, 42, 8
#: Bytes of a text whose words are held at once, about.
BLOCK = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingles(text: bytes, k: int) -> Iterator[list[bytes]]:
    """The shingles of a text in lists; the last k - 1 words of a list begin the next."""
    text, lo, words, none = text.translate(_LOWER), 0, [], True
    while lo < len(text):
        hi = min(len(text), lo + BLOCK)
        while hi < len(text) and not text[hi : hi + 1].isspace():
            step = text[hi : hi + 4096].split(None, 1)[0]
            hi += len(step)
        words += text[lo:hi].split()
        lo = hi
        if len(words) >= k:
            yield list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
            words, none = words[len(words) - k + 1 :], False
    if none and words:
        yield [b" ".join(words)]


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64 bits: the majority of the shingles' XXH64, repeats included."""
    ones, n = np.zeros(64, np.int64), 0
    for shingles in _shingles(text, k):
        h = np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n).view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            whole = data.tobytes()
            fp = [fingerprint(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def position_sets(matches: int, size: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions of which every set of ``matches`` positions
    contains one. Three positions of four matches: the positions stand in three
    parts in a circle, and a set lies in one part, or two of it in a part and one in
    the next; four positions always have such three. Else all sets of the size."""
    size = min(size, matches)
    every = list(combinations(range(POSITIONS), size))
    if (matches, size) != (4, 3):
        return every
    part = lambda i: i * 3 // POSITIONS
    return [s for s in every if (n := [sum(part(i) == p for i in s) for p in range(3)]) and (3 in n or any(n[p] == 2 and n[(p + 1) % 3] == 1 for p in range(3)))]


def _masks(matches: int, size: int) -> list[int]:
    return [int.from_bytes(bytes(255 if i in s else 0 for i in range(POSITIONS)), "little", signed=True) for s in position_sets(matches, size)]


def shared_bytes(x: Column, y: Column) -> Column:
    """Number of positions at which two fingerprints have the same byte."""
    differ = x.bitwiseXOR(y)
    return sum((F.when(F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(POSITIONS)), F.lit(0))


def _links(blocks: DataFrame, bits: int) -> DataFrame:
    """Links between members of different components in each pair of blocks, as
    many as join them."""
    matches = POSITIONS - bits

    def run(t: pa.Table) -> pa.Table:
        doc, root, fp = (t.column(c).to_numpy() for c in ("doc_id", "root", "fp"))
        fp, u, v = fp.view(U64), [], []
        at = fp.view(np.uint8).reshape(-1, POSITIONS)
        up = {int(r): int(r) for r in root}

        def top(r):
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        for a in range(len(doc) - 1):
            tally = (at[a + 1 :] == at[a]).sum(axis=1)
            some = a + 1 + np.flatnonzero((tally >= matches) & (root[a + 1 :] != root[a]))
            for b in some[np.bitwise_count(fp[some] ^ fp[a]) <= bits]:
                x, y = top(int(root[a])), top(int(root[b]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    u.append(int(doc[a]))
                    v.append(int(doc[b]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return blocks.groupBy("i", "key", "a", "b").applyInArrow(run, "u long, v long")


def near_fingerprints(docs: DataFrame, bits: int = 4, size: int = 3, block: int = 256) -> DataFrame:
    """doc_id, fp, component_id for every document id of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    return groups(fingerprints(docs), bits, size, block)


def groups(fps: DataFrame, bits: int = 4, size: int = 3, block: int = 256) -> DataFrame:
    """doc_id, fp, component_id for every id of ``fps`` (doc_id, fp); see the
    module's text. ``size``: positions of a posting; more of them make shorter
    postings and more of these a fingerprint (four: 70), with equal results."""
    if not 0 <= bits < POSITIONS:
        raise ValueError("a link guarantees no shared byte")
    scratch, matches = Scratch(fps.sparkSession, "simhash"), POSITIONS - bits
    fps = scratch.table(fps.groupBy("doc_id").agg(F.min("fp").alias("fp")))
    same = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))

    postings = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(matches, size)]))
    keyed = same.select(F.col("rep").alias("doc_id"), "fp", postings.alias("i", "key"))
    shared = keyed.groupBy("i", "key").agg(F.min(F.struct("doc_id", "fp")).alias("center"), F.count("*").alias("c")).filter("c > 1")
    member = scratch.table(keyed.join(shared, ["i", "key"]))  # of postings with several members
    reach = (shared_bytes(F.col("fp"), F.col("center.fp")) >= matches) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("center.fp"))) <= bits)
    edges = scratch.table(member.filter((F.col("doc_id") != F.col("center.doc_id")) & reach).select(F.col("center.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct())
    root = components(edges, scratch)

    left = member.filter("c > 2").select("i", "key", "doc_id", "fp").join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    blocks = scratch.table(in_blocks(left, block, ["fp"]))
    more = scratch.table(_links(blocks, bits))
    if not more.isEmpty():
        old, root = root, components(edges.unionByName(more), scratch)
        if hasattr(old, "scratch_path"):
            scratch.drop(old)

    # a component's root is its smallest representative, and that the smallest of its copies
    of_fp = same.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = scratch.table(fps.join(of_fp, "fp").select("doc_id", "fp", "component_id"))
    scratch.drop(fps, same, member, edges, blocks, more, *([root] if hasattr(root, "scratch_path") else []))
    return out


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
