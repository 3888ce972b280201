"""Compressing vectors to one code a part, with integer codebooks and vantage trees.

Components become integers, vectors are cut into parts, and each part position has a
codebook that a few rounds improve: every part goes to its nearest entry, and an
entry becomes the floored mean of its parts. The nearest entry comes from a
vantage-point tree over the codebook: a branch is left out only where the triangle
inequality puts all its entries farther off than the best one so far. Radii and
distances are rounded outwards to integers, a branch on the limit is visited, and
entries are compared by their integer squared distances, ties to the lower index, so
the codes are those of an exhaustive search.

Vectors are written once as integers. A round is one scan of them: tasks sum the parts
of each entry and ship at most a row an entry, and the codebooks (parts * entries *
components, whatever the number of rows) go to the driver and back.

Defined results: rows are left out whose vector is null or holds null or non-finite
components, whose length is no multiple of the number of parts (0 included) or
differs from that of the smallest id, or whose id is null. Repeated ids count as rows
of their own, in the order of their components. With fewer rows than entries the
codebooks have as many entries as there are rows. An empty table gives an empty
result and empty codebooks. Integers beyond LARGEST are an error, since squared
distances would not fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, near

LARGEST = 1 << 25
#: Entries of a leaf at most, and rows that visit a tree together.
LEAF, ROWS = 16, 4096
_FAR = np.iinfo(np.int64).max


def _root(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at or below and at or above the square roots."""
    r = np.sqrt(squared.astype(np.float64))
    return np.maximum(np.floor(r).astype(np.int64) - 1, 0), np.ceil(r).astype(np.int64) + 1


class Branch(NamedTuple):
    node: object  # Node, or the entries of a leaf
    least: int  # distances of its entries from the vantage point
    most: int


class Node(NamedTuple):
    vantage: int
    near: Branch
    far: Branch


class Tree:
    """A vantage-point tree over the entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.squares = (self.entries**2).sum(axis=1)
        self.node = self._grow(np.arange(len(entries)))

    def _grow(self, at: np.ndarray):
        if len(at) <= LEAF:
            return np.sort(at)
        vantage, rest = at[0], at[1:]
        d = ((self.entries[rest] - self.entries[vantage]) ** 2).sum(axis=1)
        order = np.argsort(d, kind="stable")
        halves = np.array_split(order, 2)
        return Node(int(vantage), *(Branch(self._grow(rest[h]), int(_root(d[h].min())[0]), int(_root(d[h].max())[1])) for h in halves))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of int64 parts."""
        found = [self._search(parts[i : i + ROWS]) for i in range(0, len(parts), ROWS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, best, squares = np.full(len(x), len(self.entries)), np.full(len(x), _FAR), (x**2).sum(axis=1)

        def offer(rows, entry, d):
            better = (d < best[rows]) | ((d == best[rows]) & (entry < who[rows]))
            rows = rows[better]
            best[rows], who[rows] = d[better], entry[better] if np.ndim(entry) else entry

        def visit(node, rows):
            if not len(rows):
                return
            if not isinstance(node, Node):
                d = squares[rows, None] + self.squares[node] - 2 * (x[rows] @ self.entries[node].T)
                low = d.argmin(axis=1)  # the first, so the lowest index
                return offer(rows, node[low], d[np.arange(len(rows)), low])
            d = squares[rows] + self.squares[node.vantage] - 2 * (x[rows] @ self.entries[node.vantage])
            offer(rows, node.vantage, d)
            below, above = _root(d)
            bound = [np.maximum(np.maximum(b.least - above, below - b.most), 0) ** 2 for b in (node.near, node.far)]
            first = bound[0] <= bound[1]
            for branch, limit, mine in ((node.near, bound[0], first), (node.far, bound[1], ~first), (node.far, bound[1], first), (node.near, bound[0], ~first)):
                at = np.flatnonzero(mine)
                visit(branch.node, rows[at][limit[at] <= best[rows[at]]])

        visit(self.node, np.arange(len(x)))
        return who, best


def integers(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """vec_id, label, v: the rows that count, components as floored integers."""
    d = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter((F.size("e") > 0) & (F.size("e") % parts == 0) & F.coalesce(finite, F.lit(False)))
    low = lambda x: F.floor(x * float(scale))
    fits = lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST / scale}")).cast("int"))
    return d.select("vec_id", "label", F.transform("e", lambda x: fits(low(x))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _nearest(trees: list[Tree], x: np.ndarray):
    width = x.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        part = x[:, p * width : (p + 1) * width]
        yield p, part, *tree.nearest(part)


def improved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round."""
    trees = [Tree(c) for c in codebooks]

    def run(batches):
        total, n = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for b in batches:
            if b.num_rows:
                for p, part, who, _ in _nearest(trees, _matrix(b.column(0))):
                    np.add.at(total[p], who, part)
                    n[p] += np.bincount(who, minlength=n.shape[1])
        p, e = np.nonzero(n)
        sums = pa.array(list(total[p, e]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), sums], names=["part", "entry", "n", "sums"])

    each = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    new = codebooks.copy()
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        new[r.part, r.entry, r["at"]] = r.x // r.n
    return new


def coded(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an entry for each part) and error, their squared
    distances together."""
    trees = [Tree(c) for c in codebooks]

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = [(who, d) for _, _, who, d in _nearest(trees, _matrix(b.column(2)))]
                codes = pa.array(list(np.stack([w for w, _ in found], axis=1)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(sum(d for _, d in found))], names=["vec_id", "label", "codes", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) for the rows of ``vectors`` (vec_id, embedding,
    label) that count, and the codebooks (part, entry, component)."""
    scratch = Scratch(vectors.sparkSession, "codes")
    ints = scratch.table(integers(vectors, scale, parts))
    head = ints.orderBy("vec_id", "v").limit(1).collect()
    if not head:
        return ints.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    rows = ints.filter(F.size("v") == len(head[0].v))
    first = rows.orderBy("vec_id", "v").select("v").limit(entries).collect()
    codebooks = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        codebooks = improved(rows, codebooks)
    out = scratch.table(coded(rows, codebooks))
    scratch.drop(ints)
    return out, codebooks


def decoded(codes: list[int], codebooks: np.ndarray) -> np.ndarray:
    """The integers that stand for a vector of these codes."""
    return np.concatenate([codebooks[p, c] for p, c in enumerate(codes)])


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (the errors of all rows
    with an equal label, nulls together) and a digest of the final codebooks."""
    out, codebooks = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    by_label = near(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    joined = out.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
