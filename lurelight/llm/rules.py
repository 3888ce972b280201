"""Quality rules: text statistics, fixed limits, and an isolation forest.

The statistics of every text are exact. Texts that the fixed limits pass get an
anomaly score: mean path lengths over trees of random splits on all statistics
together, each tree grown on ``tree_rows`` rows drawn by the hash of their id, so
that texts unlike the others end in short paths. Most statistics say nothing about
quality, and splits on them hide the others, so a split takes a statistic in
proportion to the square root of how far it separates the labelled rows of the two
classes (squared distance of the means over the sum of the variances, over all
such rows).

The limit is calibrated on labelled rows that pass the fixed limits: the lowest
score that at most ``clean_loss`` of the clean rows (labels.quality = 1) exceed. It
is used if it rejects ``pays`` times as large a share of the bad rows as of the
clean ones. A fold of the labelled rows (``apart``) takes no part in any of this;
``outcome`` tells what is rejected there.

Defined results: null, empty and blank texts have no words and fail. Without
clean or without bad labelled rows nothing is rejected by its score. Repeated ids
are judged row by row; an id labelled twice counts as clean if one of its rows
says so. An empty table gives an empty result. Other columns are ignored.
Documents with a null id are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbytes import U64, grams, mix, runs, segment_hashes, sliced, words

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UPPER, DIGIT, PUNCTUATION = (np.zeros(256, np.int64) for _ in range(3))
UPPER[65:91], DIGIT[48:58] = 1, 1
PUNCTUATION[list(b"!\"'(),-./:;?@[]_{}")] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_punctuation"]


@dataclass
class Forest:
    """``trees`` grown on ``tree_rows`` rows each; ``clean_loss``: share of the
    labelled clean rows that the limit may reject."""

    trees: int = 100
    tree_rows: int = 256
    clean_loss: float = 0.005
    pays: float = 5.0
    #: One labelled id in so many takes no part in weights and limit.
    apart: int = 4
    seed: int = 11


def _per_row(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[data])])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes of each row."""
    key = np.unique(np.stack([doc.astype(U64), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), U64)
    return np.bincount(key[:, 0].astype(np.int64), minlength=rows)


def counts(data: np.ndarray, offsets: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    w = words(data, offsets)
    first = runs(w.doc, rows)
    head = np.where((np.arange(256) & 0xC0) == 0x80, 0, 1)
    head[[0x20, 9, 10, 11, 12, 13]] = 0
    # lines with a word: those in which a word starts
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, w.start)
    new = np.ones(len(w.start), bool)
    new[1:] = (line_of[1:] != line_of[:-1]) | (w.doc[1:] != w.doc[:-1])
    at, doc = line_of[new], w.doc[new]
    begin = np.maximum(np.concatenate([[0], breaks + 1])[at], offsets[doc]) if len(at) else at
    end = np.minimum(np.append(breaks, len(data))[at], offsets[doc + 1]) if len(at) else at
    lines = np.bincount(doc, minlength=rows)
    dup = lines - _distinct(doc, segment_hashes(data, begin, end), rows)
    repeated = np.zeros(len(w.doc) + 1, np.int64)
    g = grams(w.hash, 3)
    if len(g):
        inside = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        key = g[inside] ^ mix(w.doc[inside].astype(U64) + U64(1))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        hit = inside[n[inverse] > 1]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated[:-1]) > 0)])
    return {
        "n_words": np.diff(first),
        "word_chars": _per_row(head, data, offsets),
        "n_symbols": _per_row(SYMBOLS, data, offsets),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
        "n_distinct_words": _distinct(w.doc, w.hash, rows),
        "n_upper": _per_row(UPPER, data, offsets),
        "n_digits": _per_row(DIGIT, data, offsets),
        "n_punctuation": _per_row(PUNCTUATION, data, offsets),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            c = counts(data, offsets, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c[k].astype(np.int64)) for k in COUNTS]], names=["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumn(
        "base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    )


#: The statistics that the forests split on.
FEATURES = ["length", "word_length", "symbols", "duplicate_lines", "repeated_words", "distinct_words", "line_length", "upper_case", "digits", "punctuation"]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    n, lines = np.maximum(c["n_words"], 1).astype(float), np.maximum(c["n_lines"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    return np.stack(
        [
            np.log2(n),
            chars / n,
            c["n_symbols"] / n,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / n,
            c["n_distinct_words"] / np.sqrt(n),
            np.log2(n / lines),
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_punctuation"] / n,
        ],
        axis=1,
    )


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649 if n > 2 else 0.5) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold or path length, left child; the right one follows)."""
    feature, value, left = [], [], []

    def add():
        feature.append(-1), value.append(0.0), left.append(0)
        return len(feature) - 1

    todo = [(add(), np.arange(len(x)), 0)]
    while todo:
        at, rows, d = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        chance = (hi > lo) * weights
        if d >= depth or not chance.any():
            value[at] = d + _expected(len(rows))
            continue
        f = rng.choice(len(chance), p=chance / chance.sum())
        cut = rng.uniform(lo[f], hi[f])
        below = x[rows, f] <= cut
        a, b = add(), add()
        feature[at], value[at], left[at] = int(f), cut, a
        todo += [(a, rows[below], d + 1), (b, rows[~below], d + 1)]
    return np.array(feature), np.array(value), np.array(left)


def grow_forest(x: np.ndarray, options: Forest, trees: int, weights: np.ndarray | None = None) -> list:
    """Trees whose splits take features by their weights, alike if there are none."""
    weights = np.ones(x.shape[1]) if weights is None else weights
    rng = np.random.default_rng(options.seed)
    rows = min(options.tree_rows, len(x))
    depth = max(1, math.ceil(math.log2(max(2, rows))))
    return [grow(x[rng.choice(len(x), rows, replace=False)], rng, depth, weights) for _ in range(trees)] if len(x) else []


def anomaly(x: np.ndarray, forest: list, tree_rows: int) -> np.ndarray:
    """2 ** (-mean path / expected path) of each row."""
    total = np.zeros(len(x))
    for feature, value, left in forest:
        at = np.zeros(len(x), np.int64)
        while (open_ := feature[at] >= 0).any():
            i = np.flatnonzero(open_)
            a = at[i]
            at[i] = left[a] + (x[i, feature[a]] > value[a])
        total += value[at]
    return 2.0 ** (-total / max(1, len(forest)) / max(_expected(tree_rows), 1e-9)) if forest else np.full(len(x), 0.5)


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1), once for each id."""
    return labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))


def _apart(o: Forest):
    return F.pmod(F.xxhash64(F.lit(o.seed + 1), F.col("doc_id")), F.lit(o.apart)) == 0


def _features_of(b: pa.RecordBatch) -> np.ndarray:
    return features({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in COUNTS})


def separation(known: DataFrame) -> np.ndarray | None:
    """Weight of each statistic from ``known`` (quality, counts); null without
    rows of both classes or where nothing separates them."""

    def run(batches):
        for b in batches:
            x = _features_of(b)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("quality")), *map(pa.array, x.T)], names=["quality", *FEATURES])

    kind = known.schema["quality"].dataType.simpleString()
    rows = known.select("quality", *COUNTS).mapInArrow(run, ", ".join([f"quality {kind}", *(f"{f} double" for f in FEATURES)]))
    by = {r["quality"]: r for r in rows.groupBy("quality").agg(*[F.struct(F.avg(f), F.var_pop(f)).alias(f) for f in FEATURES]).collect()}  # two rows
    if set(by) != {0, 1}:
        return None
    weights = np.sqrt([(by[0][f][0] - by[1][f][0]) ** 2 / (by[0][f][1] + by[1][f][1] + 1e-12) for f in FEATURES])
    return weights if weights.any() else None


def calibrated(known: DataFrame, o: Forest) -> float:
    """The limit over ``known`` (quality, anomaly); 1, which no score exceeds,
    where it does not pay or a class is missing."""
    limit = known.filter("quality = 1").agg(F.percentile_approx("anomaly", 1 - o.clean_loss, 10000)).first()[0]
    if limit is None:
        return 1.0
    share = {r["quality"]: r["over"] for r in known.groupBy("quality").agg(F.avg((F.col("anomaly") > limit).cast("int")).alias("over")).collect()}  # two rows
    return limit if share.get(0) and share[0] >= o.pays * share[1] else 1.0


def outcome(judged: DataFrame, labels: DataFrame, options: Forest | None = None) -> DataFrame:
    """quality, rows and rejected of the labelled rows that the fixed limits pass
    and that took no part in the calibration."""
    known = judged.filter("not base_failed").join(_labelled(labels).filter(_apart(options or Forest())), "doc_id")
    return known.groupBy("quality").agg(F.count("*").alias("rows"), F.count_if(~F.col("kept")).alias("rejected"))


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, options: Forest | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept of each row."""
    o = options or Forest()
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.table(statistics(docs))
    passed = stats.filter("not base_failed")
    known = scratch.table(passed.join(_labelled(labels).filter(~_apart(o)), "doc_id")) if labels is not None else None
    n, want = passed.count(), o.trees * o.tree_rows
    at = F.pmod(F.xxhash64(F.lit(o.seed), F.col("doc_id")), F.lit(1 << 40))
    # distinct and limited in Spark: an id that repeats very often is no large sample
    some = passed.filter(at < int(min(1.0, want / max(n, 1)) * (1 << 40))).select("doc_id", *COUNTS).distinct().orderBy("doc_id", *COUNTS).limit(2 * want).toPandas()
    x = features({c: some[c].to_numpy() for c in COUNTS})
    forest = grow_forest(x, o, o.trees, separation(known) if known is not None else None)
    tree_rows = min(o.tree_rows, max(len(some), 1))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly(_features_of(b), forest, tree_rows))], names=[*b.schema.names, "anomaly"])

    def scored(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "anomaly double"]))

    limit = 1.0
    if known is not None:
        limit = calibrated(scored(known), o)
        scratch.drop(known)
    return scored(stats).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))
