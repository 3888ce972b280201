"""Resampling towards a target's distribution of hashed word runs.

A streaming ring of CRC states reads each text once: it keeps the running zlib
states of the last starts, extends each by a space and the next word, and gives the
bucket of every run of 1 to ``most`` words. Buckets of all texts and of the target
are counted in the tasks, so a task ships at most one row a bucket. A bucket's gain
is the logarithm of its share in the target over its share in the texts; a
document's weight is the mean gain of its runs, and its score adds Gumbel noise
drawn from its id, so the highest scores are a sample without replacement.

Words are runs of letters a-z (A-Z lower-cased), digits and characters from U+0080
on. A text is scanned twice in all, once for the counts and once for the weights;
the second scan needs the first one's counts, and a scan costs less than keeping
every run's bucket would.

Defined results: null and empty texts have no features and a weight of 0. Texts of
any length are read in pieces of about BLOCK bytes. Repeated rows of an id are
documents of their own, each with its rank; equal scores go by the smaller id, then
by fewer features. Rows with a null id count in the statistics as texts but are
neither drawn nor returned. An empty table, an empty target or null target texts
give counts of 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbytes import sliced

#: Bytes of a text whose words are held at once, about.
BLOCK = 1 << 20
#: Rows of a range that one task orders, about.
RANGE = 50_000

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of those of about BLOCK bytes."""
    text, lo = text.translate(_TO_WORDS), 0
    while lo < len(text):
        hi = text.find(b" ", lo + BLOCK)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def ring(text: bytes, most: int) -> Iterator[tuple[int, list[int]]]:
    """(length, CRC states) of the runs of 1 to ``most`` words, a list for each
    length and block. The ring holds the last state of each length but the longest:
    those are the starts that the next word extends."""
    held: list[list[int]] = [[] for _ in range(most - 1)]
    for words in word_blocks(text):
        spaced = [b" " + w for w in words]
        states = list(map(crc32, words))
        yield 1, states
        for k in range(most - 1):
            before = held[k] + states
            held[k] = before[-1:]
            states = list(map(crc32, spaced[len(spaced) - len(before) + 1 :], before))
            yield k + 2, states


def _texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    whole = data.tobytes()
    return (whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def bucket_counts(texts: DataFrame, most: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how often the runs of all texts (text) fall in it."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for _, data, offsets in sliced(batches, "text"):
            for text in _texts(data, offsets):
                for _, states in ring(text, most):
                    if states:
                        n += np.bincount(np.array(states, np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(texts: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the logarithm of target share over text share for each
    bucket, one count added to each. A row a bucket comes to the driver."""
    of = bucket_counts(texts, most, buckets).select("bucket", "n", F.lit(0).alias("which"))
    to = bucket_counts(target, most, buckets).select("bucket", "n", F.lit(1).alias("which"))
    n = np.zeros((2, buckets), np.int64)
    for r in of.unionByName(to).collect():
        n[r.which, r.bucket] = r.n
    s, t = (float(x) for x in n.sum(axis=1))
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + buckets) / ((float(a) + 1) * (t + buckets)))) for a, b in n.T.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            words, features, weight = [], [], []
            for text in _texts(data, offsets):
                w = n = total = 0
                for length, states in ring(text, most):
                    n += len(states)
                    w += len(states) if length == 1 else 0
                    total += int(gain[np.array(states, np.int64) % len(gain)].sum())
                words.append(w)
                features.append(n)
                weight.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw, floored, from a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, n: int, order: list[Column], scratch: Scratch) -> DataFrame:
    """The ``n`` rows with rank, their places from 1 in the order. Ranges of about
    RANGE rows are written, so their limits are fixed; each is ordered by itself and
    starts where the counts of those before it end."""
    cut = scratch.table(rows.repartitionByRange(max(1, math.ceil(n / RANGE)), *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select("_range", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + place).drop("_range", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``
    (doc_id, text) with an id. Of the rows with ``least_words`` words or more,
    ``percent`` of 100 are drawn, and their rank is not null."""
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(docs, target, most, buckets)
    scored = weights(docs.filter("doc_id is not null"), gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch.table(scored)
    able = scored.filter(F.col("n_words") >= least_words)
    n = able.count()
    places = ranked(able, n, [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], scratch)
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank")).cast("long")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.withColumn("rank", drawn).unionByName(rest)
