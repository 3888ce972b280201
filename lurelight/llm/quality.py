"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with temperature-calibrated probabilities.

1. Words (lower-cased A-Z) hash to ``Options.rows`` rows. Each row has a sparse
   random index vector; a row's word vector is the sum of the index vectors of
   the words around it, over every text of the corpus. Tasks add up their own
   texts, Spark sums the tasks' partial tables; the result has a fixed size.
2. A document is the mean and the spread of its words' vectors and its length.
3. The network is fitted on the driver, on at most ``Options.train_rows``
   labelled rows (the bound of the fit), a fifth of which sets the temperature.

Defined results: null and empty texts have zero vectors and get a score like any
other, and so have rows with a null id. Without labelled rows of both classes (ten
at least) every score is the share of label 1 (0.5 without any). Repeated rows are
scored one by one; an id labelled twice has the larger label, and of the texts of
an id the network learns one. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, U64, mix, sliced, words


@dataclass
class Options:
    rows: int = 8192
    size: int = 64
    marks: int = 4  # entries of an index vector that are not 0
    around: int = 2  # words on either side
    train_rows: int = 20_000
    hidden: int = 32
    epochs: int = 40
    batch: int = 128
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 5


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float


def _index(o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    h = mix(np.arange(o.rows * o.marks, dtype=U64) + U64(o.seed << 32)).reshape(o.rows, o.marks)
    return (h % U64(o.size)).astype(np.int64), np.where(h >> U64(63), 1.0, -1.0)


def word_vectors(docs: DataFrame, o: Options) -> np.ndarray:
    """rows x size; each row of unit length, or 0 where no word fell."""
    columns = [f"c{i}" for i in range(o.size)]

    def run(batches):
        place, sign = _index(o)
        total = None
        for _, data, offsets in sliced(batches, "text"):
            w = words(LOWER[data], offsets)
            v = (w.hash % U64(o.rows)).astype(np.int64)
            total = np.zeros(o.rows * o.size) if total is None else total
            for lo in range(0, len(v), 1 << 18):
                for d in range(1, o.around + 1):
                    a, b = v[lo : min(lo + (1 << 18), len(v) - d)], v[lo + d : lo + d + (1 << 18)]
                    same = w.doc[lo : lo + len(a)] == w.doc[lo + d : lo + d + len(b)]
                    a, b = a[same], b[same]
                    for x, y in ((a, b), (b, a)):
                        at = (x[:, None] * o.size + place[y]).ravel()
                        total += np.bincount(at, sign[y].ravel(), o.rows * o.size)
        if total is not None:
            table = total.reshape(o.rows, o.size).astype(np.int64)
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(np.ascontiguousarray(table[used, i])) for i in range(o.size)]], names=["row", *columns])

    parts = docs.select("text").mapInArrow(run, "row int, " + ", ".join(f"{c} long" for c in columns))
    got = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # at most o.rows rows
    out = np.zeros((o.rows, o.size), np.float32)
    if len(got):
        x = got[columns].to_numpy(float)
        out[got["row"].to_numpy()] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, rows: int, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, and the length, of each row."""
    w = words(LOWER[data], offsets)
    v, size = (w.hash % U64(len(vectors))).astype(np.int64), vectors.shape[1]
    total, square = np.zeros((rows, size)), np.zeros((rows, size))
    for lo in range(0, len(v), 1 << 16):
        doc, x = w.doc[lo : lo + (1 << 16)], vectors[v[lo : lo + (1 << 16)]]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        total[doc[first]] += np.add.reduceat(x, first)
        np.multiply(x, x, out=x)
        square[doc[first]] += np.add.reduceat(x, first)
    n = np.bincount(w.doc, minlength=rows)
    safe = np.maximum(n, 1)[:, None]
    mean = total / safe
    return np.concatenate([mean, np.sqrt(np.maximum(square / safe - mean * mean, 0)), np.log1p(n)[:, None]], axis=1).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and the features (binary, f4) of each row."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            x = pooled(data, offsets, rows.num_rows, vectors)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def _logit(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    return np.maximum(x @ layers[0] + layers[1], 0) @ layers[2] + layers[3]


def _probability(z: np.ndarray, temperature: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z / temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """(mean, spread, layers, temperature). Adam; the last fifth of the shuffled
    rows sets the temperature, the others the weights."""
    rng = np.random.default_rng(o.seed)
    order = rng.permutation(len(x))
    kept, apart = order[: len(x) - len(x) // 5], order[len(x) - len(x) // 5 :]
    mean, spread = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-3
    x = (x - mean) / spread
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], o.hidden)), np.zeros(o.hidden), rng.normal(0, o.hidden**-0.5, o.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(o.epochs):
        rng.shuffle(kept)
        for lo in range(0, len(kept), o.batch):
            at, step = kept[lo : lo + o.batch], step + 1
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            d = (_probability(h @ p[2] + p[3], 1.0) - y[at]) / len(at)
            dh = np.outer(d, p[2]) * (h > 0)
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - o.rate * ((m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) + o.decay * p[i])
    z, t = _logit(x[apart], p), y[apart]
    losses = {c: -np.mean(t * np.log(q := np.clip(_probability(z, c), 1e-9, 1 - 1e-9)) + (1 - t) * np.log(1 - q)) if len(t) else 0.0 for c in np.geomspace(0.25, 8, 61)}
    return mean, spread, [a.astype(np.float32) for a in p], float(min(losses, key=losses.get))


def fit(docs: DataFrame, labels: DataFrame, options: Options | None = None) -> Model:
    """``docs`` (doc_id, text): the corpus, all of which makes the word vectors;
    ``labels`` (doc_id, quality): rows that may be learned from."""
    o = options or Options()
    vectors = word_vectors(docs, o)
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = known.count()
    at = F.pmod(F.xxhash64(F.lit(o.seed), "doc_id"), F.lit(1 << 30))
    share = min(1.0, (o.train_rows + 4 * o.train_rows**0.5) / max(n, 1))
    some = known.filter(at < int(share * (1 << 30))).limit(2 * o.train_rows)
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id", "left_semi")  # bounded by train_rows
    got = features(own, vectors).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(some), "doc_id")  # a row for each id
    got = got.toPandas().sort_values("doc_id").iloc[: o.train_rows]
    y = got["quality"].to_numpy(float)
    if len(y) < 10 or y.min() == y.max():
        return Model(vectors, np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float)
    mean, spread, layers, temperature = train(x, y, o)
    return Model(vectors, mean, spread, layers, temperature, float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            if model.layers:
                x = (pooled(data, offsets, rows.num_rows, model.vectors) - model.mean) / model.spread
                p = _probability(_logit(x, model.layers), model.temperature)
            else:
                p = np.full(rows.num_rows, model.prior)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.astype(float))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
