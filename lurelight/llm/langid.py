"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's
maximum over a window feeds a softmax. The network is trained in numpy on the
driver, on a bounded sample of labelled rows (``Fit.per_label``), and applied to
every fixed-length window of every text; a document's probabilities are the
means over its windows, weighted by their bytes. Since embedding and filters are
linear, applying them sums table rows looked up by pairs of bytes.

Defined results: a text that is null or has no letter (Unicode class L) is
``und`` with score 0. Rows with a null id are predicted like others; repeated rows
are predicted one by one, and count once in the training. Equal probabilities go to
the first label. Without labelled rows every text is ``und``; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .scratch import near
from .textbytes import release, text_slices

UNKNOWN = "und"


@dataclass
class Fit:
    """``per_label``: rows of each label that training uses at most; ``rows``: of
    all labels together, dealt evenly where there are very many labels (at least
    one each); ``crop``: characters of a sampled text, from a place that depends on
    its id."""

    per_label: int = 2000
    rows: int = 100_000
    crop: int = 700
    window: int = 256
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    steps: int = 900
    batch: int = 96
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    labels: list[str]
    window: int
    embed: np.ndarray  # 256 x e
    filters: list[np.ndarray]  # w x e x f
    bias: list[np.ndarray]
    out: np.ndarray  # all f x labels
    out_bias: np.ndarray


def sample(docs: DataFrame, fit: Fit, id_col: str = "doc_id") -> list[tuple[str, str]]:
    """(label, text) of at most ``per_label`` rows of every label: those whose id
    has the smallest hashes. A threshold that the label's count sets comes first,
    and equal rows fall together, so neither a frequent label nor an id that
    repeats very often is a large group; the rest is cut before it is collected."""
    counts = docs.filter("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    labels = counts.count()
    if not labels:
        return []
    each = max(1, min(fit.per_label, fit.rows // labels))
    at = F.pmod(F.xxhash64(F.lit(fit.seed), F.col(id_col)), F.lit(1 << 30))
    length = F.greatest(F.length("text") - fit.crop, F.lit(0)) + 1
    crop = F.substring("text", (F.pmod(F.xxhash64(F.lit(fit.seed + 1), F.col(id_col)), length) + 1).cast("int"), F.lit(fit.crop))
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").alias("label"), at.alias("at"), F.col(id_col).alias("id"), crop.alias("text"))
    margin = (each + 4 * each**0.5 + 8) * (1 << 30)  # above the wanted number; the surplus is cut below
    some = rows.join(near(counts), "label").filter(F.col("at") < margin / F.col("n")).select(*rows.columns).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("at", "id", "text"))
    got = some.withColumn("place", place).filter(F.col("place") <= each).select("label", "place", "text").collect()
    return [(r.label, r.text) for r in sorted(got, key=lambda r: (r.label, r.place))]


def train(rows: list[tuple[str, str]], fit: Fit) -> Network | None:
    """Adam on random windows, also short ones, of the rows; classes evenly."""
    if not rows:
        return None
    rng = np.random.default_rng(fit.seed)
    labels = sorted({label for label, _ in rows})
    texts = [[np.frombuffer(t.encode(), np.uint8) for k, t in rows if k == label and t] for label in labels]
    labels, texts = [k for k, t in zip(labels, texts) if t], [t for t in texts if t]
    e, f, widths, length = fit.embed, fit.filters, fit.widths, fit.window
    p = [rng.normal(0, 0.5, (256, e))] + [rng.normal(0, (w * e) ** -0.5, (w * e, f)) for w in widths] + [np.zeros(f) for _ in widths]
    p += [rng.normal(0, 0.1, (f * len(widths), len(labels))), np.zeros(len(labels))]
    p = [x.astype(np.float32) for x in p]
    m, v, k = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], len(widths)
    for step in range(1, fit.steps + 1):
        y = rng.integers(len(labels), size=fit.batch)
        x = np.zeros((fit.batch, length), np.uint8)
        for i, c in enumerate(y):
            t = texts[c][rng.integers(len(texts[c]))]
            n = min(len(t), length if rng.random() < 0.5 else int(rng.integers(8, length + 1)))
            at = rng.integers(len(t) - n + 1)
            x[i, :n] = t[at : at + n]
        emb = p[0][x]
        pooled, where = [], []
        for j, w in enumerate(widths):
            win = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(fit.batch, length - w + 1, w * e)
            c = win @ p[1 + j] + p[1 + k + j]
            a = c.argmax(axis=1)
            pooled.append(np.take_along_axis(c, a[:, None], 1)[:, 0])
            where.append((win, a))
        h = np.concatenate(pooled, axis=1)
        r = np.maximum(h, 0)
        z = r @ p[-2] + p[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        dz = z
        dz[np.arange(fit.batch), y] -= 1
        dz /= fit.batch
        g = [np.zeros_like(x) for x in p]
        g[-2], g[-1] = r.T @ dz, dz.sum(axis=0)
        dh = (dz @ p[-2].T) * (h > 0)
        for j, w in enumerate(widths):
            d, (win, a) = dh[:, j * f : (j + 1) * f], where[j]
            at = win[np.arange(fit.batch)[:, None], a]  # batch x f x (w e)
            g[1 + j] = np.einsum("bfi,bf->if", at, d)
            g[1 + k + j] = d.sum(axis=0)
            back = d[:, :, None] * p[1 + j].T[None]  # to the bytes under the maximum
            for o in range(w):
                np.add.at(g[0], x[np.arange(fit.batch)[:, None], a + o], back[:, :, o * e : (o + 1) * e])
        rate = fit.rate * (1 - step / (fit.steps + 1))
        for i, x_ in enumerate(p):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            x_ -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(labels, length, p[0], [p[1 + j].reshape(w, e, f) for j, w in enumerate(widths)], p[1 + k : 1 + 2 * k], p[-2], p[-1])


class Scorer:
    """A network as tables by pairs of bytes, in a task."""

    def __init__(self, net: Network):
        self.net, self.tables = net, []
        for w in net.filters:
            one = [net.embed @ x for x in w]  # 256 x f for each place
            pairs = [(o, (one[o][:, None] + one[o + 1][None]).reshape(1 << 16, -1)) for o in range(0, len(one) - 1, 2)]
            single = [(len(one) - 1, one[-1])] if len(one) % 2 else []
            self.tables.append((len(one), pairs, single))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the windows (rows of bytes)."""
        length = x.shape[1]
        pair = x[:, :-1].astype(np.int32) << 8
        pair |= x[:, 1:]
        pooled = []
        for (w, pairs, single), bias in zip(self.tables, self.net.bias):
            n, c = length - w + 1, None
            for o, t in pairs:
                got = t.take(pair[:, o : o + n], axis=0)
                c = got if c is None else np.add(c, got, out=c)
            for o, t in single:
                got = t.take(x[:, o : o + n], axis=0)
                c = got if c is None else np.add(c, got, out=c)
            while (k := c.shape[1]) > 1:  # halving keeps the maxima contiguous
                half = k // 2
                best = np.maximum(c[:, :half], c[:, half : 2 * half])
                if k % 2:
                    np.maximum(best[:, 0], c[:, -1], out=best[:, 0])
                c = best
            pooled.append(c[:, 0] + bias)
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.out + self.net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of zero-padded bytes, first window of each row, bytes of each window)."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // length))
    first = np.concatenate([[0], np.cumsum(n)])
    x = np.zeros(int(first[-1]) * length, np.uint8)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (first * length).tolist()):
        x[at : at + b - a] = data[a:b]
    left = np.repeat(sizes, n) - (np.arange(first[-1]) - np.repeat(first[:-1], n)) * length
    return x.reshape(-1, length), first[:-1], np.clip(left, 1, length).astype(np.float32)


def _predicted(texts: pa.Array, letters: np.ndarray, scorer: Scorer | None, block: int) -> tuple[list[str], np.ndarray]:
    if scorer is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names, score = [], []
    for lo, hi, data, offsets in text_slices(texts):
        x, first, weight = windows(data, offsets, scorer.net.window)
        p = np.concatenate([scorer.probabilities(x[i : i + block]) for i in range(0, len(x), block)])
        p = np.add.reduceat(p * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
        best = p.argmax(axis=1)
        names += [scorer.net.labels[k] if ok else UNKNOWN for k, ok in zip(best, letters[lo:hi])]
        score.append(np.where(letters[lo:hi], np.clip(p[np.arange(len(p)), best], 0, 1), 0.0))
    return names, np.concatenate(score) if score else np.zeros(0)


def _has_letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None, block: int = 128) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        scorer = Scorer(net) if net else None
        for b in batches:
            names, score = _predicted(b.column(1), b.column(2).to_numpy(zero_copy_only=False), scorer, block)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text", _has_letters().alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.4, block: int = 128) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is one of the network's
    with a score of at least ``least``; rows stay in their tasks."""
    text, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        scorer = Scorer(net) if net else None
        for b in batches:
            own = b.select(range(n))
            said, score = _predicted(own.column(text), b.column(n).to_numpy(zero_copy_only=False), scorer, block)
            yield own.filter(pa.array([s != UNKNOWN and x >= least for s, x in zip(said, score)], pa.bool_()))
        release()

    # by place, whatever the columns' names
    places = [f"c{i}" for i in range(n + 1)]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(places, docs.schema)])
    return docs.select("*", _has_letters().alias("letters")).toDF(*places).mapInArrow(run, schema).toDF(*docs.columns)


def fit(docs: DataFrame, options: Fit | None = None) -> Network | None:
    """A network for the labels of ``docs`` (doc_id, text, lang)."""
    options = options or Fit()
    return train(sample(docs, options), options)
