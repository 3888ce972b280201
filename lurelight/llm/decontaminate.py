"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-cased; words are runs of bytes but white space and ASCII
punctuation.

1. The n-grams of the test items are the seeds, as long as the wanted score allows
   whatever the edits are (``seed_words``; at a score of a half one word, since a word
   put in between every two spoils all longer ones). A text that reaches the score
   shares at least ``shared`` places of an item's n-grams, within the ``reach`` of an
   alignment. So the commonest n-grams, counted over all texts, are left out as long as
   every such text still holds ``hold`` of the others: the rare ones suffice, and
   several of them must stand within the reach. Items go to the tasks in blocks of a
   bounded number of seeds; two scans of all texts for each block count the n-grams and
   join the texts to the places where a seed occurs. Texts are not shuffled.
2. Every item whose seeds meet in a text meets the words around them, as far as
   an alignment that counts can reach. An item is left aside there only if too few
   of its words occur in them, or too far apart, for the wanted score: both bounds
   are never below the alignment's score.
3. The local alignment of the item's words with these (match 1, mismatch and gap
   -``penalty``) divided by the item's length is the score. A copy has 1; edits
   and paraphrases lower it.

Defined results: null and empty texts, and items without words, match nothing. No
edits hide a text that reaches the score. Texts of any length are read in slices of a
few megabytes, a longer one by itself. Repeated items and documents are matched each; pairs are distinct, with the
best score of the rows of an id. Empty tables give an empty result. Rows with a null
id are left out. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import U64, grams, runs, sliced, words

NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 0x20
FEW = U64((1 << 22) - 1)


@dataclass
class Search:
    #: Words of a seed at most.
    seed: int = 4
    #: Seeds that must meet, where an item has as many.
    hold: int = 3
    penalty: float = 0.5
    score: float = 0.5
    #: Seeds that one scan looks for at most (a few dozen bytes each in every task), but for a longer item.
    block_seeds: int = 1_000_000


def item_words(items: DataFrame) -> DataFrame:
    """item_id and words (binary, u8 hashes) of each item."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            w = words(NORMAL[data], offsets)
            first = runs(w.doc, rows.num_rows)
            own = [w.hash[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own, pa.binary())], names=["item_id", "item"])

    return items.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).filter("item_id is not null").mapInArrow(run, "item_id long, item binary")


def _spoiled(n: int, k: int, o: Search) -> float:
    """Places of an item's runs of ``k`` words that edits within the wanted score
    spoil at most: a word that lacks at an end costs a match and spoils one, one that is
    replaced or left out costs a penalty besides and spoils k, one put in costs a
    penalty and spoils k - 1."""
    between = (k - 1) / o.penalty if o.penalty > 0 else math.inf if k > 1 else 0.0
    return max(1.0, k / (1 + o.penalty), between) * (1 - o.score) * n


def shared(n: int, k: int, o: Search) -> int:
    """How many places of an item's runs of ``k`` words a text of the wanted score
    shares at least."""
    spoiled = _spoiled(n, k, o)
    return 0 if math.isinf(spoiled) else n - k + 1 - int(spoiled + 1e-9)


def seed_words(n: int, o: Search) -> int:
    """Length of the seeds of an item of ``n`` words: the longest of which edits
    leave some."""
    return max([k for k in range(1, min(o.seed, n) + 1) if shared(n, k, o) >= min(o.hold, n)], default=1)


def reach(n: int, o: Search) -> int:
    """Words of a text that an alignment with an item of ``n`` words spans at
    most: each word put in costs a penalty."""
    return n + int((1 - o.score) * n / o.penalty) if o.penalty > 0 else 1 << 40


class Block:
    """Items of one scan: their ids, their words as places in ``vocabulary``, how
    far they reach, and ``seeds``: sorted seeds, where their items start, items."""

    def __init__(self, items: dict[bytes, list[int]], o: Search):
        own = [np.frombuffer(x, U64) for x in items]
        self.ids = list(items.values())
        self.vocabulary = np.unique(np.concatenate(own))
        self.items = [np.searchsorted(self.vocabulary, x).astype(np.int32) for x in own]
        self.reach = np.array([reach(len(x), o) for x in own], np.int64)
        by = np.array([seed_words(len(x), o) for x in own])
        self.least = np.array([max(1, shared(len(x), k, o)) for x, k in zip(own, by.tolist())], np.int64)
        self.hold = np.minimum(self.least, o.hold)
        #: by length: the items' n-grams and their counts in each, and all of them, sorted
        self.grams, self.held = {}, {}
        for k in np.unique(by).tolist():
            self.grams[k] = {i: np.unique(grams(own[i], k), return_counts=True) for i in np.flatnonzero(by == k).tolist()}
            self.held[k] = np.unique(np.concatenate([g for g, _ in self.grams[k].values()]))
        self.seeds = {}

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Takes the rare n-grams as seeds; ``counts`` of all, as in ``held``."""
        for k, own in self.grams.items():
            keys = [g[_rare(counts[k][np.searchsorted(self.held[k], g)], times, int(self.least[i] - self.hold[i]) + 1)] for i, (g, times) in own.items()]
            who, keys = np.repeat(np.array(list(own)), [len(x) for x in keys]), np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            seeds, start = np.unique(keys[order], return_index=True)
            self.seeds[k] = seeds, np.append(start, len(keys)), who[order]

    def hits(self, w, few: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of all seeds in the words of a slice."""
        places, items = [], []
        for k, (seeds, start, who) in self.seeds.items():
            at, s = _found(w, k, seeds, few[k])
            m = start[s + 1] - start[s]
            places.append(np.repeat(at, m))
            items.append(who[np.repeat(start[s] - np.cumsum(m) + m, m) + np.arange(m.sum())])
        return np.concatenate(places), np.concatenate(items)

    def meeting(self, at: np.ndarray, who: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which hits, in the order of texts, items and places, stand with as many
        others of their item as it must hold within its reach."""
        stay = self.hold[who] <= 1
        for n in range(2, int(self.hold.max()) + 1):
            first = np.flatnonzero(self.hold[who[: 1 - n]] == n)
            last = first + n - 1
            near = (who[last] == who[first]) & (doc[last] == doc[first]) & (at[last] - at[first] < self.reach[who[first]])
            for j in range(n):
                stay[first[near] + j] = True
        return stay


def _few(keys: np.ndarray) -> np.ndarray:
    """A bit for the last digits of every key."""
    out = np.zeros(1 << 22, bool)
    out[(keys & FEW).astype(np.int64)] = True
    return out


def _found(w, k: int, keys: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of k words that are among the sorted keys, and which they are."""
    g = grams(w.hash, k)
    at = np.flatnonzero(few[(g & FEW).astype(np.int64)] & (w.doc[: len(g)] == w.doc[k - 1 :]))
    s = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
    same = keys[s] == g[at]
    return at[same], s[same]


def counted(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each n-gram of the block's items occurs in all texts. A task ships
    at most a row an n-gram, and the driver gets as many."""
    held = block.held

    def run(batches):
        few, n = {k: _few(keys) for k, keys in held.items()}, {k: np.zeros(len(keys), np.int64) for k, keys in held.items()}
        for _, data, offsets in sliced(batches, "text"):
            w = words(NORMAL[data], offsets)
            for k, keys in held.items():
                n[k] += np.bincount(_found(w, k, keys, few[k])[1], minlength=len(keys))
        for k, c in n.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at), pa.array(c[at])], names=["k", "at", "n"])

    out = {k: np.zeros(len(keys), np.int64) for k, keys in held.items()}
    for r in docs.select(F.lower("text").alias("text")).mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        out[r.k][r["at"]] = r.n
    return out


def _rare(counts: np.ndarray, times: np.ndarray, least: int) -> np.ndarray:
    """Which n-grams of an item stay seeds, by their counts in the corpus: all but
    the commonest, whose places in the item are fewer than ``least``."""
    order = np.argsort(-counts, kind="stable")
    stay = np.zeros(len(counts), bool)
    stay[order] = np.cumsum(times[order]) >= least
    return stay


def blocks(items: DataFrame, o: Search) -> Iterator[Block]:
    mine, size = {}, 0
    for i, item in items.filter(F.length("item") > 0).toLocalIterator():
        if mine and size + len(item) // 8 > o.block_seeds:
            yield Block(mine, o)
            mine, size = {}, 0
        if bytes(item) not in mine:
            size += len(item) // 8
        mine.setdefault(bytes(item), []).append(i)
    if mine:
        yield Block(mine, o)


def align(item: np.ndarray, passage: np.ndarray, penalty: float) -> float:
    """Best local alignment of two word sequences (Smith-Waterman, linear gaps).
    Row by row over the item: gaps along a row are a running maximum."""
    ramp = penalty * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1), 0.0
    for w in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == w, 1.0, -penalty), row[1:] - penalty, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, float(row.max()))
    return best


def _scored(docs: DataFrame, block: Block, o: Search) -> DataFrame:
    """(doc_id, item_id, score) of the texts and the block's items, one scan."""

    def run(batches):
        few = {k: _few(seeds) for k, (seeds, _, _) in block.seeds.items()}
        other = len(block.vocabulary)  # any word of no item
        there = np.zeros(other + 1, bool)
        for rows, data, offsets in sliced(batches, "text"):
            w = words(NORMAL[data], offsets)
            at, who = block.hits(w, few)
            if not len(at):
                continue
            order = np.lexsort((at, who, w.doc[at]))
            at, who = at[order], who[order]
            met = block.meeting(at, who, w.doc[at])
            at, who = at[met], who[met]
            if not len(at):
                continue
            doc = w.doc[at]
            new = np.flatnonzero((np.diff(at, prepend=0) > 2 * block.reach[who]) | (np.diff(who, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            last = at[np.append(new[1:], len(at)) - 1]
            first = runs(w.doc, rows.num_rows)
            lo = np.maximum(first[doc[new]], at[new] - block.reach[who[new]])
            hi = np.minimum(first[doc[new] + 1], last + block.reach[who[new]])
            text = np.searchsorted(block.vocabulary, w.hash)
            text[block.vocabulary[np.minimum(text, other - 1)] != w.hash] = other
            best = {}
            for d, i, a, b in zip(doc[new].tolist(), who[new].tolist(), lo.tolist(), hi.tolist()):
                item, part = block.items[i], text[a:b]
                there[part] = True
                there[other] = False
                able = np.count_nonzero(there[item])
                there[part] = False
                if able < o.score * len(item):
                    continue
                there[item] = True
                sums = np.cumsum(np.where(there[part], 1.0, -o.penalty))
                there[item] = False
                if (sums - np.minimum(np.minimum.accumulate(sums), 0)).max() + 1 < o.score * len(item):
                    continue  # each word of an alignment's part of the text gains 1 at most, others cost
                score = align(item, part, o.penalty) / len(item)
                if score >= max(o.score, best.get((d, i), 0.0)):
                    best[d, i] = score
            out = [(d, j, score) for (d, i), score in best.items() for j in block.ids[i]]
            if out:
                d, j, score = zip(*out)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), pa.array(j, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "item_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).filter("doc_id is not null").mapInArrow(run, "doc_id long, item_id long, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, search: Search | None = None) -> DataFrame:
    """(doc_id, item_id, score) of all pairs with a score of ``search.score`` or more."""
    o, out = search or Search(), None
    for block in blocks(item_words(benchmark), o):
        block.choose(counted(docs, block))
        got = _scored(docs, block, o)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
