"""Removal of passages that recur across documents: repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if a
window that covers it also starts in a document with a smaller id. Windows are
judged on the input.

1. Each window names one phrase: that run of ``phrase`` words inside it with the
   smallest hash, the first of equals. Equal windows name equal phrases, and only
   about 1 word in 22 starts one. Phrases of a single document are of no use.
2. Documents are dealt to buckets of bounded size, each with the recurring phrases
   that its documents name.
3. Windows in a row that name one recurring phrase form a run. Passages are
   confirmed by their words, through 128-bit BLAKE2 digests: runs of the same words
   in several documents, and, where a phrase has several different runs (edges of
   passages, edits), the stretches of windows that recur, found from the windows of
   one document for each run. Hashes of words only choose phrases.
4. The confirmed passages whose phrase a bucket's documents name are compiled into
   the bucket's Aho-Corasick automaton, one letter a word, and its documents are
   streamed through that: each shard holds what its documents can meet, and no
   document visits another shard. What it finds, at whatever place, with the same words and first met
   in a smaller id, goes. Documents that name no phrase of several are not streamed.

Defined results: null and empty texts have no words; nothing is removed and the
digest is that of the empty string. Repeated ids are each judged against smaller
ids only; rows that are equal in id and text meet in one bucket. An empty table
gives an empty result. Other columns are ignored. Documents with a null id are
left out.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbytes import U64, grams, runs, sliced, text_slices, words

WINDOW, PHRASE, LETTERS = 50, 8, 3
#: Characters of text in a bucket, about.
BUCKET_CHARS = 8 << 20


def _named(h: np.ndarray, doc: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one row, place of the phrase each names)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = grams(h, phrase)
    span, at, have = window - phrase + 1, np.arange(len(g)), 1
    while have < span:  # leftmost minimum of twice as many places each time
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(g[a] <= g[b], a, b), have + step
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return starts, at[starts]


def _letters(h: np.ndarray) -> np.ndarray:
    """Three letters of 5 bits for each word of a phrase."""
    out = np.empty((len(h), LETTERS), np.uint8)
    for i in range(LETTERS):
        out[:, i] = (h >> U64(59 - 5 * i)).astype(np.uint8) & 31
    return out


def _phrases(letters: np.ndarray, at: np.ndarray, phrase: int) -> list[bytes]:
    flat = letters[at[:, None] + np.arange(phrase)].reshape(len(at), LETTERS * phrase)
    return [x.tobytes() for x in flat]


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, bucket, phrase) of the phrases that the windows of each row name."""

    def run(batches):
        for rows, data, offsets in sliced(batches, "text"):
            w = words(data, offsets)
            _, at = _named(w.hash, w.doc, window, phrase)
            at = np.unique(at)
            of = pa.array(w.doc[at])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(of), rows.column(1).take(of), pa.array(_phrases(_letters(w.hash), at, phrase), pa.binary())], names=["doc_id", "bucket", "phrase"])

    return docs.select("doc_id", "bucket", "text").mapInArrow(run, "doc_id long, bucket int, phrase binary")


def _streamed(window: int, phrase: int):
    """For cogroups of a bucket's documents and its recurring phrases."""
    schema = [("doc_id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string())]
    schema = pa.schema([*schema, ("named", pa.list_(pa.int64())), ("run", pa.list_(pa.binary())), ("start", pa.list_(pa.int64())), ("length", pa.list_(pa.int64()))])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        recurring = set(found.column("phrase").to_pylist())
        out, text, ids, rids = [], docs.column("text").combine_chunks(), docs.column("doc_id").to_pylist(), docs.column("rid").to_pylist()
        for lo, hi, data, offsets in text_slices(text):
            w = words(data, offsets)
            counts = np.bincount(w.doc, minlength=hi - lo)
            first = runs(w.doc, hi - lo)
            by: dict[int, list] = {}
            if recurring:
                starts, at = _named(w.hash, w.doc, window, phrase)
                places, which = np.unique(at, return_inverse=True)
                keep = np.array([p in recurring for p in _phrases(_letters(w.hash), places, phrase)], bool)[which]
                starts, at = starts[keep], at[keep]
                if len(starts):
                    code = grams(w.hash, phrase)
                    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
                    size = np.diff(np.append(new, len(starts)))
                    doc = w.doc[starts[new]]
                    fields = code[at[new]].view(np.int64), starts[new] - first[doc], size
                    edge = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(new)]
                    by = {int(doc[i]): [f[i:j] for f in fields] for i, j in zip(edge, edge[1:])}  # the runs of each document
            raw, bound = data.tobytes(), offsets.tolist()
            for d in range(hi - lo):
                own = raw[bound[d] : bound[d + 1]]
                if d not in by:
                    out.append((ids[lo + d], rids[lo + d], int(counts[d]), hashlib.sha256(b" ".join(own.split())).hexdigest(), None, [], [], [], []))
                    continue
                named, start, size = by[d]
                norm = b" ".join(own.split())
                digests = _digests(norm, (w.end - w.start)[first[d] : first[d + 1]], start, size + window - 1)
                out.append((ids[lo + d], rids[lo + d], int(counts[d]), "", norm.decode(), named, digests, start, size))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _digests(norm: bytes, sizes: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """Digests of ``length`` words from each ``start`` on, in a text whose words of
    so many bytes are joined by one space."""
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    return [hashlib.blake2b(norm[a:b], digest_size=16).digest() for a, b in zip(begin[start].tolist(), (begin[start + length] - 1).tolist())]


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(named, run, doc_id, i, h1, h2) of the windows of the runs of each row:
    ``rows`` (doc_id, text of words joined by one space, runs)."""

    def run(batches):
        known: dict[bytes, int] = {}
        table: list[bytes] = []
        for b in batches:
            texts = [t.as_py().encode().split(b" ") for t in b.column(1)]
            every = [w for t in texts for w in t]
            if len(known) > 1 << 19:  # words that a task remembers
                known, table = {}, []
            for w in set(every).difference(known):
                known[w] = len(table)
                table.append(hashlib.blake2b(w, digest_size=16).digest())
            lanes = np.frombuffer(b"".join(table), U64).reshape(-1, 2)[[known[w] for w in every]]
            h1, h2 = (grams(lanes[:, k], window).view(np.int64) for k in (0, 1))
            mine = b.column(2).flatten()
            row, first = np.repeat(np.arange(len(texts)), b.column(2).value_lengths().to_numpy()), np.cumsum([0, *map(len, texts)])
            n = mine.field("length").to_numpy()
            of, i = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (first[row] + mine.field("start").to_numpy())[of] + i
            which = pa.array(of)
            columns = [mine.field("named").take(which), mine.field("run").take(which), b.column(0).take(pa.array(row[of])), pa.array(i), pa.array(h1[at]), pa.array(h2[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["named", "run", "doc_id", "i", "h1", "h2"])

    return rows.select("doc_id", "text", "runs").mapInArrow(run, "named long, run binary, doc_id long, i long, h1 long, h2 long")


STREAMED = "doc_id long, rid long, n_words long, sha string, text string, named array<long>, run array<binary>, start array<long>, length array<long>"


def _letter(h: np.ndarray) -> bytes:
    """A letter of 6 bits for each word; passages are long, and their words are compared."""
    return (h >> U64(58)).astype(np.uint8).tobytes()


def _patterns(rows: DataFrame) -> DataFrame:
    """(named, letters, digest, lo) of the passages of each row: ``rows`` (text of
    words joined by one space, passages)."""

    def run(batches):
        for b in batches:
            lists, out = b.column(1), []
            for lo, hi, data, offsets in text_slices(b.column(0)):
                w = words(data, offsets)
                first, raw = runs(w.doc, hi - lo), data.tobytes()
                for d in range(hi - lo):
                    mine, at = lists[lo + d].as_py(), slice(first[d], first[d + 1])
                    letters = _letter(w.hash[at])
                    start, n = np.array([m["start"] for m in mine]), np.array([m["n_words"] for m in mine])
                    digests = _digests(raw[offsets[d] : offsets[d + 1]], (w.end - w.start)[at], start, n)
                    out += [(m["named"], letters[m["start"] : m["start"] + m["n_words"]], x, m["lo"]) for m, x in zip(mine, digests)]
            names, kinds = ["named", "letters", "digest", "lo"], [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return rows.select("text", "passages").mapInArrow(run, "named long, letters binary, digest binary, lo long")


def _resolved(docs: pa.Table, found: pa.Table) -> pa.Table:
    """For cogroups of a bucket's documents (text of words joined by one space) and
    the passages that they can hold: what is left of each document."""
    by: dict[str, dict[bytes, int]] = {}
    for letters, digest, lo in zip(*(found.column(c).to_pylist() for c in ("letters", "digest", "lo"))):
        same = by.setdefault(letters.decode("latin-1"), {})
        same[digest] = min(lo, same.get(digest, lo))
    automaton = ahocorasick.Automaton()
    for letters, same in by.items():
        automaton.add_word(letters, (len(letters), min(same.values()), same))
    if len(automaton):
        automaton.make_automaton()
    text, ids = docs.column("text").combine_chunks(), docs.column("doc_id").to_pylist()
    counts, removed, sha = [], [], []
    for lo, hi, data, offsets in text_slices(text):
        w = words(data, offsets)
        first, raw = runs(w.doc, hi - lo), data.tobytes()
        for d in range(hi - lo):
            at = slice(first[d], first[d + 1])
            own, n, me = raw[offsets[d] : offsets[d + 1]], int(first[d + 1] - first[d]), ids[lo + d]
            begin = np.concatenate([[0], np.cumsum((w.end - w.start)[at] + 1)]).tolist()
            gone: list[list[int]] = []  # ranges of words that go, apart and in order
            for end, (size, least, same) in automaton.iter(_letter(w.hash[at]).decode("latin-1")) if len(automaton) else ():
                start = end + 1 - size
                if least >= me or (gone and start >= gone[-1][0] and end < gone[-1][1]):
                    continue
                if same.get(hashlib.blake2b(own[begin[start] : begin[end + 1] - 1], digest_size=16).digest(), me) < me:
                    while gone and start <= gone[-1][1]:
                        start = min(start, gone.pop()[0])
                    gone.append([start, end + 1])
            kept = np.ones(n, bool)
            for a, z in gone:
                kept[a:z] = False
            counts.append(n)
            removed.append(n - int(kept.sum()))
            left = [x for x, k in zip(own.split(b" "), kept.tolist()) if k] if gone else [own]
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def confirmed(docs: DataFrame, scratch: Scratch, window: int = WINDOW, phrase: int = PHRASE, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents with their bucket and runs, (bucket, letters, digest, lo) of the
    passages that the bucket's documents can hold, which ``lo`` holds first)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // bucket_chars))
    bucket = F.pmod(F.col("rid"), F.lit(buckets)).cast("int")
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("bucket", bucket)

    where = scratch.table(phrases(docs, window, phrase).groupBy("phrase", "bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
    recurring = where.groupBy("phrase").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    found = where.select("phrase", "bucket").join(recurring.select("phrase"), "phrase")
    streamed = docs.select("bucket", "doc_id", "rid", "text").groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_streamed(window, phrase), STREAMED)
    streamed = scratch.table(streamed).withColumn("bucket", bucket)

    one = streamed.filter("text is not null").select("doc_id", "rid", "bucket", F.explode(F.arrays_zip("named", "run", "start", "length")).alias("r")).select("doc_id", "rid", "bucket", "r.*")
    one = scratch.table(one)
    first = one.groupBy("named", "run").agg(F.min(F.struct("doc_id", "rid", "start", "length")).alias("at"), F.max("doc_id").alias("top")).select("named", "run", "at.*", "top")
    first = scratch.table(first)
    size = (F.col("length") + window - 1).alias("n_words")
    whole = first.filter("doc_id < top").select("named", "doc_id", "rid", "start", size, F.col("doc_id").alias("lo"))
    # phrases with several runs: the windows of each run's smallest document
    several = first.groupBy("named").agg(F.count("*").alias("c")).filter("c > 1").select("named")
    mine = first.join(several, "named").groupBy("doc_id", "rid").agg(F.collect_list(F.struct("named", "run", "start", "length")).alias("runs"))
    texts = streamed.filter("text is not null").select("doc_id", "rid", "text")
    single = scratch.table(_windows(texts.join(mine, ["doc_id", "rid"]), window))
    least = single.groupBy("named", "h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("top")).filter("lo < top").select("named", "h1", "h2", "lo")
    again = single.join(least, ["named", "h1", "h2"]).filter("doc_id > lo").select("named", "run", "i", "lo")
    # windows in a row with one first document: at most a run's, which are few
    row = F.row_number().over(Window.partitionBy("named", "run", "lo").orderBy("i"))
    stretch = again.withColumn("island", F.col("i") - row).groupBy("named", "run", "lo", "island").agg(F.min("i").alias("i"), F.count("*").alias("length"))
    parts = stretch.join(first.select("named", "run", "doc_id", "rid", "start"), ["named", "run"]).select("named", "doc_id", "rid", (F.col("start") + F.col("i")).alias("start"), size, "lo")
    held = whole.unionByName(parts).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("named", "start", "n_words", "lo")).alias("passages"))
    passages = _patterns(texts.join(held, ["doc_id", "rid"])).groupBy("named", "letters", "digest").agg(F.min("lo").alias("lo"))
    reach = one.select("named", "bucket").distinct()
    passages = scratch.table(passages.join(reach, "named").select("bucket", "letters", "digest", "lo"))
    scratch.drop(where, one, first, single)
    return streamed, passages


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by
    one space) of each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    streamed, passages = confirmed(docs, scratch, window, phrase, bucket_chars)
    plain = streamed.filter("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    some = streamed.filter("text is not null").select("bucket", "doc_id", "text")
    return plain.unionByName(some.groupBy("bucket").cogroup(passages.groupBy("bucket")).applyInArrow(_resolved, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
