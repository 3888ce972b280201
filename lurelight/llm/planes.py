"""Token-id files of shuffled bit planes.

Fixed-size blocks of ids are transposed into bit or byte planes, and each plane
is compressed with zstandard (on the test texts byte planes take 0.65 and bit
planes 0.74 of the ids' two bytes, so byte planes are the default). A file holds one row for each run of whole
documents ("chunk"): the documents' ids and lengths, the chunk index (compressed
bytes of each block's planes) and the payload. Files are written by Spark's
Parquet writer with no further compression, so any store that Spark can write,
its commit protocol and lost executors are covered.

Parts are ascending ranges of doc_id, one for each task; within a part chunks
and documents ascend. A null text counts as empty and becomes its end id alone.
Documents with a null id are left out. Repeated ids stay, in the order of their
texts. An empty table gives a folder without chunks, which reads back as no rows. A
document's ids stand in one chunk however long it is; blocks bound what is compressed
at once. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder

BLOCK_IDS, CHUNK_IDS, END_ID = 1 << 16, 1 << 20, 0
SCHEMA = "part int, chunk int, first_id long, n_docs int, n_ids long, block_ids int, planes int, kind string, doc_ids binary, lengths binary, plane_bytes binary, payload binary"


def to_planes(ids: np.ndarray, planes: int, kind: str) -> np.ndarray:
    """Rows of bytes: plane p of bit planes holds bit p of each id, eight ids a
    byte; of byte planes, byte p of each id."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(raw.T[:planes])
    out = np.empty((planes, (len(ids) + 7) // 8), np.uint8)
    for b in range((planes + 7) // 8):
        byte = np.ascontiguousarray(raw[:, b])
        for p in range(8 * b, min(planes, 8 * b + 8)):
            out[p] = np.packbits(byte & np.uint8(1 << (p & 7)))
    return out


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    raw = ids.view(np.uint8).reshape(-1, 4)
    for p, row in enumerate(planes):
        if kind == "byte":
            raw[:, p] = row
        else:
            raw[:, p >> 3] |= np.unpackbits(row, count=n) << np.uint8(p & 7)
    return ids


def pack(ids: np.ndarray, block_ids: int, kind: str, level: int = 1) -> tuple[int, bytes, bytes]:
    """(planes, compressed bytes of each block's planes as u4, payload)."""
    top = int(ids.max(initial=0))
    planes = max(1, -(-top.bit_length() // (8 if kind == "byte" else 1)))
    press, sizes, payload = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block_ids):
        for row in to_planes(ids[at : at + block_ids], planes, kind):
            payload.append(press.compress(row.tobytes()))
            sizes.append(len(payload[-1]))
    return planes, np.array(sizes, "<u4").tobytes(), b"".join(payload)


def unpack(n_ids: int, block_ids: int, planes: int, kind: str, plane_bytes: bytes, payload: bytes) -> np.ndarray:
    sizes = np.frombuffer(plane_bytes, "<u4").reshape(-1, planes)
    press, at, out = zstandard.ZstdDecompressor(), 0, []
    view = memoryview(payload)
    for block, of in enumerate(sizes):
        n = min(block_ids, n_ids - block * block_ids)
        rows = []
        for size in of:
            rows.append(np.frombuffer(press.decompress(view[at : at + int(size)]), np.uint8))
            at += int(size)
        out.append(from_planes(np.stack(rows), n, kind))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, end_id: int = END_ID) -> None:
    """Encodes the texts of ``docs`` (doc_id, text) and writes the files.
    ``tokenizer``: path of a tokenizers JSON file that executors can read."""

    def run(batches):
        part, made, doc_ids, ids = TaskContext.get().partitionId(), 0, [], []
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.kind).tobytes(), enc.kind.itemsize
        held = 0

        def chunk():
            every = np.frombuffer(b"".join(ids), enc.kind)
            planes, sizes, payload = pack(every, block_ids, kind)
            row = [part, made, doc_ids[0], len(doc_ids), len(every), block_ids, planes, kind, np.array(doc_ids, "<i8").tobytes(), np.array([len(x) // width for x in ids], "<i8").tobytes(), sizes, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                doc_ids.append(doc.as_py())
                ids.append(enc.encode(text.as_py() or "") + end)
                held += len(ids[-1]) // width
                if held >= chunk_ids:
                    yield chunk()
                    doc_ids, ids, held, made = [], [], 0, made + 1
        if doc_ids:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    # ranges from the ids alone: repartitionByRange would read the texts once more for its sample
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    range_of = F.lit(0) if not bounds else F.size(F.filter(F.lit(bounds), lambda x: x <= F.col("doc_id")))
    rows = rows.repartitionById(len(bounds) + 1, range_of).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def _decoded(rows: pa.RecordBatch):
    """(ids of the chunk, ends and lengths of its documents, the row's fields)."""
    for r in rows.to_pylist():
        every = unpack(r["n_ids"], r["block_ids"], r["planes"], r["kind"], r["plane_bytes"], r["payload"])
        lengths = np.frombuffer(r["lengths"], "<i8")
        yield every, np.cumsum(lengths), lengths, r


def _numbered(r: dict, ends: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    n = len(ends)
    return [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["chunk"], np.int32)), pa.array(ends - lengths), pa.array(np.frombuffer(r["doc_ids"], "<i8"))]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, before (ids of the chunk's documents before this one),
    doc_id, ids (binary, u4)."""

    def run(batches):
        for b in batches:
            for every, ends, lengths, r in _decoded(b):
                ids = pa.array([every[e - n : e].tobytes() for e, n in zip(ends, lengths)], pa.binary())
                yield pa.RecordBatch.from_arrays([*_numbered(r, ends, lengths), ids], names=["part", "chunk", "before", "doc_id", "ids"])

    return spark.read.parquet(path).mapInArrow(run, "part int, chunk int, before long, doc_id long, ids binary")


def chunk_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk, start: ids of all chunks before, from the index columns
    alone. Parts are totalled first, so one task sees a row for each part only."""
    index = spark.read.parquet(path).select("part", "chunk", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("inside", inside).join(parts.select("part", before.alias("before")), "part").select("part", "chunk", (F.col("before") + F.col("inside")).alias("start"))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), all from the files."""

    def run(batches):
        for b in batches:
            for every, ends, lengths, r in _decoded(b):
                crc = [zlib.crc32(every[e - n : e]) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([*_numbered(r, ends, lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "chunk", "before", "doc_id", "n_tokens", "ids_crc32"])

    docs = spark.read.parquet(path).mapInArrow(run, "part int, chunk int, before long, doc_id long, n_tokens long, ids_crc32 long")
    return docs.join(chunk_starts(spark, path), ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
