"""Verified checkpoints of logs, and polls of static logs that trust no other size.

A checkpoint is a signed note: origin, tree size and root hash, then lines of
signatures. The key of the log's list entry verifies it: as a signature over the note's
text, or over the tree head that the note stands for, which is rebuilt from size, root
and the signature's time. Notes come a few to a log, so the arithmetic runs in Arrow
batches of short rows; everything else stays in the plan.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary, signing
from ..operators.logs import tile_range
from . import decode

WIDTH = 256


def _decoded(text: str | None) -> bytes:
    """Base64, with or without padding."""
    text = (text or "").strip()
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return b""


def tree_head(stamp: int, size: int, root: bytes) -> bytes:
    """The signed structure of a tree head: version, type, time, size, root."""
    return b"\0\1" + stamp.to_bytes(8, "big") + size.to_bytes(8, "big") + root


def signed_by(body: str, size: int, root: str, signature: str, key) -> bool:
    """Whether one signature of a note holds, in any of its three forms."""
    given, root_hash = _decoded(signature), _decoded(root)
    rest = given[4:] if len(given) > 4 else given  # behind the key's hint
    if signing.verify(body.encode(), rest, key) or (len(rest) == 64 and signing.verify(body.encode(), rest, key, raw=True)):
        return True
    if len(given) < 18 or len(root_hash) != 32 or not 0 <= size < 1 << 64:
        return False
    return signing.verify(tree_head(int.from_bytes(given[4:12], "big"), size, root_hash), given[16:], key)


def _reason(note, key: str | None) -> str | None:
    if note is None:
        return "malformed"
    if not key:
        return "missing_public_key"
    if note["signatures"] is None or not len(note["signatures"]):
        return "missing_signatures"
    try:
        public = signing.public_key(_decoded(key))
    except ValueError:
        return "verification_error"
    body = note["body"] + "\n"  # the blank line belongs to the signed text
    ok = any(s["signature"] and signed_by(body, int(note["tree_size"]), note["root_hash"], s["signature"], public) for s in note["signatures"])
    return None if ok else "signature_mismatch"


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to some tasks for each core. Spark counts bytes when it makes
    tasks, but signatures are short and take a millisecond or more each."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def verified(notes: DataFrame, note: str = "note", key: str = "public_key_der") -> DataFrame:
    """``notes`` with ok, reason (null where it is ok), origin, tree_size and
    root_hash. A null note is malformed, a null key is missing."""
    d = spread(notes).withColumn("_note", binary.checkpoint(F.col(note)))
    kept = [f for f in notes.schema if f.name not in ("ok", "reason", "origin", "tree_size", "root_hash")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [n if n is not None else None for n in pdf["_note"]]
            pdf["reason"] = [_reason(n, k) for n, k in zip(read, pdf[key])]
            pdf["ok"] = pdf["reason"].isnull()
            for c in ("origin", "root_hash"):
                pdf[c] = [n[c] if n is not None else None for n in read]
            pdf["tree_size"] = pd.array([n["tree_size"] if n is not None else None for n in read], "Int64")
            yield pdf[[*(f.name for f in kept), "ok", "reason", "origin", "tree_size", "root_hash"]]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return d.select(*[F.col(f"`{f.name}`") for f in kept], "_note").mapInPandas(run, f"{ddl}, ok boolean, reason string, origin string, tree_size long, root_hash string")


def static_poll(logs: DataFrame, notes: DataFrame, cursors: DataFrame, tiles: DataFrame | Callable[[DataFrame], DataFrame], tail: int = 512, most: int = 20) -> dict[str, DataFrame]:
    """One poll of static logs, each by itself: a log whose checkpoint fails gives an
    error and keeps its cursor, the others go on.

    ``logs``: log, description, operator, submission_url, monitoring_url,
    public_key_der; ``notes``: log, note; ``cursors``: log, next_index; ``tiles``: log,
    tile_index, tile, of which a log's poll reads at most ``most`` from its cursor
    (from ``tail`` entries before the end at first) and stops before the first that is
    missing. Instead of a table ``tiles`` may be a function that fetches: it gets the rows
    that are asked for (log, tile_index and others; one without an index for a log that
    asks for none) and returns them with their tile, null where it is missing. Gives
    entries (schemas.ENTRY), cursors (log, next_index, tree_size, lag) of the logs that
    were read, and errors (log, message). The cursors take one pass: each checkpoint is
    verified once for them."""
    heads = verified(logs.join(notes, "log", "left"))
    heads = heads.join(cursors.select("log", "next_index"), "log", "left")
    failed = heads.filter(~F.col("ok")).select("log", F.concat(F.lit("checkpoint_signature_invalid: "), "reason").alias("message"))
    span = tile_range(F.col("next_index"), F.col("tree_size"), tail, most, WIDTH)
    start = F.when(F.col("next_index").isNotNull(), F.least("next_index", "tree_size")).otherwise(F.greatest(F.lit(0), F.col("tree_size") - tail))
    good = heads.filter("ok").select("log", "tree_size", start.cast("long").alias("cursor"), span.alias("span"), "description", "operator", "submission_url", "monitoring_url")
    asked = F.when((F.col("cursor") < F.col("tree_size")) & (F.col("span.first") <= F.col("span.last")), F.sequence("span.first", "span.last")).otherwise(F.array().cast("array<bigint>"))
    want = good.withColumn("tile_index", F.explode_outer(asked)).drop("span")
    if callable(tiles):
        want = tiles(want).withColumn("_there", F.col("tile").isNotNull())
    else:
        have = tiles.select("log", "tile_index", "tile", F.col("tile").isNotNull().alias("_there"))
        want = want.join(have, ["log", "tile_index"], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    gap = F.min(F.when(~F.col("_there"), F.col("tile_index")))  # the first that is missing
    to = want.groupBy("log", "tree_size", "cursor").agg(F.coalesce(gap, F.max("tile_index") + 1).alias("end"))
    after = F.greatest("cursor", F.coalesce(F.least("tree_size", F.col("end") * WIDTH), F.col("cursor")))
    moved = to.select("log", after.alias("next_index"), "tree_size", (F.col("tree_size") - after).alias("lag"))
    stop = want.groupBy("log").agg(gap.alias("stop"))
    read = want.join(stop, "log", "left").filter("_there and (stop is null or tile_index < stop)")
    rows = read.select("tile", (F.col("tile_index") * WIDTH).alias("base_index"), "cursor", "description", "operator", "submission_url", "monitoring_url")
    return {"entries": decode.log_tiles(rows), "cursors": moved, "errors": failed}
