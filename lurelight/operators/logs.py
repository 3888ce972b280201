"""Certificate-transparency log lists, selection, cursors and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.binary import log_id_of_key
from ..reference import Reference, compact
from .places import Ordered

STATES = ["usable", "qualified", "readonly", "retired", "rejected"]
MANY = "Multiple operators"
PLACEHOLDER_HOST = "ct.example.com"

_LOG_JSON = "description:string,key:string,log_id:string,url:string,submission_url:string,monitoring_url:string,state:map<string,struct<timestamp:string>>,temporal_interval:struct<start_inclusive:string,end_exclusive:string>"
LIST_A = f"operators array<struct<name:string,logs:array<struct<{_LOG_JSON}>>,tiled_logs:array<struct<{_LOG_JSON}>>>>"
LIST_B = "log_id string, key string, operator string, description string, protocol string, url string, submission_url string, monitoring_url string, state string, not_after_start string, not_after_limit string"


def slashed(url: Column) -> Column:
    """With exactly the slash at the end that may be missing."""
    return F.when(F.endswith(url, F.lit("/")), url).when(url != "", F.concat(url, F.lit("/"))).otherwise(F.lit(""))


def log_state(state: Column) -> Column:
    """The first known state that a log's state object holds; usable by default."""
    out = F.lit("usable")
    for s in reversed(STATES):
        out = F.when(F.coalesce(F.map_contains_key(state, s), F.lit(False)), s).otherwise(out)
    return F.when(state.isNull(), "usable").otherwise(out)


def parse_list_a(operators: DataFrame, refreshed_at: Column) -> DataFrame:
    """Logs of the operators' two arrays; the array tells the protocol. ``place``
    keeps the order of the list: operators, their logs, their tiled logs."""
    op = operators.select(F.posexplode("operators").alias("n", "o")).select("n", F.coalesce(text.truthy(F.col("o.name")), F.lit("Unknown Operator")).alias("operator"), "o.logs", "o.tiled_logs")

    def of(array: str, protocol: str, submit: Column, monitor: Column) -> DataFrame:
        place = (F.col("n") * 2 + int(array == "tiled_logs")).cast("long") * 2**31 + F.col("i")
        return op.select("n", "operator", F.posexplode(array).alias("i", "l")).select(
            F.coalesce(text.truthy(F.col("l.log_id")), log_id_of_key(F.col("l.key"))).alias("log_id"), "operator", F.coalesce("l.description", F.lit("")).alias("description"), F.lit(protocol).alias("protocol"),
            slashed(submit).alias("submission_url"), slashed(monitor).alias("monitoring_url"), F.coalesce("l.key", F.lit("")).alias("public_key_der"), log_state(F.col("l.state")).alias("state"),
            text.truthy(F.col("l.temporal_interval.start_inclusive")).alias("not_after_start"), text.truthy(F.col("l.temporal_interval.end_exclusive")).alias("not_after_limit"), refreshed_at.alias("refreshed_at"),
            place.alias("place"),
        )

    url = F.coalesce("l.url", F.lit(""))
    tiled = of("tiled_logs", "static-ct-api", F.coalesce(text.truthy(F.col("l.submission_url")), url), F.coalesce(text.truthy(F.col("l.monitoring_url")), url))
    return of("logs", "rfc6962", url, url).unionByName(tiled)


def parse_list_b(logs: DataFrame, refreshed_at: Column) -> DataFrame:
    """A flat list; static if it says so or has a monitoring address. A column
    ``place``, the order of the list, stays."""
    static = F.coalesce(F.col("protocol") == "static-ct-api", F.lit(False)) | text.truthy(F.col("monitoring_url")).isNotNull()
    url = F.coalesce(text.truthy(F.col("submission_url")), F.col("url"), F.lit(""))
    return logs.select(
        F.coalesce(text.truthy(F.col("log_id")), log_id_of_key(F.col("key"))).alias("log_id"), F.coalesce(text.truthy(F.col("operator")), F.lit(MANY)).alias("operator"), F.coalesce("description", F.lit("")).alias("description"),
        F.when(static, "static-ct-api").otherwise("rfc6962").alias("protocol"), slashed(url).alias("submission_url"), slashed(F.coalesce(text.truthy(F.col("monitoring_url")), url)).alias("monitoring_url"),
        F.coalesce("key", F.lit("")).alias("public_key_der"), F.coalesce(text.truthy(F.col("state")), F.lit("usable")).alias("state"), text.truthy(F.col("not_after_start")).alias("not_after_start"), text.truthy(F.col("not_after_limit")).alias("not_after_limit"),
        refreshed_at.alias("refreshed_at"), *(["place"] if "place" in logs.columns else []),
    )


def merge_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """All logs of both lists by id. Of an id that the first list repeats, its last
    row stands; rows of the second follow in their order: where there is no row yet
    the first of them stands, every static row lends its protocol and monitoring
    address, and an operator is taken where none in particular is known. The order
    is the column ``place``; rows without one, or of equal places, are ordered by
    their fields. Blank ids are dropped."""
    names = [c for c in first.columns if c != "place"]
    rest = [c for c in names if c != "log_id"]

    def ordered(d: DataFrame) -> DataFrame:
        place = F.col("place") if "place" in d.columns else F.lit(None).cast("long")
        return d.filter("log_id <> ''").select("log_id", F.struct(place.cast("long").alias("place"), *rest).alias("at"))

    static, named = F.col("at.protocol") == "static-ct-api", F.col("at.operator") != MANY
    a = ordered(first).groupBy("log_id").agg(F.max("at").alias("at"))
    b = ordered(second).groupBy("log_id").agg(F.min("at").alias("head"), F.max(F.when(static, F.col("at"))).alias("static"), F.min(F.when(named, F.col("at"))).alias("named"))
    both = a.join(b, "log_id", "full_outer").withColumn("base", F.coalesce("at", "head"))
    pick = {c: F.col(f"base.{c}") for c in rest} | {"log_id": F.col("log_id")}
    for c in ("protocol", "monitoring_url"):
        pick[c] = F.when(F.col("static").isNotNull(), F.col(f"static.{c}")).otherwise(pick[c])
    pick["operator"] = F.when(F.col("base.operator") == MANY, F.coalesce("named.operator", F.lit(MANY))).otherwise(pick["operator"])
    return both.select(*[pick[c].alias(c) for c in names])


def overlaps(start: Column, limit: Column, now: Column) -> Column:
    """Whether [start, limit) meets the time from a day before to 400 days after."""
    lo, hi = now - F.expr("INTERVAL 1 DAY"), now + F.expr("INTERVAL 400 DAYS")
    s, e = F.try_to_timestamp(start), F.try_to_timestamp(limit)
    return F.when(F.coalesce(text.truthy(start), text.truthy(limit)).isNull(), True).otherwise(F.coalesce(F.greatest(lo, s) < F.least(hi, e), F.lit(False)))


def selected(logs: DataFrame, now: Column) -> DataFrame:
    return logs.filter(F.lower("state").isin("qualified", "usable") & overlaps(F.col("not_after_start"), F.col("not_after_limit"), now))


def legacy_logs(logs: DataFrame, now: Column) -> DataFrame:
    """Readable logs over https, by operator and description as readers order them
    (the Unicode collation: apple before Banana), with their ``place``."""
    ok = F.startswith("submission_url", F.lit("https://")) & F.col("state").isin("usable", "qualified", "readonly")
    ok &= ~F.contains("submission_url", F.lit(PLACEHOLDER_HOST)) & overlaps(F.col("not_after_start"), F.col("not_after_limit"), now)
    said = F.collate(F.concat_ws(" ", "operator", "description"), "UNICODE")
    return Ordered(logs.filter(ok).drop("place"), [said, F.col("log_id")]).numbered().orderBy("place")


def fetch_range(next_index: Column, size: Column, tail: int = 256, batch: int = 48) -> Column:
    """struct(start, end): the entries that one run reads of an indexed log."""
    start = F.when(next_index.isNotNull(), F.least(next_index, size)).otherwise(F.greatest(F.lit(0), size - tail))
    return F.struct(start.alias("start"), F.least(size - 1, start + batch - 1).alias("end"))


def tile_range(next_index: Column, size: Column, tail: int = 512, tiles: int = 20, width: int = 256) -> Column:
    """struct(first, last, cursor, lag): tiles to read and the cursor after them."""
    start = F.when(next_index.isNotNull(), F.least(next_index, size)).otherwise(F.greatest(F.lit(0), size - tail))
    first = F.floor(start / width)
    last = F.least(first + tiles - 1, F.floor((size - 1) / width))
    cursor = F.greatest(start, F.least(size, (last + 1) * width))
    return F.struct(first.alias("first"), last.alias("last"), cursor.alias("cursor"), F.greatest(F.lit(0), size - cursor).alias("lag"))


def round_robin(rows: DataFrame, order: list[str], start: int, batch: int) -> DataFrame:
    """``batch`` rows from place ``start`` on, wrapping around, with ``place`` and
    the ``next_index``. Only the ranges of rows that hold those places are ordered."""
    every = Ordered(rows, order)
    n = every.n
    if not n:
        return rows.withColumns({"place": F.lit(0).cast("long"), "next_index": F.lit(0).cast("long")})
    at, most = start % n, min(batch, n)
    out = every.numbered(at, min(at + most, n))
    if at + most > n:
        out = out.unionByName(every.numbered(0, at + most - n))
    return out.withColumn("next_index", F.lit((start + batch) % n).cast("long"))


def poll_token_frame(schemes: DataFrame, brands: DataFrame) -> DataFrame:
    """``poll_tokens`` over the tables as DataFrames (tokens)."""
    of = lambda d: d.select(F.explode("tokens").alias("t")).select(text.ingest_compact(F.col("t")).alias("token"))
    return of(schemes).union(of(brands).filter("length(token) >= 3")).filter("token <> ''").distinct().orderBy("token")


def poll_tokens(ref: Reference) -> list[str]:
    """What an identity search asks for: lure tokens, and brand tokens of three
    characters or more, compact, distinct, in binary order."""
    tokens = [compact(t) for s in ref.schemes for t in s.tokens] + [c for b in ref.brands for t in b.tokens if len(c := compact(t)) >= 3]
    return sorted({t for t in tokens if t})


def search_window(rows: DataFrame, token: str, at: str, as_of: Column, days: int = 14, most: int = 15, order: str = "id") -> DataFrame:
    """Rows inside the lookback, or without a readable time; the first ones of
    each token. The window filter is a group limit: tasks drop early."""
    kept = rows.filter(F.col(at).isNull() | (F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS")))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(token).orderBy(order))).filter(F.col("rank") <= most)


def merge_state(state: Column, *patches: Column) -> Column:
    """Maps merged key by key; later patches win."""
    out = state
    for p in patches:
        out = F.map_concat(_without(out, p), p)
    return out


def _without(state: Column, patch: Column) -> Column:
    return F.map_filter(state, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
