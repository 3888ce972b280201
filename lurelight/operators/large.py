"""Scores against reference tables that are too large for a plan.

``operators.signals`` writes its tables into the plan, so they have at most
``reference.MOST_ROWS`` rows. Here tables are DataFrames of any size, and hosts meet
them by equality of short pieces, never by trying all tokens:

* Within k edits, one of a token's signatures stays whole. Of k + 1 parts of the token
  one survives k edits, but for a swap across a limit between parts; what such a swap
  leaves is known letter by letter, so the swapped text is a signature too. For k = 0
  the first characters are the signature.
* The signatures are an inverted index. The pieces of a text that have a signature's
  length are looked up in it, and only the stretch of the text around a piece is
  compared with the token.
* The index is broadcast while it has at most ``INDEX_ROWS`` rows; beyond that the
  pieces are shuffled to it, and a signature of very many tokens is dealt to several
  tasks. The rows are the same.

Tables have a column ``place``, their order. Tokens without a letter or digit are left
out. A host of any length is one row, and so is each of its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reference, schemas
from ..functions import distance, text
from ..reference import Reference, Scoring
from . import score
from . import signals as sig

#: First characters of a token that is looked for as it is.
LEAD = 5
#: Rows of a table that is broadcast: some 10 MB of signatures.
INDEX_ROWS = 200_000
#: Tokens of one signature in a task, about, where the index is shuffled.
DEALT = 256


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if it has at most so many rows."""
    most = INDEX_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tables(spark: SparkSession, ref: Reference) -> dict[str, DataFrame]:
    """A reference's tables as DataFrames with their places."""

    def placed(name: str, schema) -> DataFrame:
        rows = reference.frames(spark, ref)[name].collect()  # of a Reference, at most MOST_ROWS
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}")

    return {"brands": placed("brands", schemas.BRAND), "keywords": placed("keywords", schemas.KEYWORD), "schemes": placed("schemes", schemas.SCHEME), "allowlist": placed("allowlist", schemas.ALLOWED)}


def compacted(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), text.COMPACT, "")


def tokens_of(rows: DataFrame, most) -> DataFrame:
    """place, tok (the token's place in its row), token, compact, most: a row for
    each token. ``most`` gives the edits from the compact token's length."""
    d = rows.select("*", F.posexplode("tokens").alias("tok", "token")).withColumn("compact", compacted(F.col("token"))).filter("compact <> ''")
    return d.select("place", "tok", "token", "compact", most(F.length("compact")).cast("int").alias("most"))


def brand_edits(n: Column) -> Column:
    """Edits allowed for a brand's token: none up to two characters, one up to five."""
    asked = F.col("max_edit_distance")
    return F.when(n <= 2, 0).when(n <= 5, F.least(F.coalesce(asked, F.lit(1)), F.lit(1))).otherwise(F.coalesce(asked, F.lit(2)))


def _swapped(t: Column, at: Column) -> Column:
    """``t`` with the characters before and after the limit ``at`` exchanged."""
    one = F.lit(1)
    return F.concat(F.left(t, at - 1), F.substr(t, at + 1, one), F.substr(t, at, one), F.substr(t, at + 2))


def signatures(tokens: DataFrame) -> DataFrame:
    """``tokens`` (compact, most, ...) with sig and at, the offset that it has in
    the token; a row for each signature. More than two edits have none."""
    t, n = F.col("compact"), F.length("compact")
    of = lambda s, at: F.struct(s.alias("sig"), at.cast("int").alias("at"))
    cut = lambda a, b: F.substr(t, a + 1, b - a)
    zero, half, c, d = F.lit(0), F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    one = [of(cut(zero, half), zero), of(cut(half, n), half), of(F.when(n > 1, _swapped(t, half)), zero)]
    two = [of(cut(zero, c), zero), of(cut(c, d), c), of(cut(d, n), d)]
    both = F.when((c > 0) & (d > c), _swapped(t, c))
    two += [of(F.left(both, d), zero), of(F.when((d > c) & (n > d), F.substr(_swapped(t, d), c + 1)), c), of(F.when(d - c > 1, _swapped(both, d)), zero)]
    every = F.when(F.col("most") == 0, F.array(of(F.left(t, F.lit(LEAD)), zero))).when(F.col("most") == 1, F.array(*one)).when(F.col("most") == 2, F.array(*two))
    return tokens.select("*", F.explode(F.array_distinct(every)).alias("_s")).select("*", "_s.*").drop("_s").filter("sig is not null")


def within_edits(x: Column, token: Column, most: Column) -> Column:
    """Whether the text holds the token within ``most`` edits (0 to 2)."""
    two = F.when(most == 2, distance.window_within(x, token, 2)).otherwise(False)
    return F.when(most == 0, F.instr(x, token) > 0).when(most == 1, distance.window_within(x, token, 1)).otherwise(two)


def pieces(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """text, p, sig: all stretches of the texts (text) that have one of the sizes,
    with their places from 1; an empty one once."""
    n = F.length("text")
    at = lambda i, s: F.struct(i.alias("p"), s.alias("sig"))
    some = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: at(i, F.substr("text", i, size)))
    cut = lambda size: F.when(size == 0, F.array(at(F.lit(1), F.lit("")))).otherwise(some(size))
    known = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda size: size <= n)
    return texts.select("text").distinct().select("text", F.explode(F.flatten(F.transform(known, cut))).alias("_p")).select("text", "_p.*")


def _met(found: DataFrame, index: DataFrame) -> DataFrame:
    """Pieces with the index's rows of their signature."""
    marked = small(index)
    if marked is not index:
        return found.join(marked, "sig")
    hot = index.groupBy("sig").agg(F.ceil(F.count("*") / DEALT).alias("parts")).filter("parts > 1")  # at most one in DEALT signatures
    hot, parts = small(hot), F.coalesce("parts", F.lit(1)).cast("int")
    dealt = index.join(hot, "sig", "left").withColumn("part", F.pmod(F.xxhash64("compact"), parts).cast("int")).drop("parts")
    asked = found.join(hot, "sig", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return asked.join(dealt, ["sig", "part"]).drop("part")


def held(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """text, place, tok: the tokens (place, tok, compact, most) that each text
    holds within their edits."""
    index = signatures(tokens.select("place", "tok", "compact", "most"))
    sizes = sorted(r[0] for r in index.select(F.length("sig")).distinct().collect())  # lengths of parts of tokens
    if not sizes:
        return texts.select("text").limit(0).join(tokens.select("place", "tok").limit(0), F.lit(True))
    found = _met(pieces(texts, sizes), index)
    t, k, n = F.col("compact"), F.col("most"), F.length("compact")
    begin = F.col("p") - F.col("at") - k
    first = F.greatest(begin, F.lit(1))
    stretch = F.when(F.col("sig") == "", F.col("text")).otherwise(F.substr("text", first, begin + n + 2 * k - first))
    whole = F.when(k == 0, F.substr("text", F.col("p"), n) == t).otherwise(within_edits(F.col("_x"), t, k))
    room = F.when(F.col("sig") == "", True).otherwise(F.length("_x") >= n - k)
    return found.withColumn("_x", stretch).filter(room & whole).select("text", "place", "tok").distinct()


def _brand_rows(brands: DataFrame, allowlist: DataFrame) -> DataFrame:
    regs = allowlist.filter("verified").groupBy(F.col("brand").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("place", "registrable")))["registrable"].alias("regs"))
    d = brands.join(small(regs), F.col("id") == F.col("_of"), "left")
    none = F.array().cast("array<string>")
    return d.select(
        "place", "id", "display", F.coalesce("require_context", F.lit(False)).alias("gated"), F.transform(F.coalesce("context_tokens", none), compacted).alias("context"), F.coalesce("known_tlds", none).alias("tlds"), F.coalesce("regs", none).alias("regs")
    )


def brand_hits(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """host, place, tok, token, compact, most, exact: of each brand the first token that
    the host holds exactly, or one of its labels within the token's edits."""
    tokens = tokens_of(brands, brand_edits)
    whole = hosts.select("host", F.col("host_compact").alias("text"))
    parts = hosts.select("host", F.explode("labels").alias("text")).filter("text <> ''").distinct()
    exact = whole.join(held(whole, tokens.withColumn("most", F.lit(0))), "text").withColumn("exact", F.lit(True))
    near = parts.join(held(parts, tokens.filter("most > 0")), "text").withColumn("exact", F.lit(False))
    first = exact.unionByName(near).groupBy("host", "place").agg(F.min(F.struct("tok", (~F.col("exact")).alias("other"))).alias("m"))
    first = first.select("host", "place", "m.tok", (~F.col("m.other")).alias("exact"))
    return first.join(small(tokens), ["place", "tok"])


def _brand_signals(hosts: DataFrame, brands: DataFrame, allowlist: DataFrame, w: dict[str, int]) -> DataFrame:
    d = brand_hits(hosts, brands).join(small(_brand_rows(brands, allowlist)), "place").join(hosts.select("host", "host_compact", "sub_labels", "suffix"), "host")
    d = d.filter(~F.col("gated") | F.exists("context", lambda c: F.instr(F.col("host_compact"), c) > 0))
    squat = F.exists("sub_labels", lambda x: (x != "") & within_edits(x, F.col("compact"), F.col("most")))
    b = {c: F.col(c) for c in ("id", "display", "tlds", "regs")}
    return d.select("host", F.lit(0).alias("family"), "place", sig.brand_signals_of(b, F.col("token"), F.col("exact"), squat, F.col("host"), w).alias("sigs"))


def _keyword_signals(hosts: DataFrame, keywords: DataFrame, w: dict[str, int]) -> DataFrame:
    """One row a host: its hits in table order up to the cap."""
    each, cap = w["kw"], w["keyword_cap"]
    rows = keywords.select("place", F.lit(0).alias("tok"), "token", "category", compacted(F.col("token")).alias("compact"), F.lit(0).alias("most")).filter("compact <> ''")
    whole = hosts.select("host", F.col("host_compact").alias("text"))
    hits = whole.join(held(whole, rows), "text").join(small(rows.select("place", "token", "category")), "place")
    every = hits.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "token", "category"))).alias("hits"))
    worth = F.transform("hits", lambda k, i: sig.signal("kw", F.greatest(F.lit(0), F.least(F.lit(each), F.lit(cap) - i * each)), token=k["token"], category=k["category"]))
    return every.select("host", F.lit(1).alias("family"), F.lit(0).cast("long").alias("place"), F.filter(worth, lambda s: s["points"] > 0).alias("sigs"))


def _scheme_signals(hosts: DataFrame, schemes: DataFrame, w: dict[str, int], as_of: Column) -> DataFrame:
    """The first token of each lure that the whole compact host holds."""
    asked = F.coalesce("max_edit_distance", F.lit(0))
    tokens = tokens_of(schemes, lambda n: F.when(asked.isin(1, 2), asked).otherwise(0))
    whole = hosts.select("host", F.col("host_compact").alias("text"))
    first = whole.join(held(whole, tokens), "text").groupBy("host", "place").agg(F.min("tok").alias("tok"))
    d = first.join(small(tokens.select("place", "tok", "token")), ["place", "tok"]).join(small(schemes.select("place", "id", "display", "active_window")), "place")
    s = {"id": F.col("id"), "display": F.col("display"), "start": F.col("active_window.start"), "end": F.col("active_window.end")}
    return d.select("host", F.lit(2).alias("family"), "place", sig.scheme_signals_of(s, F.col("token"), as_of, w).alias("sigs"))


def score_hosts(hosts: DataFrame, tables: dict[str, DataFrame], scoring: Scoring, suffixes: tuple[str, ...], as_of: Column, host: str = "host") -> DataFrame:
    """What ``operators.score.score_hosts`` gives, with ``tables`` (brands, keywords,
    schemes, allowlist) as DataFrames. Each distinct host is scored once."""
    w, at = scoring.weights, as_of.cast("timestamp")
    base = sig.prepared_by(hosts.select(F.col(host).alias("host")).distinct(), "host", suffixes)
    allowed = tables["allowlist"].filter("verified").select("registrable").distinct().withColumn("_listed", F.lit(True))
    base = base.join(small(allowed), "registrable", "left").withColumn("_off", F.coalesce("_listed", F.lit(False))).drop("_listed")
    live = base.filter(~F.col("_off"))
    rows = _brand_signals(live, tables["brands"], tables["allowlist"], w).unionByName(_keyword_signals(live, tables["keywords"], w)).unionByName(_scheme_signals(live, tables["schemes"], w, at))
    of = lambda n: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("family") == n, F.struct("place", "sigs")))), lambda x: x["sigs"]))
    by_host = rows.groupBy("host").agg(of(0).alias("_brand"), of(1).alias("_kw"), of(2).alias("_scheme"))
    scored = base.select("host", "registrable", "_off").join(by_host, "host", "left").withColumns({c: F.coalesce(c, sig.no_signals()) for c in ("_brand", "_kw", "_scheme")})
    for step in score.totals(scoring, "host"):
        scored = sig.once(scored, step)
    scored = scored.select(F.col("host").alias(host), "registrable", "score", "scoring_version", "severity", "suppressed", "signals")
    return hosts.join(scored, host, "left")
