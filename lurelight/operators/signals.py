"""Signals of a host: watched brands, keywords, seasonal lures.

Reference tables are literals of the plan, so all of it is a projection: nothing
is joined or shuffled, however many hosts there are. A table goes into the plan as
one JSON string, which the optimizer reads once: a literal for each of its cells
would take longer to build than thousands of hosts to score. A signal is a struct
of ``schemas.SIGNAL``; fields that do not apply are null.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import distance, suffix, text
from ..reference import Reference, compact


def signal(kind: str | Column, points: int | Column, **fields: Column | None) -> Column:
    every = {"type": F.lit(kind) if isinstance(kind, str) else kind, "points": F.lit(points) if isinstance(points, int) else points, **fields}
    made = [(every[f.name] if every.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SIGNAL]
    return F.struct(*made)


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.array().cast("array<string>")


def no_signals() -> Column:
    return F.array().cast(f"array<{schemas.SIGNAL.simpleString()}>")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that are worked out once a row. The optimizer would
    write their expressions into all that read them; a generator of one row
    stands between."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", one).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def preparations(host: str, suffixes: Sequence[str]) -> list[dict[str, Column]]:
    """Columns that signals read, in steps: registrable and compact host; then
    suffix and labels, which read those."""
    h = F.col(host)
    pieces = lambda labels: F.transform(labels, lambda x: F.regexp_replace(x, text.COMPACT, ""))
    return [
        {"registrable": suffix.registrable(h, suffixes), "host_compact": F.regexp_replace(h, text.COMPACT, "")},
        {
            "suffix": F.coalesce(F.substr("registrable", F.instr("registrable", ".") + 1), F.lit("")),
            "labels": pieces(F.split(h, "\\.")),
            "sub_labels": pieces(suffix.subdomain_labels(h, F.col("registrable"))),
        },
    ]


def prepared(hosts: DataFrame, host: str, ref: Reference) -> DataFrame:
    """``hosts`` with the columns that signals read. Rows stay where they are."""
    return prepared_by(hosts, host, ref.suffixes)


def prepared_by(hosts: DataFrame, host: str, suffixes: Sequence[str]) -> DataFrame:
    for step in preparations(host, suffixes):
        hosts = once(hosts, step)
    return hosts


_TOKENS = "array<struct<token:string,compact:string,most:int,parts:array<array<string>>>>"
_BRAND = f"array<struct<id:string,display:string,gated:boolean,context:array<string>,tokens:{_TOKENS},tlds:array<string>,regs:array<string>>>"
_KEYWORD = "array<struct<token:string,compact:string,category:string>>"
_SCHEME = f"array<struct<id:string,display:string,start:string,end:string,tokens:{_TOKENS}>>"


def table(rows: list[dict], schema: str) -> Column:
    """Rows of a reference table as one value of the plan."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _tokens(tokens, most) -> list[dict]:
    return [{"token": t, "compact": (c := compact(t)), "most": most(c), "parts": distance.traces(c, most(c))} for t in tokens]


def _brand_rows(ref: Reference) -> Column:
    """Brands with all that their signals need."""
    rows = [
        {"id": b.id, "display": b.display, "gated": b.require_context, "context": [compact(t) for t in b.context_tokens], "tokens": _tokens(b.tokens, b.distance), "tlds": list(b.known_tlds), "regs": ref.verified(b.id)}
        for b in ref.brands
    ]
    return table(rows, _BRAND)


def fuzzy(labels: Column, t: Column) -> Column:
    """Whether a label holds the token within ``most`` (0 to 2) edits. The bound
    is a value, so each form stands behind its own test. Parts that any such text
    holds are looked for first, in the whole host, then in the label."""
    token, most = t["compact"], t["most"]

    def held(x: Column) -> Column:
        windows = F.when(most == 1, distance.window_within(x, token, 1)).otherwise(distance.window_within(x, token, 2))
        return F.when(most == 0, (x != "") & (F.instr(x, token) > 0)).when(distance.may_hold(x, t["parts"]), windows).otherwise(False)

    return F.when(distance.may_hold(F.col("host_compact"), t["parts"]), F.exists(labels, held)).otherwise(False)


def brand_signals(ref: Reference, host: Column) -> Column:
    """Array of signals, by brand in table order. A brand's first matching token
    gives its signals: exact or fuzzy, then squat, path position, suffix. Affix
    forms of labels add nothing (each is a part of its label, and labels are
    searched for parts), so labels are matched as they are."""
    if not ref.brands:
        return no_signals()
    w, hc = ref.scoring.weights, F.col("host_compact")

    def exact(t: Column) -> Column:
        return F.instr(hc, t["compact"]) > 0

    def found(b: Column) -> Column:
        gate = ~b["gated"] | F.exists(b["context"], lambda c: F.instr(hc, c) > 0)
        return F.when(gate, F.get(F.filter(b["tokens"], lambda t: exact(t) | fuzzy(F.col("labels"), t)), F.lit(0)))

    def signals_of(b: Column, t: Column) -> Column:
        return brand_signals_of(b, t["token"], exact(t), fuzzy(F.col("sub_labels"), t), host, w)

    return F.flatten(F.transform(_hits(_brand_rows(ref), found), lambda h: signals_of(h["row"], h["token"])))


def brand_signals_of(b, token: Column, whole: Column, squat: Column, host: Column, w: dict[str, int]) -> Column:
    """Signals of a brand (id, display, tlds, regs) by its first matching token:
    whether the whole host holds it, and whether a subdomain label squats it."""
    path = F.exists(b["regs"], lambda r: F.startswith(host, F.concat(r, F.lit("."))) | (F.instr(host, F.concat(F.lit("."), r, F.lit("."))) > 0))
    odd = (F.size(b["tlds"]) > 0) & ~F.array_contains(b["tlds"], F.col("suffix"))
    about = {"brand": b["id"], "display": b["display"], "token": token}
    return F.filter(
        F.array(
            signal(F.when(whole, "brand:exact").otherwise("brand:fuzzy"), F.when(whole, w["brand:exact"]).otherwise(w["brand:fuzzy"]), **about),
            F.when(squat, signal("subdomain_brand_squat", w["subdomain:brand_squat"], **about)),
            F.when(path, signal("brand_in_path_position", w["brand_in_path_position"], **about)),
            F.when(odd, signal("tld:mismatch", w["tld:mismatch"], brand=b["id"], expected=b["tlds"], actual=F.col("suffix"))),
        ),
        lambda s: s.isNotNull(),
    )


def _hits(rows: Column, found) -> Column:
    """The rows with a matching token, as struct(row, token); most rows have none,
    and only those left are made into signals."""
    return F.filter(F.transform(rows, lambda r: F.struct(r.alias("row"), found(r).alias("token"))), lambda h: h["token"].isNotNull())


def keyword_signals(ref: Reference) -> Column:
    """Hits in table order, each worth ``kw`` points until ``keyword_cap`` is
    used up; hits without points are left out."""
    if not ref.keywords:
        return no_signals()
    each, cap = ref.scoring.weights["kw"], ref.scoring.weights["keyword_cap"]
    rows = table([{"token": k.token, "compact": compact(k.token), "category": k.category} for k in ref.keywords], _KEYWORD)
    hits = F.filter(rows, lambda k: F.instr(F.col("host_compact"), k["compact"]) > 0)
    worth = F.transform(hits, lambda k, i: signal("kw", F.greatest(F.lit(0), F.least(F.lit(each), F.lit(cap) - i * each)), token=k["token"], category=k["category"]))
    return F.filter(worth, lambda s: s["points"] > 0)


def scheme_signals(ref: Reference, as_of: Column) -> Column:
    """Lures by table order: the first token that the whole compact host holds
    within the table's edits, and a boost inside the lure's season."""
    if not ref.schemes:
        return no_signals()
    w, hc = ref.scoring.weights, F.col("host_compact")
    rows = table([{"id": s.id, "display": s.display, "start": s.start, "end": s.end, "tokens": _tokens(s.tokens, lambda _, s=s: s.max_edit_distance)} for s in ref.schemes], _SCHEME)

    def found(s: Column) -> Column:
        def held(t: Column) -> Column:
            windows = F.when(t["most"] == 1, distance.window_within(hc, t["compact"], 1)).when(t["most"] == 2, distance.window_within(hc, t["compact"], 2)).otherwise(False)
            return (F.instr(hc, t["compact"]) > 0) | (distance.may_hold(hc, t["parts"]) & windows)

        return F.get(F.filter(s["tokens"], held), F.lit(0))

    return F.flatten(F.transform(_hits(rows, found), lambda h: scheme_signals_of(h["row"], h["token"]["token"], as_of, w)))


def scheme_signals_of(s, token: Column, as_of: Column, w: dict[str, int]) -> Column:
    """Signals of a lure (id, display, start, end) by its first matching token."""
    season = F.coalesce(as_of.between(F.try_to_timestamp(s["start"]), F.try_to_timestamp(s["end"])), F.lit(False))
    about = {"scheme": s["id"], "display": s["display"], "token": token}
    return F.filter(F.array(signal("scheme", w["scheme"], **about), F.when(season, signal("scheme_seasonal_boost", w["scheme_seasonal_boost"], **about))), lambda x: x.isNotNull())
