"""Scores of hosts and certificates."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..reference import Reference, Scoring
from . import signals as sig


def severity(score: Column, s: Scoring) -> Column:
    return F.when(score >= s.critical, "critical").when(score >= s.high, "high").when(score >= s.medium, "medium").when(score > 0, "low").otherwise("none")


def allowlisted(registrable: Column, ref: Reference) -> Column:
    names = ref.verified()
    return F.coalesce(registrable.isin(*names), F.lit(False)) if names else F.lit(False)


#: The latest expressions by table and column: building them takes longer than
#: scoring thousands of hosts, and every batch of a stream would build them anew.
_BUILT: dict[tuple[int, str], tuple] = {}


def _steps(ref: Reference, host: str) -> list[dict[str, Column]]:
    """The columns of a host's score, in steps that each read those before. They
    read ``_as_of``, so they serve any time."""
    context, found = SparkContext._active_spark_context, _BUILT.get((id(ref), host))
    if found and found[0] is ref and found[1] is context:
        return found[2]
    live = ~F.col("_off")
    steps = sig.preparations(host, ref.suffixes)
    steps.append({"_off": allowlisted(F.col("registrable"), ref)})
    steps.append(
        {
            "_brand": F.when(live, sig.brand_signals(ref, F.col(host))).otherwise(sig.no_signals()),
            "_kw": F.when(live, sig.keyword_signals(ref)).otherwise(sig.no_signals()),
            "_scheme": F.when(live, sig.scheme_signals(ref, F.col("_as_of"))).otherwise(sig.no_signals()),
        }
    )
    steps += totals(ref.scoring, host)
    while len(_BUILT) >= 8:
        _BUILT.pop(next(iter(_BUILT)))
    _BUILT[id(ref), host] = ref, context, steps
    return steps


def totals(scoring: Scoring, host: str) -> list[dict[str, Column]]:
    """The columns from the signals of brands, keywords and lures on (_brand, _kw,
    _scheme, _off), in steps."""
    w, steps = scoring.weights, []
    has_kw, has_brand = F.size("_kw") > 0, F.exists("_brand", lambda s: F.startswith(s["type"], F.lit("brand:")))
    combo = F.when(has_brand & has_kw, F.array(sig.signal("combo_brand_keyword", w["combo_brand_keyword"]))).when((F.size("_scheme") > 0) & has_kw, F.array(sig.signal("combo_scheme_keyword", w["combo_scheme_keyword"]))).otherwise(sig.no_signals())
    every = F.when(F.col("_off"), F.array(sig.signal("allowlist", 0, registrable=F.col("registrable")))).otherwise(F.concat("_brand", "_kw", "_scheme", combo))
    steps.append({"signals": F.transform(every, lambda s: s.withField("domain", F.col(host)))})
    steps.append({"score": F.least(F.aggregate("signals", F.lit(0), lambda a, s: a + s["points"]), F.lit(scoring.cap))})
    steps.append({"severity": severity(F.col("score"), scoring), "scoring_version": F.lit(scoring.version), "suppressed": F.col("_off")})
    return steps


def score_hosts(hosts: DataFrame, ref: Reference, as_of: Column, host: str = "host") -> DataFrame:
    """``hosts`` with registrable, score, scoring_version, severity, suppressed
    and signals of the normalised host in column ``host``. Allowlisted hosts skip
    all matching: their branch is a cheap literal."""
    base = hosts.withColumn("_as_of", as_of.cast("timestamp"))
    for step in _steps(ref, host):  # each is worked out once; later ones read its result
        base = sig.once(base, step)
    return base.select(*hosts.columns, "registrable", "score", "scoring_version", "severity", "suppressed", "signals")


def score_distinct_hosts(hosts: DataFrame, ref: Reference, as_of: Column, host: str = "host") -> DataFrame:
    """The same where hosts repeat often: each host is scored once. The join back
    is on the host, whose frequent values Spark splits."""
    once = score_hosts(hosts.select(host).distinct(), ref, as_of, host)
    return hosts.join(once, host, "left")


def top_hosts(names: DataFrame, key: str, ref: Reference) -> DataFrame:
    """The top active host of each ``key``, and how many names it has, of rows with key,
    host, registrable, score and suppressed, which may repeat. Rows are sent once, as
    they come: to group them before would sort wide rows of whole inputs for nothing,
    since a key's names seldom lie together. What is inactive is sent as a bare name."""
    live = ~F.col("suppressed") & (F.col("score") > 0)
    rows = names.select(key, "host", F.when(live, F.col("score")).alias("score"), F.when(live, F.col("registrable")).alias("registrable")).repartition(key)
    of = Window.partitionBy(key)
    order = of.orderBy(F.desc_nulls_last("score"), "host")  # a host has one score, so its repeats share a rank
    ranked = rows.select("*", F.row_number().over(order).alias("_row"), F.dense_rank().over(order).alias("_rank"))
    top = ranked.withColumn("names", F.max("_rank").over(of).cast("long")).filter("_row = 1 and score is not null")
    return top.select(key, "host", "registrable", "score", severity(F.col("score"), ref.scoring).alias("severity"), "names")


def finding_id(e: DataFrame, top_domain: Column, top_registrable: Column) -> Column:
    """32 hex digits: by issuer and serial, else by fingerprint, else by names
    and time. A null registrable reads "null" in the first two, "" in the last."""
    dn, serial, print_ = (text.truthy(F.col(c)) for c in ("cert_issuer_dn_sha256", "cert_serial", "cert_fingerprint"))
    named = F.coalesce(top_registrable, F.lit("null"))
    seen = F.when(F.col("seen") != 0, F.when(F.col("seen") == F.floor("seen"), F.col("seen").cast("long").cast("string")).otherwise(F.col("seen").cast("string")))
    issuer = F.coalesce(text.first_truthy(F.col("issuer_aggregated"), F.col("issuer_cn")), F.lit(""))
    stable = F.concat_ws("|", top_domain, F.coalesce(top_registrable, F.lit("")), issuer, F.coalesce(text.truthy(F.col("not_before")), seen, F.lit("")))
    key = F.when(dn.isNotNull() & serial.isNotNull(), F.concat_ws("|", dn, serial, named)).when(print_.isNotNull(), F.concat_ws("|", print_, named)).otherwise(stable)
    return F.left(F.sha2(key, 256), F.lit(32))


def score_certificates(entries: DataFrame, ref: Reference, as_of: Column) -> DataFrame:
    """Findings of ``entries`` (schemas.ENTRY; other columns stay): one row for
    each certificate with an active host. Names are exploded, each distinct host
    is scored once, and what it gives returns to the certificates by a digest of
    their fields, so equal certificates share it. Four exchanges: distinct hosts,
    names to them, hits by digest, certificates to their hits. Repeated
    certificates give equal hits, which a set keeps once before they are sent. A hit is
    sent without what its host repeats, and brands, schemes and signals apart, so those
    that nobody reads are not sent at all."""
    fields = [F.col(f.name) for f in schemas.ENTRY]
    named = entries.withColumns({"all_domains": text.extract_domains(entries), "_k1": F.xxhash64(*fields), "_k2": F.xxhash64(F.lit(1), *fields)})
    key = ["_k1", "_k2"]
    names = named.select(*key, F.posexplode("all_domains").alias("ord", "host"))
    truthy_distinct = lambda name: F.array_distinct(F.filter(F.transform("signals", lambda s: s[name]), lambda x: x.isNotNull() & (x != "")))
    active = score_hosts(names.select("host").distinct(), ref, as_of).filter("not suppressed and score > 0")
    active = active.select("host", "registrable", "score", F.transform("signals", lambda s: s.dropFields("domain")).alias("_signals"), truthy_distinct("brand").alias("_brands"), truthy_distinct("scheme").alias("_schemes"))
    # of each host of a certificate, in the order of its names; where it has none, nothing is sent
    in_order = lambda c, *more: F.sort_array(F.collect_set(F.when(F.size(c) > 0, F.struct("ord", *more, c))))
    flat = lambda c: F.array_distinct(F.flatten(in_order(c)[c]))
    shape = next(f.dataType for f in schemas.FINDING if f.name == "signals")
    per = names.join(active, "host").groupBy(*key).agg(
        F.max_by(F.struct("host", "registrable", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("top"),
        F.flatten(F.transform(in_order("_signals", "host"), lambda x: F.transform(x["_signals"], lambda s: s.withField("domain", x["host"])))).cast(shape).alias("signals"),
        flat("_brands").alias("_brands"), flat("_schemes").alias("_schemes"),
    )
    e = named.join(per, key)
    kinds = F.coalesce("entry_types", F.array(F.lit("x509")))
    none_if_zero = F.when(F.col("cert_index") != 0, F.col("cert_index"))
    source = F.struct(
        text.truthy(F.col("source")).alias("name"), text.truthy(F.col("source_label")).alias("label"), none_if_zero.alias("cert_index"), text.truthy(F.col("cert_link")).alias("cert_link"),
        text.truthy(F.col("source_ref")).alias("source_ref"), text.truthy(F.col("cert_fingerprint")).alias("fingerprint"), text.truthy(F.col("log_name")).alias("log_name"), text.truthy(F.col("log_operator")).alias("log_operator"),
    )
    seen = F.coalesce(F.when(F.col("seen") != 0, F.timestamp_millis((F.col("seen") * 1000).cast("long"))), as_of.cast("timestamp"))
    made = {
        "id": finding_id(e, F.col("top.host"), F.col("top.registrable")),
        "scoring_version": F.lit(ref.scoring.version),
        "observed_at": seen,
        "certificate_not_before": text.truthy(F.col("not_before")),
        "registrable": F.col("top.registrable"),
        "domains": F.col("all_domains"),
        "score": F.col("top.score"),
        "severity": severity(F.col("top.score"), ref.scoring),
        "signals": F.col("signals"),
        "matched_brands": F.col("_brands"),
        "matched_schemes": F.col("_schemes"),
        "issuer": F.coalesce(text.first_truthy(F.col("issuer_aggregated"), F.col("issuer_cn")), F.lit("")),
        "suppressed": F.lit(False),
        "cert_serial": text.truthy(F.col("cert_serial")),
        "cert_issuer_dn_sha256": text.truthy(F.col("cert_issuer_dn_sha256")),
        "entry_types": kinds,
        "san_count": F.coalesce(F.when(F.col("san_count") != 0, F.col("san_count")), F.size("all_domains")),
        "is_wildcard": F.coalesce("is_wildcard", F.lit(False)),
        "source": source,
    }
    extra = [c for c in entries.columns if c not in {f.name for f in schemas.ENTRY} and c not in made]
    return e.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in schemas.FINDING], *extra)
