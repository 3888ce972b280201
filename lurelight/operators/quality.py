"""Detection quality: threshold sweeps, groups, gates, and the labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed

THRESHOLDS = list(range(30, 91, 10))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def is_positive(expected: Column, label: Column) -> Column:
    return F.coalesce(expected == "malicious", F.lit(False)) | F.coalesce(label == "positive", F.lit(False))


def sweep(items: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, f1 over ``items`` (score,
    suppressed, positive): one pass with conditional counts for all thresholds."""
    hit = lambda t: (F.col("score") >= t) & ~F.col("suppressed")
    count = lambda c: F.count_if(c)
    pos = F.col("positive")
    wide = items.agg(*[F.struct(F.lit(t).alias("threshold"), count(hit(t) & pos).alias("tp"), count(hit(t) & ~pos).alias("fp"), count(~hit(t) & ~pos).alias("tn"), count(~hit(t) & pos).alias("fn")).alias(f"t{t}") for t in thresholds])
    long = wide.select(F.explode(F.array(*[f"t{t}" for t in thresholds])).alias("m")).select("m.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return long.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_group(items: DataFrame, group: str, threshold: int = fixed.CRITICAL) -> DataFrame:
    """Confusion counts of each group; without any prediction precision is 1 if
    nothing is wrong, without positives recall is 1. Worst first."""
    hit, pos = (F.col("score") >= threshold) & ~F.col("suppressed"), F.col("positive")
    out = items.groupBy(F.coalesce(F.col(group), F.lit("none")).alias(group)).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumns({"precision": p, "recall": r}).orderBy(F.desc("fp"), "precision", "recall", group)


def split_sets(items: DataFrame) -> dict[str, DataFrame]:
    a, c = F.coalesce("adversarial", F.lit(False)), F.coalesce("constructed", F.lit(False))
    return {"headline": items.filter(~a & ~c), "adversarial": items.filter(a), "constructed": items.filter(c)}


def passes(items: DataFrame, threshold: int = fixed.CRITICAL) -> DataFrame:
    """Adversarial items that are caught, constructed ones that are left alone."""
    hit = (F.col("score") >= threshold) & ~F.col("suppressed")
    return items.agg(F.count_if(F.col("adversarial")).alias("adversarial"), F.count_if(F.col("adversarial") & hit).alias("caught"), F.count_if(F.col("constructed")).alias("constructed"), F.count_if(F.col("constructed") & ~hit).alias("left_alone"))


def gate(metrics: DataFrame, baseline_f1: float, allowlisted_fp: Column, most_drop: float = 0.02) -> DataFrame:
    """One row: whether a sweep's row at the alert threshold may be released."""
    drop = F.lit(baseline_f1) - F.col("f1")
    return metrics.select("f1", drop.alias("f1_drop"), ((allowlisted_fp == 0) & (drop <= most_drop)).alias("passed"))


def band_candidates(hosts: DataFrame, low: int = 25, high: int = fixed.CRITICAL) -> DataFrame:
    """The first host of each registrable domain, by ``ord``, whose score is in
    the band: hard negatives. ``hosts`` (ord, host, registrable, score, suppressed)."""
    rest = [c for c in hosts.columns if c != "registrable"]
    first = hosts.filter("registrable is not null").groupBy("registrable").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("registrable", "r.*")
    return first.filter(~F.col("suppressed") & (F.col("score") >= low) & (F.col("score") < high))


# Names from which the labelled phishing hosts are made
PHISHED = "dbs posb ocbc uob singpass cpf iras trustbank maribank stanchart maybank grab shopee singpost lazada paynow govtech hdb moe moh ica".split()
WORDS = "login verify secure account update portal token auth banking refund claim otp access wallet ebanking".split()
RISKY = "xyz top icu cfd sbs rest cyou bond click link club vip".split()
GOVERNMENT = "singpass cpf iras govtech hdb moe moh ica".split()
PLAIN_COM = "ocbc grab singpost".split()
LURES = [
    ("cdc_vouchers", "cdc-voucher"), ("gst_voucher", "gst-voucher"), ("assurance_package", "assurance-package"), ("climate_vouchers", "climate-vouchers"), ("skillsfuture", "skillsfuture-credit"),
    ("baby_bonus", "baby-bonus-sg"), ("edusave", "edusave-grant"), ("comcare", "comcare-support"), ("majulah_package", "majulah-package"), ("silver_support", "silver-support-payout"),
]


def _at(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))


def phished(ids: DataFrame) -> DataFrame:
    """A host for each id (id) that joins a name to words: (domain, brand, category)."""
    i, turn = F.col("id") % 5, F.floor(F.col("id") / 5)
    brand = _at(PHISHED, turn)
    token = F.when(turn % len(PHISHED) == PHISHED.index("stanchart"), F.when(i % 2 == 0, "sc").otherwise("stanchart")).otherwise(brand)
    return ids.select(F.concat(token, F.lit("-"), _at(WORDS, i * 3), F.lit("-"), _at(WORDS, i * 3 + 1), F.lit("."), _at(RISKY, F.length(brand) + i)).alias("domain"), brand.alias("brand"), F.lit("credential_phish").alias("category"))


def squatted(ids: DataFrame) -> DataFrame:
    """One that has a name's own domain as its subdomain."""
    k = F.col("id")
    b = _at(PHISHED, k)
    legal = F.when(b.isin(GOVERNMENT), F.concat(b, F.lit(".gov.sg"))).when(b == "stanchart", "sc.com.sg").when(b.isin(PLAIN_COM), F.concat(b, F.lit(".com"))).otherwise(F.concat(b, F.lit(".com.sg")))
    return ids.select(F.concat(legal, F.lit(".verify-login-portal-"), (k + 1).cast("string"), F.lit("."), _at(RISKY, k)).alias("domain"), b.alias("brand"), F.lit("subdomain_squat").alias("category"))


def lured(ids: DataFrame) -> DataFrame:
    """One that promises a payment."""
    k = F.col("id")
    return ids.select(F.concat(_at([t for _, t in LURES], k), F.lit("-claim-portal-2026-"), (k + 1).cast("string"), F.lit("."), _at(RISKY, k)).alias("domain"), _at([s for s, _ in LURES], k).alias("brand"), F.lit("scheme_phish").alias("category"))


def positives(spark: SparkSession) -> DataFrame:
    """The 160 labelled phishing hosts: (domain, brand, category)."""
    return phished(spark.range(5 * len(PHISHED))).unionByName(squatted(spark.range(35))).unionByName(lured(spark.range(20)))


def _listed(spark: SparkSession, text: str, expected: str, label: str) -> DataFrame:
    rows = [(*line.split("|"), expected, label) for line in text.splitlines() if line]
    return spark.createDataFrame(rows, "domain string, brand string, category string, expected string, label string")


def adversarial(spark: SparkSession) -> DataFrame:
    """The 60 hand-made phishing hosts: (domain, brand, category, expected, label)."""
    return _listed(spark, fixed.ADVERSARIAL, "malicious", "positive")


def constructed(spark: SparkSession) -> DataFrame:
    """The 21 hand-made benign hosts, likewise."""
    return _listed(spark, fixed.CONSTRUCTED, "benign", "negative")


def corpus(positive: DataFrame, adversarial: DataFrame, negative: DataFrame, constructed: DataFrame) -> DataFrame:
    """One labelled table of four; missing columns are null."""
    tag = lambda d, a, c: d.withColumns({"adversarial": F.lit(a), "constructed": F.lit(c)})
    out = tag(positive, False, False)
    for d in (tag(adversarial, True, False), tag(negative, False, False), tag(constructed, False, True)):
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def composition(items: DataFrame) -> DataFrame:
    return items.groupBy("label", "adversarial", "constructed").agg(F.count("*").alias("items"))


def rollup(items: DataFrame, columns: list[str], **measures: Column) -> DataFrame:
    """Counts (and measures) of the items by all columns, by each of them alone, and
    over all, in one pass: ``level`` has a bit for each column that a row sums over, the
    last column's lowest."""
    sets = [columns, *[[c] for c in columns], []] if len(columns) > 1 else [columns, []]
    d = items.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return d.agg(F.grouping_id().alias("level"), F.count("*").alias("items"), *[m.alias(n) for n, m in measures.items()])


# Names of institutions that every reader trusts
TRUSTED = """google.com.sg yahoo.com.sg amazon.sg ebay.com.sg microsoft.com apple.com wikipedia.org straitstimes.com channelnewsasia.com businesstimes.com.sg
nus.edu.sg ntu.edu.sg smu.edu.sg sutd.edu.sg sit.edu.sg suss.edu.sg nie.edu.sg sp.edu.sg np.edu.sg nyp.edu.sg tp.edu.sg rp.edu.sg ite.edu.sg sgx.com
singaporeair.com scottrun.sg starhub.com m1.com.sg simba.sg comfortdelgro.com form.gov.sg go.gov.sg vaccine.gov.sg checkfirst.gov.sg supportgowhere.gov.sg
life.gov.sg postman.gov.sg onemap.gov.sg police.gov.sg smartnation.gov.sg csa.gov.sg scamshield.gov.sg synapxe.sg"""


def _benign(rows: DataFrame, **fields: Column) -> DataFrame:
    same = {"expected": F.lit("benign"), "label": F.lit("negative"), "adversarial": F.lit(False), "constructed": F.lit(False), "mined_band": F.lit(False)}
    return rows.select(*[c.alias(n) for n, c in (fields | same).items()])


def allowlist_negatives(allowlist: DataFrame) -> DataFrame:
    """Every entry of the allowlist (registrable, brand) as a benign item."""
    return _benign(allowlist, domain=F.col("registrable"), brand=F.col("brand"), category=F.lit("allowlisted"), source=F.lit("allowlist"))


def trusted_negatives(spark: SparkSession) -> DataFrame:
    """Trusted institutions as benign items; those of the government apart."""
    names = spark.createDataFrame([(n,) for n in TRUSTED.split()], "domain string")
    state = F.endswith("domain", F.lit(".gov.sg"))
    kind = lambda yes, no: F.when(state, yes).otherwise(no)
    return _benign(names, domain=F.col("domain"), brand=F.lit("none"), category=kind("legitimate_government", "tranco_sg"), source=kind("gov_sg_trusted", "tranco_sg"))
