"""Mixing sources to target weights by hierarchical budgets.

Leaves are the sources below languages below domains. The token budget goes down
the tree by weights. A node never gets more than it can give (its tokens times
``epochs``): what is missing goes to its siblings first, by their weights, and
only what a whole family cannot give goes on to its parent's siblings. So the
capacity of a family bounds its share, and shares are settled level by level
from the root: at each level the nodes below their share give all they have and
the rest is divided among the others, until nobody is over ("water filling").

Each leaf then takes a prefix of its seeded epochs: epoch by epoch its documents
in the order of a seeded hash, up to the budget; a document is taken while the
tokens before it are below the budget. The prefix is found by sums over ranges of
the hash, and only the range in which the budget ends is sorted, so a leaf with
most of the rows never meets in one task. Tokens are words [^\\x20\\x09-\\x0D]+
unless another measure is given. Sources belong to domains by a catalogue; where
none is given, a digest of the source's name stands in for one.

Defined results: a null language, source or domain has the name ""; a text that is
null or has no word costs nothing and is taken if its place is before the budget's
end; leaves without a word are taken whole, once. Equal hashes are ordered by id,
null ids first; rows that share an id are taken together. A name without a weight
has the default; a weight that is null or negative counts as 0, but where all of a
family are 0 its members weigh the same. An empty table gives an empty one. Extra
columns stay, whatever their names: inner columns have names that the table lacks.
Only columns called like one of the results (mix_domain, mix_lang, mix_source,
mix_epoch, mix_tokens) are replaced by ``mix``; ``take`` leaves these too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, near, quoted

LEVELS = ["domain", "lang", "source"]


@dataclass
class Mix:
    """``share``: of all tokens, the budget; ``epochs``: how often a leaf may be
    read; ``weights``: level -> name -> weight (others: ``default``)."""

    share: float = 0.5
    epochs: int = 1
    seed: int = 17
    default: float = 1.0
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Rows of a hash range, about: so many are sorted in one task for each leaf.
    range_rows: int = 50_000


def domain_of(source: Column) -> Column:
    """The default domain of a source, where no catalogue of domains is given:
    one of four groups by its digest."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 2), 16, 10).cast("long") % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    """Number of words: the separators' runs, natively."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _weight(level: str, o: Mix) -> Column:
    out = F.lit(float(o.default))
    for name, w in o.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w if w and w > 0 else 0))).otherwise(out)
    return out


def budgets(leaves: DataFrame, o: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: long. Families
    are windows. Sorted by what they can give for a unit of weight, the members
    of a family that give all are a prefix; the first of the others sets the
    level, weight times which each of those gets."""
    granted = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select((F.col("all") * F.lit(o.share)).alias("share"))
    family: list[str] = []
    for level in LEVELS:
        key = [*family, level]
        here = leaves.groupBy(*key).agg((F.sum("tokens") * o.epochs).cast("double").alias("cap")).withColumn("w", _weight(level, o))
        here = here.join(granted, family) if family else here.crossJoin(F.broadcast(granted))  # one row
        whole = Window.partitionBy(*(family or [F.lit(1)]))
        here = here.withColumn("w", F.when(F.max("w").over(whole) > 0, F.col("w")).otherwise(1.0)).withColumn("zero", F.col("w") <= 0)
        order = whole.orderBy("zero", F.try_divide("cap", "w"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("at", F.try_divide(F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        here = here.withColumn("full", ~F.col("zero") & F.coalesce(F.col("cap") <= F.col("at") * F.col("w"), F.lit(False)))
        here = here.withColumn("level", F.max(F.when(~F.col("full") & ~F.col("zero"), F.col("at"))).over(whole))
        # members of weight 0 get what the others cannot give, by what they have
        spare = F.greatest(F.col("share") - F.sum(F.when(~F.col("zero"), F.col("cap")).otherwise(0.0)).over(whole), F.lit(0.0))
        nothing = F.sum(F.when(F.col("zero"), F.col("cap")).otherwise(0.0)).over(whole)
        here = here.withColumn("spare", F.coalesce(F.try_divide(spare, nothing), F.lit(0.0)))
        share = F.when(F.col("zero"), F.least(F.lit(1.0), F.col("spare")) * F.col("cap")).when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("w")))
        granted = here.select(*key, share.alias("share"))
        family = key
    return leaves.join(granted, LEVELS).select(*leaves.columns, F.least(F.ceil("share"), F.col("tokens") * o.epochs).cast("long").alias("budget"))


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60 bits that order the documents of an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


RESULTS = [*LEVELS, "epoch", "tokens"]


def _chosen(docs: DataFrame, o: Mix, domain: Column | None, catalogue: DataFrame | None, tokens: Column | None) -> tuple[DataFrame, str]:
    """The rows that the epochs take, and the prefix of their new columns, with
    which no column of ``docs`` starts."""
    scratch, taken_names = Scratch(docs.sparkSession, "mix"), [c.lower() for c in docs.columns]
    prefix = "_m"
    while any(c.startswith(prefix) for c in taken_names):
        prefix = "_" + prefix
    own = lambda c: F.col(f"{prefix}{c}")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    named = docs.withColumns({f"{prefix}source": source, f"{prefix}lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), f"{prefix}tokens": tokens_of(F.col("text")) if tokens is None else F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))})
    if catalogue is not None:
        of = catalogue.filter("source is not null").groupBy(F.col("source").cast("string").alias(f"{prefix}source")).agg(F.min("domain").cast("string").alias(f"{prefix}domain"))
        named = named.join(near(of), f"{prefix}source", "left")
        domain = own("domain")
    named = named.withColumn(f"{prefix}domain", F.coalesce(domain_of(own("source")) if domain is None else domain, F.lit("")))
    size = scratch.table(named.select("doc_id", *[own(c).alias(c) for c in [*LEVELS, "tokens"]]))
    leaves = size.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = budgets(leaves, o).filter("tokens = 0 or budget > 0")
    # tokens that each epoch of a leaf may still take
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("budget") / F.greatest("tokens", F.lit(1))) - 1, F.lit(0)).cast("int"))))
    plan = scratch.table(plan.withColumn("left", F.col("budget") - F.col("epoch") * F.col("tokens")).withColumn("full", F.col("left") >= F.col("tokens")))

    # as many ranges as the leaf's rows ask for
    width = F.lit(2**60) / F.ceil(F.col("rows") / o.range_rows)
    part = size.join(near(plan.filter("not full").select(*LEVELS, "epoch", "left", width.alias("width"))), LEVELS).withColumn("key", _key(F.col("epoch"), F.col("doc_id"), o.seed))
    part = part.withColumn("range", F.floor(F.col("key") / F.col("width")))
    one = [*LEVELS, "epoch"]
    sums = part.groupBy(*one, "left", "range").agg(F.sum("tokens").alias("tokens"))
    so_far = Window.partitionBy(*one).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)))
    cut = scratch.table(sums.filter("before < left and left <= before + tokens").select(*one, "range", "before"))  # a row for each leaf's last epoch
    inside = Window.partitionBy(*one, "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = part.join(near(cut), [*one, "range"]).withColumn("sofar", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    last = last.filter("sofar < left").groupBy(*one).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    taken = plan.join(last, one, "left").filter("full or last is not null")
    taken = scratch.table(taken.select(*(F.col(c).alias(f"{prefix}{c}") for c in one), F.col("full").alias(f"{prefix}full"), F.col("last.key").alias(f"{prefix}key"), F.col("last.doc_id").alias(f"{prefix}last")))
    out = named.join(near(taken), [f"{prefix}{c}" for c in LEVELS])
    key, least = _key(own("epoch"), F.col("doc_id"), o.seed), F.lit(-(2**63))
    before = (key < own("key")) | ((key == own("key")) & (F.coalesce(F.col("doc_id").cast("long"), least) <= F.coalesce(own("last").cast("long"), least)))
    return out.filter(own("full") | before), prefix


def mix(docs: DataFrame, options: Mix | None = None, domain: Column | None = None, catalogue: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) that the epochs take,
    with mix_domain, mix_lang, mix_source, mix_epoch (from 0) and mix_tokens. The
    domain is what ``catalogue`` (source, domain) says, or a column of ``docs``;
    ``tokens`` is what a row costs."""
    out, prefix = _chosen(docs, options or Mix(), domain, catalogue, tokens)
    results = [f"mix_{c}" for c in RESULTS]
    return out.select(*quoted(c for c in docs.columns if c.lower() not in results), *[F.col(f"{prefix}{c}").alias(r) for c, r in zip(RESULTS, results)])


def take(docs: DataFrame, options: Mix | None = None, domain: Column | None = None, catalogue: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """The same rows with the columns of ``docs`` alone."""
    return _chosen(docs, options or Mix(), domain, catalogue, tokens)[0].select(*quoted(docs.columns))
