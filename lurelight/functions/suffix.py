"""Public suffixes and registrable domains.

Rules are plain (``com.sg``), wildcard (``*.ck``) or exceptions (``!www.ck``);
without a matching rule the last label is the suffix. Membership tests compile to
hash sets, so a host is handled in its own row however long the rule list is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idna

MOST_LABELS = 6  # of any rule
#: Rules of a table that each task gets as one structure; the public list has some 10,000.
MOST_RULES = 200_000


def is_domain(host: Column) -> Column:
    """Whether all labels may stand in the name of a domain: up to 63 characters, no
    hyphen at either end, and 255 characters together; a local name is none."""
    return ~F.coalesce((F.length(host) > 255) | host.rlike("(^|\\.)(-|\\.|$)|-(\\.|$)|[^.]{64}|(^|\\.)local$"), F.lit(True))


def _in(c: Column, names: Sequence[str]) -> Column:
    return c.isin(*names) if names else F.lit(False)


def public_suffix(host: Column, rules: Sequence[str]) -> Column:
    """The suffix of a normalised host, or null where it has none."""
    plain = [r for r in rules if r[0] not in "!*"]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    spared = [r[1:] for r in rules if r.startswith("!")]
    labels = F.split(host, "\\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    out = F.element_at(labels, -1)
    for k in range(2, MOST_LABELS + 1):  # longer rules win
        out = F.when((n >= k) & (_in(tail(k), plain) | (_in(tail(k - 1), wild) & ~_in(tail(k), spared))), tail(k)).otherwise(out)
    for k in range(2, MOST_LABELS + 1):
        if spared:
            out = F.when((n >= k) & _in(tail(k), spared), tail(k - 1)).otherwise(out)
    return F.when(is_domain(host), out)


def registrable(host: Column, rules: Sequence[str]) -> Column:
    """Suffix and one label more; null for suffixes and invalid hosts."""
    suffix = public_suffix(host, rules)
    before = F.left(host, F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def subdomain_labels(host: Column, registrable_: Column) -> Column:
    """Labels left of the registrable domain; empty without any."""
    none = F.array().cast("array<string>")
    left = F.left(host, F.length(host) - F.length(registrable_) - 1)
    return F.coalesce(F.when(F.length(host) > F.length(registrable_) + 1, F.split(left, "\\.")), none)


def with_registrable(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """The same by a join, for rule tables that are no plan-time constants:
    ``rules`` (rule). Every host's tails meet the rules; the longest match wins."""
    r = rules.select(F.regexp_replace("rule", "^[!*]\\.?", "").alias("name"), F.when(F.startswith("rule", F.lit("!")), "except").when(F.startswith("rule", F.lit("*")), "wild").otherwise("plain").alias("kind"))
    hosts = df.select(F.col(host).alias("_h")).distinct().filter(is_domain(F.col("_h")))
    n = lambda c: F.size(F.split(c, "\\."))
    # a host and how many labels its tail has; the tail itself is worked out, not sent
    hit = hosts.select("_h", F.explode(F.sequence(F.lit(1), n("_h"))).alias("_k")).join(r, F.expr("substring_index(_h, '.', -_k) = name"))
    # the suffix's labels: a wildcard takes one more, an exception one less
    size = F.when(F.col("kind") == "plain", F.col("_k")).when((F.col("kind") == "wild") & (F.col("_k") < n("_h")), F.col("_k") + 1).when(F.col("kind") == "except", F.col("_k") - 1)
    best = hit.groupBy("_h").agg(F.coalesce(F.min(F.when(F.col("kind") == "except", size)), F.max(size)).alias("_s"))
    d = df.join(best, F.col(host) == F.col("_h"), "left").withColumn("_s", F.when(is_domain(F.col(host)), F.coalesce("_s", F.lit(1))))
    last = lambda k: F.expr(f"substring_index(`{host}`, '.', -({k}))")
    return d.select(*df.columns, last("_s").alias("suffix"), F.when(F.col("_s") < n(host), last("_s + 1")).alias("registrable"))


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """rule: the rules of a list file. Comments and blank lines are left out, a rule ends
    at the first space, and internationalised ones are written in ASCII."""
    lines = spark.read.text(path).select(F.split(F.lower(F.trim("value")), "\\s").getItem(0).alias("line")).filter("line <> '' and not startswith(line, '//')")
    mark = F.regexp_extract("line", "^(\\*\\.|!)?", 0)
    named = idna.normalised(lines.select(mark.alias("mark"), F.regexp_replace("line", "^(\\*\\.|!)", "").alias("rest")), "rest")
    return named.filter("name is not null").select(F.concat("mark", "name").alias("rule")).distinct()


class Trie:
    """Rules by their labels from the last one on; a walk along a host finds all that
    match it."""

    def __init__(self, rules: Sequence[str]):
        self.top: dict = {}
        for rule in rules:
            kind = {"!": "except", "*": "wild"}.get(rule[0], "plain")
            node = self.top
            for label in reversed(rule.lstrip("!*").removeprefix(".").split(".")):
                node = node.setdefault(label, {})
            node[kind, ""] = True

    def start(self, labels: list[str]) -> int:
        """The label at which the public suffix begins: by the exception with the
        fewest labels, else by the longest rule, else the last label."""
        node, best, spared = self.top, len(labels) - 1, None
        for i in range(len(labels) - 1, -1, -1):
            node = node.get(labels[i])
            if node is None:
                break
            if ("plain", "") in node:
                best = min(best, i)
            if ("wild", "") in node and i:
                best = min(best, i - 1)
            if ("except", "") in node:
                spared = i + 1 if spared is None else max(spared, i + 1)
        return best if spared is None else spared


def with_registrable_trie(df: DataFrame, host: str, rules: Sequence[str]) -> DataFrame:
    """``df`` with suffix and registrable of its hosts, by one structure of all rules
    that a worker builds once."""
    shipped, made = df.sparkSession.sparkContext.broadcast(list(rules)), {}

    @F.pandas_udf("suffix string, registrable string")
    def found(hosts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = made.setdefault(0, Trie(shipped.value))
        for column in hosts:
            out = []
            for h in column:
                labels = None if h is None or h != h else h.split(".")
                at = trie.start(labels) if labels else 0
                out.append((None, None) if not labels else (".".join(labels[at:]), ".".join(labels[at - 1 :]) if at else None))
            yield pd.DataFrame({c: pd.Series([o[i] for o in out], dtype=object) for i, c in enumerate(("suffix", "registrable"))})

    d = df.withColumn("_found", found(F.when(is_domain(F.col(host)), F.col(host))))
    return d.select(*df.columns, "_found.suffix", "_found.registrable")


def with_registrable_by_size(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """By the structure while there are at most MOST_RULES rules, else by the join;
    the rows are the same."""
    few = [r.rule for r in rules.select("rule").limit(MOST_RULES + 1).collect()]
    if len(few) <= MOST_RULES:
        return with_registrable_trie(df, host, few)
    return with_registrable(df, host, rules).select(*df.columns, "suffix", "registrable")
