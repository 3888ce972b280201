"""Internationalised names by UTS 46, non-transitional: the names that browsers take.

Mapping is by rule: compatibility form and case folding of each character, but for
those that stay as they are (sharp s, final sigma, the joiners); then the composed form.
Labels are checked (marks in front, joiners, writing direction, unassigned and private
characters) and written in Punycode; what a label in Punycode holds must be what
mapping leaves. Names of ASCII letters never reach Python: the batch holds null for
them.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import text

# Characters that stay, that go, and that end a label
KEPT = "\u00df\u03c2\u200c\u200d"
DROPPED = "\u00ad\u034f\u180b\u180c\u180d\u180f\u200b\u2060\u2064\ufeff"
STOPS = "\u3002\uff0e\uff61"
#: No part of a name, whatever stands before it.
FORBIDDEN = set(map(chr, range(33))) | set('#%/:<>?@[\\]^|\x7f')


@cache
def _mapped(c: str) -> str:
    if c in KEPT:
        return c
    if c in DROPPED or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if c in STOPS:
        return "."
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return nfkc(nfkc(c).casefold())


def mapped(name: str) -> str:
    return unicodedata.normalize("NFC", "".join(map(_mapped, name)))


def _joined(label: str) -> bool:
    """Joiners stand behind a virama; the one that does not join also between
    letters that would."""
    for i, c in enumerate(label):
        if c in "\u200c\u200d" and (not i or unicodedata.combining(label[i - 1]) != 9):
            between = c == "\u200c" and 0 < i < len(label) - 1 and all(unicodedata.bidirectional(x) == "AL" for x in (label[i - 1], label[i + 1]))
            if not between:
                return False
    return True


def _directed(label: str) -> bool:
    """The rule of writing directions for one label of a name that has some to the left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    body = list(kinds)
    while body and body[-1] == "NSM":
        body.pop()
    if not body:
        return True
    if kinds[0] in ("R", "AL"):
        return all(k in ("R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM") for k in kinds) and body[-1] in ("R", "AL", "EN", "AN") and not ("EN" in kinds and "AN" in kinds)
    return kinds[0] == "L" and all(k in ("L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM") for k in kinds) and body[-1] in ("L", "EN")


def _valid(label: str) -> bool:
    if not label:
        return True
    if unicodedata.category(label[0])[0] == "M" or FORBIDDEN & set(label):
        return False
    return all(unicodedata.category(c) not in ("Cc", "Cs", "Co", "Cn", "Zs", "Zl", "Zp") for c in label) and _joined(label)


def to_unicode(name: str) -> str | None:
    """The name in its own letters; null where it is none."""
    labels = []
    for label in mapped(name).split("."):
        if label.startswith("xn--"):
            try:
                plain = label[4:].encode("ascii").decode("punycode")
            except (UnicodeError, ValueError, OverflowError):
                return None
            if not plain or plain.isascii() or mapped(plain) != plain or "." in plain:
                return None
            label = plain
        if not _valid(label):
            return None
        labels.append(label)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in "".join(labels)) and not all(map(_directed, labels)):
        return None
    return ".".join(labels)


def to_ascii(name: str) -> str | None:
    """The name in ASCII; null where it is none."""
    own = to_unicode(name)
    if own is None:
        return None
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in own.split(".")) or None


def is_idn(name: Column) -> Column:
    return name.rlike("[^\\x00-\\x7F]|(^|\\.)xn--")


@F.pandas_udf(StructType([StructField("ascii", StringType()), StructField("unicode", StringType())]))
def _forms(names: pd.Series) -> pd.DataFrame:
    found = [(None, None) if n is None or n != n else (to_ascii(n), to_unicode(n)) for n in names]
    return pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=object) for i, c in enumerate(("ascii", "unicode"))})


def normalised(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with name, unicode and wildcard of the raw names; name and unicode are
    null where it is no name."""
    host = text.normalise_name(F.col(raw))
    d = df.withColumn("_host", host).withColumn("_forms", _forms(F.when(is_idn(F.col("_host")), F.col("_host"))))
    pick = lambda c: F.when(is_idn(F.col("_host")), F.col(f"_forms.{c}")).otherwise(F.col("_host"))
    return d.withColumns({"name": pick("ascii"), "unicode": pick("unicode"), "wildcard": text.is_wildcard(F.col(raw))}).drop("_host", "_forms")


@F.pandas_udf(ArrayType(StringType()))
def _ascii_names(names: pd.Series) -> pd.Series:
    """Names of one row; those without an ASCII form stay."""
    return pd.Series([None if x is None else [n if n is None else (to_ascii(n) or n) for n in x] for x in names], dtype=object)


def ascii_entries(entries: DataFrame) -> DataFrame:
    """Entries (schemas.ENTRY) whose internationalised names are ASCII by this rule, so
    that scoring takes them as they are. Only rows with such a name are handed on."""
    none = F.array().cast("array<string>")
    single = ["domain", "common_name"]
    spaced = F.split(F.coalesce("name_value", F.lit("")), "\\s+")
    every = F.transform(F.concat(F.array(*single), F.coalesce("dns_names", none), F.coalesce("domains", none), spaced), lambda x: F.when(x.isNotNull(), text.normalise_host(x)))
    d = entries.withColumn("_all", every)
    d = d.withColumn("_new", _ascii_names(F.when(F.exists("_all", lambda x: F.coalesce(is_idn(x), F.lit(False))), F.col("_all"))))
    size = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("dns_names", "domains")}
    first = {"dns_names": F.lit(3), "domains": F.lit(3) + size["dns_names"], "name_value": F.lit(3) + size["dns_names"] + size["domains"]}
    out = {c: F.get("_new", F.lit(i)) for i, c in enumerate(single)}
    out |= {c: F.when(F.col(c).isNotNull(), F.slice("_new", first[c], size[c])) for c in size}
    out["name_value"] = F.when(F.col("name_value").isNotNull(), F.array_join(F.slice("_new", first["name_value"], F.size("_all")), "\n"))
    return d.select(*[F.when(F.col("_new").isNotNull(), out[c]).otherwise(F.col(c)).alias(c) if c in out else F.col(c) for c in entries.columns])
