"""Host names and record fields as Column expressions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPACT = "[^a-z0-9]"


def _prepared(raw: Column) -> Column:
    """Trimmed, lower-cased, without one trailing dot."""
    return F.regexp_replace(F.lower(F.trim(raw)), "\\.$", "")


def is_wildcard(raw: Column) -> Column:
    return F.coalesce(F.startswith(_prepared(raw), F.lit("*.")), F.lit(False))


def normalise_name(raw: Column) -> Column:
    """Host name, or null where it is none (empty, or with a space, slash or colon)."""
    name = F.regexp_replace(_prepared(raw), "^\\*\\.", "")
    return F.when(~((name == "") | name.rlike("[ /:]")), name)


def normalise_host(raw: Column) -> Column:
    """``normalise_name``, or the cleaned text where that is null."""
    loose = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "^\\*\\.", ""), "\\.$", "")
    return F.coalesce(normalise_name(raw), loose)


def ascii_name(name: Column) -> Column:
    """An internationalised name as ASCII (IDNA 2003 with unassigned characters
    allowed: sharp s becomes ss); null where it has no such form. Names that are
    ASCII stay as they are. Spark takes a call into the JDK for one whose result
    may change, so this belongs into a projection, not under a join or a filter
    that should reach a scan."""
    return F.when(name.rlike("[^\\x00-\\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name, F.lit(1))).otherwise(name)


def ascii_host(raw: Column) -> Column:
    """``normalise_host`` with internationalised names as ASCII where they have
    such a form."""
    host = normalise_host(raw)
    return F.coalesce(ascii_name(host), host)


def ingest_host(raw: Column) -> Column:
    """The sources' own form: the wildcard goes, then a trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "^\\*\\.", ""), "\\.$", "")


def compact(host: Column) -> Column:
    return F.regexp_replace(normalise_host(host), COMPACT, "")


def ingest_compact(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), COMPACT, "")


def is_dotted(host: Column) -> Column:
    return F.instr(host, ".") > 0


def decompose(label: Column, affixes: list[str]) -> Column:
    """The label, and what is left without one affix at either end; in order of
    first appearance."""
    n = F.length(label)
    forms = F.flatten(
        F.transform(
            F.array(*map(F.lit, affixes)) if affixes else F.array().cast("array<string>"),
            lambda k: F.array(
                F.when(F.startswith(label, k) & (n > F.length(k)), F.substr(label, F.length(k) + 1)),
                F.when(F.endswith(label, k) & (n > F.length(k)), F.substr(label, F.lit(1), n - F.length(k))),
            ),
        )
    )
    return F.array_distinct(F.filter(F.concat(F.array(label), forms), lambda x: x.isNotNull()))


def distinct_truthy(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x.cast("string") != "")))


def truthy(c: Column) -> Column:
    """Null where the string is empty."""
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*map(truthy, columns))


def issuer_name(e: DataFrame) -> Column:
    """The issuer of an entry by the first field that has one, else empty."""
    return F.coalesce(first_truthy(e["issuer_aggregated"], e["issuer_cn"]), F.lit(""))


def extract_domains(e: DataFrame) -> Column:
    """All dotted names of an entry, normalised, internationalised ones as ASCII,
    first appearance first."""
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array(F.col("domain"), F.col("common_name")),
        F.coalesce("dns_names", none),
        F.coalesce("domains", none),
        F.split(F.coalesce("name_value", F.lit("")), "\\s+"),
    )
    return F.array_distinct(F.filter(F.transform(F.filter(names, lambda x: x.isNotNull()), ascii_host), is_dotted))


def iso_time(raw: Column) -> Column:
    """ISO text of epoch seconds or of a date; null where it is neither."""
    number = raw.try_cast("double")
    at = F.coalesce(F.timestamp_millis((number * 1000).try_cast("bigint")), F.try_to_timestamp(raw))
    return F.when((raw.cast("string") != "") & ~F.coalesce(number == 0, F.lit(False)), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def source_of_link(name: Column, link: Column) -> Column:
    """The source's name, or what its link tells."""
    return F.coalesce(truthy(name), F.when(F.contains(link, F.lit("crt.sh")), "crtsh").when(F.contains(link, F.lit("get-entries")), "direct_ct"))


def signal_label(signal: Column) -> Column:
    """Short text of a signal for lists of reasons."""
    kind = signal["type"]
    return (
        F.when(F.startswith(kind, F.lit("brand:")), F.concat_ws(" ", signal["display"], F.substring_index(kind, ":", -1)))
        .when(kind == "kw", F.concat(F.lit("keyword "), signal["token"]))
        .when(kind == "scheme", signal["display"])
        .otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))
    )


def top_reasons(signals: Column, n: int = 4) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(signals, signal_label))), 1, n)


def to_ascii_names(df: DataFrame, column: str) -> DataFrame:
    """Internationalised names of a column as ASCII, where they have such a form."""
    name = F.col(column)
    return df.withColumn(column, F.coalesce(ascii_name(name), name))
