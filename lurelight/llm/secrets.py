"""Secret scan: fixed patterns, and windows of high entropy in long tokens.

Patterns ``assign``, ``access`` and ``hex`` always count. Besides them, each
candidate (a run of token characters with a digit) is slid over by a window
whose character counts change by the one that enters and the one that leaves;
its Shannon entropy is log2(w) - sum(c log2 c) / w, where only the terms of those
two characters change. A candidate whose entropy reaches the limit of its class
(hex, alphanumeric, base64) gives one span, from its first such window to the
end of its last, unless an allow-list pattern matches it. All of it is DataFrame
functions; texts are never shuffled, only the spans.

Defined results: null counts as empty; empty texts have no span and the digest
of the empty string. Repeated rows and rows with a null id are scanned one by one, an
empty table gives an empty result, and texts of any length are scanned whole, in one
row. Spans with the same start go by kind. Other columns are ignored. Spans are in code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the base patterns; letters of the names in either case
ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
#: Runs of [0-9a-f] are maximal, so those of 24 and more are the ones to keep.
HEX = "[0-9a-f]{24,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Order of kinds with equal starts.
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64"]
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


@dataclass
class Entropy:
    window: int = 20
    #: Bits a character that a window must reach, by class.
    hex_bits: float = 3.0
    alnum_bits: float = 3.7
    base64_bits: float = 3.9
    #: Candidates that any of these finds are no secrets.
    allow: list[str] = field(
        default_factory=lambda: [
            "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
            "(?i)example|placeholder|changeme|dummy|sample|xxxx",
            "(?i)0123456789|abcdefghij",
            "^[0-9=_/+-]+$",  # numbers, dates, rules
            "^[A-Za-z]+([-_/=+][A-Za-z]+)*[0-9]{0,4}$",  # words and a year
        ]
    )


def _matches(text: Column, pattern: str, name: str) -> Column:
    """Array of (set, place, characters before the match since the last, match)."""
    found, apart = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.transform(found, lambda m, i: F.struct(F.lit(name).alias("set"), i.alias("i"), F.length(F.get(apart, i)).alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<set:string,i:int,gap:int,match:string>>"))


def window_span(s: Column, bits: Column, w: int) -> Column:
    """struct(first, last): the first and the last place (from 0) at which a
    window of ``w`` characters of ``s`` reaches ``bits``; first is -1 if none."""
    terms = F.array(*[F.lit(0.0), *[F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(1, w + 1)]])
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1))) - 1
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(a: Column, i: Column) -> Column:
        enter, leave = place(i), F.when(i > w, place(i - w)).otherwise(F.lit(-1))
        changed = F.transform(a["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
        up, down = F.get(a["counts"], enter), F.when(leave >= 0, F.get(a["counts"], leave))
        grown = F.get(terms, up + 1) - F.get(terms, up)
        shrunk = F.when(leave >= 0, F.get(terms, down - 1) - F.get(terms, down)).otherwise(0.0)
        total = a["sum"] + F.when(leave == enter, 0.0).otherwise(grown + shrunk)
        hot = (i >= w) & (F.lit(w).cast("double") * (F.log2(F.lit(float(w))) - bits) >= total - 1e-9)
        return F.struct(
            changed.alias("counts"),
            total.alias("sum"),
            F.when(hot & (a["first"] < 0), i - w).otherwise(a["first"]).cast("int").alias("first"),
            F.when(hot, i - w).otherwise(a["last"]).cast("int").alias("last"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)
    return F.struct(done["first"].alias("first"), done["last"].alias("last"))


def find_secrets(docs: DataFrame, entropy: Entropy | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of
    ``docs`` (doc_id, text)."""
    o = entropy or Entropy()
    text = F.coalesce(F.col("text"), F.lit(""))
    candidate = f"[A-Za-z0-9+/_=-]{{{o.window},}}"
    scanned = docs.select("doc_id", text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(
            F.array(F.struct(F.lit("").alias("set"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("match"))),  # keeps rows without a match
            *[_matches(F.col("text"), p, k) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("long", candidate))],
        ).alias("found"),
    )
    one = scanned.select("row", "doc_id", F.explode("found").alias("m")).select("row", "doc_id", "m.*", F.length("m.match").alias("size"))
    so_far = Window.partitionBy("row", "set").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the value's length suffices of an assignment, so secrets are not shuffled but as candidates
    keep = (
        F.when(F.col("set") == "assign", F.length(F.regexp_extract("match", ASSIGN, 2)) >= LEAST_VALUE)
        .when(F.col("set") == "access", F.col("size") >= LEAST_ACCESS)
        .when(F.col("set") == "long", F.col("match").rlike("[0-9]") & ~F.expr("false" if not o.allow else " or ".join(f"match rlike {_quoted(p)}" for p in o.allow)))
        .otherwise(F.lit(True))
    )
    s = F.when((F.col("set") == "long") & F.col("ok"), F.col("match"))
    kind = F.when(s.rlike("^[0-9a-fA-F]+$"), "entropy_hex").when(s.rlike("^[0-9A-Za-z]+$"), "entropy_alnum").when(s.isNotNull(), "entropy_base64").otherwise(F.col("set"))
    bits = F.when(F.col("kind") == "entropy_hex", o.hex_bits).when(F.col("kind") == "entropy_alnum", o.alnum_bits).otherwise(o.base64_bits)
    one = one.withColumn("ok", keep).withColumn("kind", kind)
    one = one.withColumn("hot", F.when((F.col("set") == "long") & F.col("ok"), window_span(F.col("match"), bits, o.window)))
    one = one.select("row", "doc_id", "set", "i", "gap", "size", "kind", F.when(F.col("set") == "long", F.coalesce(F.col("hot.first") >= 0, F.lit(False))).otherwise(F.col("ok")).alias("ok"), "hot")
    one = one.withColumn("at", (F.sum(F.col("gap") + F.col("size")).over(so_far) - F.col("size")).cast("long"))
    start = F.col("at") + F.coalesce("hot.first", F.lit(0))
    end = F.when(F.col("set") == "long", F.col("at") + F.col("hot.last") + o.window).otherwise(F.col("at") + F.col("size"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(start.alias("start"), order.alias("order"), end.alias("end"), F.col("kind").alias("kind"))
    ok = F.col("ok") & (F.col("set") != "")
    many = one.groupBy("row", "doc_id").agg(
        *[F.count_if(ok & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sort_array(F.collect_list(F.when(ok, span))).alias("every"),
    )
    said = lambda x: F.array_join(F.transform(x, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return many.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(F.filter("every", lambda m: m["order"] <= 3)), 256).alias("base_sha256"), said(F.col("every")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
