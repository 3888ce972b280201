"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "<|im_sep|>" text "<|im_end|>"

Roles and texts hold no control string and no lone backslash; a backslash makes
the next character literal. Each turn is first rendered as it is and parsed
again. While the parser refuses it or recovers another turn, its role and text are
escaped more: first every backslash is doubled and a backslash put behind the first
character of every control string, then one put before every character, which no
grammar of this kind can mistake. The loss mask covers the texts of ``assistant``
turns. All of it is DataFrame functions. ``identical`` tells for each conversation
whether the parser recovers the source, and ``checked`` fails where it does not.

Turns are escaped before they are brought together, and one conversation is one
row of the result, so a very long conversation is one long string in one task,
as its digest demands.

Defined results: a null role or text is empty. Turns are ordered by turn, then
role, then text, a null turn first; repeated rows are repeated turns. Rows with
a null conversation id are left out. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# fixed values: strings that tokenizers or templates give a meaning
CONTROL = [START, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNED = "assistant"


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\|[]().*+?{}^$/<>" and c not in "/<>" else c for c in text)


_ANY = "|".join(_literal(c) for c in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "(<|\\[)(?=" + "|".join(_literal(c[1:]) for c in CONTROL) + ")", "$1\\\\")


def escape_all(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)(.)", "\\\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _open(text: Column) -> Column:
    """Whether the text ends in a backslash that has no partner."""
    return F.endswith(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text), or null where the string is not in the grammar."""
    parts = F.split(formatted, _literal(END), -1)
    inner = F.slice(parts, 1, F.size(parts) - 1)
    turns = F.transform(
        inner,
        lambda t: F.struct(
            F.substring_index(F.substr(t, F.lit(len(START) + 1)), MIDDLE, 1).alias("role"),
            F.substr(t, F.instr(t, F.lit(MIDDLE)) + len(MIDDLE)).alias("text"),
        ),
    )
    shaped = F.forall(inner, lambda t: F.startswith(t, F.lit(START)) & (F.instr(t, F.lit(MIDDLE)) > 0)) & (F.element_at(parts, -1) == "")
    clean = F.forall(turns, lambda t: ~F.concat(t["role"], F.lit("\n"), t["text"]).rlike(_ANY))
    return F.when(shaped & clean, F.transform(turns, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered turn with its escaped parts."""
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    forms = [lambda c: c, escape, escape_all]

    def same(form) -> Column:
        role, text = form(F.col("role")), form(F.col("text"))
        got = parse(render(role, text))
        back = (F.size(got) == 1) & (got[0]["role"] == F.col("role")) & (got[0]["text"] == F.col("text"))
        # a backslash without partner would make the mark behind it literal
        return F.coalesce(back & ~_open(role) & ~_open(text), F.lit(False))

    rows = rows.withColumn("escapes", F.when(same(forms[0]), 0).when(same(forms[1]), 1).otherwise(2))
    shown = lambda c: F.when(F.col("escapes") == 0, c).when(F.col("escapes") == 1, escape(c)).otherwise(escape_all(c))
    return rows.select("conv_id", "turn", "role", "text", "escapes", shown(F.col("role")).alias("role_out"), shown(F.col("text")).alias("text_out"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of (start, end) code points of the
    assistant texts), identical (the parser recovers the source)."""
    t = turns(conversations).withColumn("rendered", render(F.col("role_out"), F.col("text_out")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("place", F.row_number().over(order))
    t = t.withColumn("before", F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("before") + len(START) + F.length("role_out") + len(MIDDLE)
    span = F.when(F.col("role") == LEARNED, F.struct(start.alias("start"), (start + F.length("text_out")).alias("end")))
    # a source is compared by digest: strings are not held twice
    one = F.struct("place", F.col("rendered"), span.alias("span"), F.sha2(F.concat("role", F.lit("\n"), "text", F.lit("\n")), 256).alias("source"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    c = c.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("mask"),
        F.transform("turns", lambda x: x["source"]).alias("source"),
    )
    back = F.transform(parse(F.col("formatted")), lambda x: F.sha2(F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")), 256))
    return c.select("conv_id", "formatted", "mask", F.coalesce(back == F.col("source"), F.lit(False)).alias("identical"))


def checked(formatted: DataFrame) -> DataFrame:
    """The same rows; reading one that does not round-trip is an error."""
    failed = F.raise_error(F.concat(F.lit("no round trip: conversation "), F.col("conv_id").cast("string")))
    return formatted.withColumn("identical", F.when(F.col("identical"), True).otherwise(failed.cast("boolean")))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and their masks hold, by parser and mask."""
    got = parse(F.col("formatted"))
    masked = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    d = formatted.select("conv_id", "identical", got.alias("got"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return d.select(
        "conv_id",
        F.size("got").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("got", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
        "identical",
    )
