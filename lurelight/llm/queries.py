"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, planes, quality, rules, sql
from .decontaminate import contaminated
from .neardup import near_duplicates
from .repeats import without_repeats
from .resample import resample
from .scratch import Scratch, small_batches
from .secrets import find_secrets
from .simhash import hex_digits, near_fingerprints
from .vectorcodes import code_digests

#: A public tokenizer's file, on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

ORACLES: dict[str, str] = {"op1_neardup": sql.NEARDUP, "op4_repeats": sql.REPEATS, "op6_chat": sql.CHAT}
#: The mix of op9: an eighth of the tokens is left out, two epochs at most.
MIX = mixing.Mix(share=0.875, epochs=2, weights={"domain": {"d0": 3.0, "d1": 2.0}, "lang": {"en": 2.0}})
ORACLES["op9_mixing"] = sql.mixing(MIX)
ORACLES |= {"op12_vector_codes": sql.vector_codes(), "op13_resample": sql.RESAMPLE}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents (links at 85 % of the union)."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written, read back and digested."""
    path = Scratch(spark, "planes").base
    planes.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return planes.document_digests(spark, path)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents by fixed patterns and sliding entropy."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of passages that also occur in documents with smaller ids."""
    return without_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from four folds of five."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold(5) != 0))
    held_out = fold(5) == 0
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that consists of control strings, formatted;
    digests of what the parser and the loss mask find in the written output."""
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(Scratch(spark, "chat").table(chat.checked(chat.format_chats(rows)))).drop("identical")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold copies, edited or not, of benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, fixed limits and the forest's verdict."""
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and epochs that the target weights select."""
    got = mixing.mix(table(spark, sf_dir, "documents"), MIX)
    return got.select("doc_id", "mix_domain", "mix_lang", "mix_source", F.col("mix_epoch").cast("long").alias("mix_epoch"), "mix_tokens")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.filter(fold(4) != 2))
    return langid.predict(docs, net).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents and their groups (links at 4 bits)."""
    return near_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, four parts of 256 entries each."""
    return code_digests(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_planes": op2_planes,
    "op3_secrets": op3_secrets,
    "op4_repeats": op4_repeats,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_decontaminate": op7_decontaminate,
    "op8_rules": op8_rules,
    "op9_mixing": op9_mixing,
    "op10_langid": op10_langid,
    "op11_simhash": op11_simhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_resample": op13_resample,
    "pipeline": pipeline,
}
