"""A corpus pipeline: five stages, each on all that the one before it kept.

Language identification, near-duplicate groups, benchmark decontamination,
mixing to target weights, token-id files. Each stage takes (spark, docs, sf_dir);
its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``, with further columns of docs as they
are, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelight.llm import langid, mixing, planes
from lurelight.llm.decontaminate import contaminated
from lurelight.llm.neardup import near_duplicates
from lurelight.llm.queries import TOKENIZER
from lurelight.llm.scratch import Scratch, small_batches, without

#: Least probability of a language; only texts in no known language fall below.
LEAST_SCORE = 0.3
#: A mix near the sources' own: the largest give up what is over the budget.
MIX = mixing.Mix(share=0.95, epochs=1)

#: Language identification and near duplicates have no SQL form; the tests hold
#: the stages against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are null, have no letter or are in no known language.
    Rows are judged one by one, also repeated ones and those with a null id; without
    any labelled row nothing is known and nothing stays."""
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs), LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five words, a
    similarity of 0.8 or more). Texts without words are in no group; rows that
    share an id are decided together, and rows with a null id stay."""
    return without(docs, near_duplicates(docs, percent=80).filter("not kept").select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item. Null and empty texts hold
    none; rows that share an id go together, and rows with a null id stay."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, Scratch(spark, "leaks").table(found.select("doc_id").distinct()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token prefixes of the sources that the budgets select. A null source or
    language is a name of its own; texts without words cost nothing; rows that share
    an id are taken together, also null ids."""
    return mixing.take(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, and what they hold for each document: doc_id, start,
    n_tokens, ids_crc32. A null text is an end id alone; repeated ids are written
    each, in the order of their texts; rows with a null id are left out."""
    path = Scratch(spark, "planes").base
    planes.write_tokens(docs, path, TOKENIZER)
    return planes.document_digests(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's table
    goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if done is not None:
            scratch.drop(done)
        done = docs
    return docs
