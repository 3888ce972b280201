"""Views of any table for a dataset explorer: search, categories, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def searchable(df: DataFrame) -> Column:
    """A row as lower-case JSON, in which a search looks."""
    return F.lower(F.to_json(F.struct(*df.columns)))


def search(df: DataFrame, words: str = "", category: str | None = None, value: str | None = None) -> DataFrame:
    """The rows whose JSON holds the text, of one category if one is given."""
    if category and value:
        df = df.filter(F.col(category) == value)
    return df.filter(F.instr(searchable(df), words.lower()) > 0) if words else df


def categories(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are there, in order."""
    return df.select(F.col(column).alias("category")).filter("category <> ''").distinct().orderBy("category")


def totals(df: DataFrame, condition: Column, group: str) -> DataFrame:
    """One row: rows, rows under a condition, distinct groups."""
    return df.agg(F.count("*").alias("rows"), F.count_if(condition).alias("matching"), F.count_distinct(group).alias("groups"))
