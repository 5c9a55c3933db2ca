"""Filters: regular expressions, samples, top rows, distinct, membership."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.rows import words


def grep(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose whole text matches."""
    return df.filter(F.col(text).rlike(rf"\A(?:{pattern})\z"))


def sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    return df.sample(False, percent / 100, seed)


def top(df: DataFrame, value: str, tie: str, n: int = 10, ties: str = "collapse") -> DataFrame:
    """The n largest by value. Ties collapse to the greatest tie value, or are kept as rows."""
    if ties not in ("collapse", "keep"):
        raise ValueError(f"unknown ties: {ties}")
    rows = df.dropna(subset=[value, tie])
    if ties == "collapse":
        most = rows.select(F.col(value).alias("__most")).distinct().orderBy(F.desc("__most")).limit(n)  # n rows
        rows = rows.join(F.broadcast(most), F.col(value) == F.col("__most"), "left_semi")
        rows = rows.groupBy(value).agg(F.max_by(F.struct(*[c for c in df.columns if c != value]), tie).alias("row")).select(value, "row.*").select(*df.columns)
    return rows.orderBy(F.desc(value), F.desc(tie)).limit(n)


def distinct(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).dropna().distinct()


def count_distinct(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("total"))


def hot_words(df: DataFrame, text: str, hot: Sequence[str], case_sensitive: bool = True) -> DataFrame:
    """Rows with a token that is a hot word: quotes go, other non-letters become spaces inside a token."""
    t = F.col(text) if case_sensitive else F.lower(text)
    if all(re.fullmatch("[a-zA-Z]+", w) for w in hot):  # then a token with other characters can't be one
        return df.filter(F.exists(words(F.replace(t, F.lit("'"), F.lit(""))), lambda w: w.isin(*hot)))
    tokens = F.transform(words(t), lambda w: F.regexp_replace(F.regexp_replace(w, "'", ""), "[^a-zA-Z]", " "))
    return df.filter(F.exists(tokens, lambda w: w.isin(*hot)))


def not_of_type(df: DataFrame, kind: str, value: int | str) -> DataFrame:
    """Rows of any other type; a null type stays."""
    return df.filter(~F.col(kind).eqNullSafe(F.lit(value)))


def members(df: DataFrame, key: str, of: DataFrame, of_key: str, where: Column) -> DataFrame:
    """Rows of df whose key is one of the rows of `of` where the condition holds."""
    return df.join(of.filter(where).select(F.col(of_key).alias(key)), key, "left_semi")
