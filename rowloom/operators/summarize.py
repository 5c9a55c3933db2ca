"""Summaries: counts, extremes, means, medians, buckets, inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.rows import plain_words, unescape_html4, words


def word_count(df: DataFrame, text: str, escaped: bool = False) -> DataFrame:
    """Rows per word; on request, entities of the text are decoded first."""
    own = unescape_html4(text) if escaped else F.col(text)
    return df.select(F.explode(plain_words(own)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def min_max_count(df: DataFrame, key: str, value: str) -> DataFrame:
    rows = df.dropna(subset=[key, value])
    return rows.groupBy(key).agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def count_average(df: DataFrame, key: Column, value: Column) -> DataFrame:
    rows = df.select(key.alias("key"), value.alias("value")).dropna()
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("average"))


#: Ranges of values that a key's rows are counted in on the way to its median.
RANGES = 64


def medians(counted: DataFrame) -> DataFrame:
    """(key, median) of rows (key, value, n), each value n times. No task holds a key's values: they are counted in ranges between approximate
    quantiles, and only the one or two ranges that hold the middle are put in order."""
    cuts = counted.groupBy("key").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], F.lit(4 * RANGES)).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    ranged = counted.join(cuts.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", "value", "n", at.alias("at"))
    by = Window.partitionBy("key").orderBy("at")
    sizes = ranged.groupBy("key", "at").agg(F.sum("n").alias("size"))  # RANGES rows a key
    sizes = sizes.withColumn("upto", F.sum("size").over(by)).withColumn("all", F.sum("size").over(Window.partitionBy("key")))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = sizes.filter((F.col("upto") > low) & (F.col("upto") - F.col("size") <= high))
    middle = middle.select(F.col("key").alias("of"), F.col("at").alias("of_at"), (F.col("upto") - F.col("size")).alias("before"), "all")
    rows = ranged.join(middle, (F.col("key") == F.col("of")) & (F.col("at") == F.col("of_at")))
    rows = rows.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("key", "at").orderBy("value")))
    has = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
    value = F.col("value").cast("double")
    return rows.groupBy("key").agg((0.5 * F.max(F.when(has(low), value)) + 0.5 * F.max(F.when(has(high), value))).alias("median"))


def median_stddev(df: DataFrame, key: Column, value: Column, nan_on_single: bool = False) -> DataFrame:
    """Exact median and sample deviation, which is null (or NaN on request) for one value."""
    rows = df.select(key.alias("key"), value.alias("value")).dropna()
    spread = rows.groupBy("key").agg(F.stddev_samp("value").alias("stddev"))
    out = medians(rows.groupBy("key", "value").agg(F.count("*").alias("n"))).join(spread, "key")
    return out.withColumn("stddev", F.coalesce("stddev", F.lit(float("nan")))) if nan_on_single else out


def median_stddev_histogram(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """The same from value frequencies alone: what is shuffled and held are distinct values."""
    rows = df.select(key.alias("key"), value.alias("value")).dropna().groupBy("key", "value").agg(F.count("*").alias("n"))
    x, n = F.col("value").cast("double"), F.col("n")
    mean = rows.groupBy("key").agg((F.sum(x * n) / F.sum(n)).alias("mean"))
    out = rows.join(mean, "key").groupBy("key").agg(F.sum(n).alias("total"), F.sum((x - F.col("mean")) * (x - F.col("mean")) * n).alias("spread"))
    return medians(rows).join(out, "key").select("key", "median", F.when(F.col("total") > 1, F.sqrt(F.col("spread") / (F.col("total") - 1))).alias("stddev"))


def match_bucket(text: Column, values: Sequence[str]) -> Column:
    tokens = F.split(F.upper(text), r"\s")
    found = F.try_element_at(F.filter(tokens, lambda t: t.isin(*values)), F.lit(1))
    return F.when(F.coalesce(text, F.lit("")) == "", "NullOrEmpty").otherwise(F.coalesce(found, F.lit("Unknown")))


def first_match_bucket(df: DataFrame, text: str, values: Sequence[str]) -> DataFrame:
    """Rows by the first whole token, upper-cased, that is among values; Unknown, or NullOrEmpty."""
    return df.select(match_bucket(F.col(text), values).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def inverted_index(df: DataFrame, term: Column, id_col: str) -> DataFrame:
    """term -> ids, space-joined in id order; rows without term or id are dropped."""
    rows = df.select(term.alias("term"), F.col(id_col).alias("id")).filter("term is not null and term <> '' and id is not null")
    return rows.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))


def average(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(F.col(value).try_cast("double")).alias("average"))


__all__ = ["average", "count_average", "first_match_bucket", "inverted_index", "median_stddev", "medians", "median_stddev_histogram", "min_max_count", "word_count", "words"]
