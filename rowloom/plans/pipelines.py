"""Chained, merged and parallel jobs, each as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowloom.operators.organize import threshold_bin
from rowloom.operators.summarize import match_bucket


def activity_bins(posts: DataFrame, users: DataFrame, owner: str, user: str, reputation: str) -> DataFrame:
    """Posts per user against the average over users, with the users' reputation (null if unknown)."""
    counts = posts.dropna(subset=[owner]).groupBy(F.col(owner).alias("user")).agg(F.count("*").alias("posts"))
    mean = counts.agg((F.sum("posts") / F.count("*")).alias("mean"))  # one row
    known = users.select(F.col(user).alias("user"), F.col(reputation).alias("reputation"))
    out = counts.crossJoin(F.broadcast(mean)).join(known, "user", "left")
    return out.select("user", "posts", "reputation", threshold_bin(F.col("posts"), F.col("mean"), "belowavg", "aboveavg").alias("bin"))


def bin_averages(binned: DataFrame) -> DataFrame:
    return binned.groupBy("bin").agg(F.avg("reputation").alias("average"))


def posts_per_value(posts: DataFrame, value: Column, limit: float) -> DataFrame:
    """Number of posts per value of their users' attribute, in two bins by the value."""
    return posts.groupBy(value.alias("value")).agg(F.count("*").alias("n")).withColumn("bin", threshold_bin(F.col("value"), F.lit(limit)))


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """df, and counters over its rows that are ready once an action on it has ended; they cost no pass of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counters.items()]), seen


def counters_only(df: DataFrame, **counters: Column) -> dict[str, int]:
    """The counters of a job without output."""
    rows, seen = observed(df, **counters)
    rows.write.format("noop").mode("overwrite").save()
    return seen.get


def state_counters(df: DataFrame, text: str, values: Sequence[str]) -> dict[str, int]:
    """Rows by the first whole token, upper-cased, that is among values: a counter for each, NullOrEmpty and Unknown."""
    bucket = match_bucket(F.col(text), values)
    return counters_only(df.select(bucket.alias("bucket")), **{name: F.count(F.when(F.col("bucket") == name, 1)) for name in [*values, "NullOrEmpty", "Unknown"]})


def counted_bins(posts: DataFrame, users: DataFrame, owner: str, user: str, reputation: str, path: str) -> dict[str, int]:
    """activity_bins() written by bin, with the counters records (posts with an owner) and users of its first job."""
    counts, seen = observed(posts.dropna(subset=[owner]).groupBy(F.col(owner).alias("user")).agg(F.count("*").alias("posts")), records=F.sum("posts"), users=F.count(F.lit(1)))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    total = {name: n or 0 for name, n in seen.get.items()}
    known = users.select(F.col(user).alias("user"), F.col(reputation).alias("reputation"))
    bin_ = threshold_bin(F.col("posts"), F.lit(total["records"] / max(1, total["users"])), "belowavg", "aboveavg")
    posts.sparkSession.read.parquet(f"{path}/counts").join(known, "user", "left").withColumn("bin", bin_).write.mode("overwrite").partitionBy("bin").parquet(f"{path}/bins")
    return total


def tagged(**outputs: DataFrame) -> DataFrame:
    """Several one-column outputs of one scan, told apart by `tag`."""
    parts = [df.select(F.lit(tag).alias("tag"), F.col(df.columns[0]).cast("string").alias("text")) for tag, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
