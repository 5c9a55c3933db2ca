"""Equi-joins of five kinds, broadcast, bucketed and reduced joins, token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("inner", "leftouter", "rightouter", "fullouter", "symmetric_anti")


def equi_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, how: str = "inner") -> DataFrame:
    """symmetric_anti: rows of a without b and rows of b without a."""
    if how not in KINDS:
        raise ValueError(f"unknown join: {how}")
    on = F.col(a_key) == F.col(b_key)
    if how == "symmetric_anti":
        return a.join(b, on, "fullouter").filter(F.col(a_key).isNull() | F.col(b_key).isNull())
    return a.join(b, on, how)


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("row")).select(key, "row.*").select(*df.columns)


def replicated_join(probe: DataFrame, small: DataFrame, probe_key: str, small_key: str, order: str, how: str = "inner") -> DataFrame:
    """Probe rows with the last small row of their key. There is no hint: adaptive execution broadcasts the small side if
    its bytes, known once it is aggregated, are below spark.sql.autoBroadcastJoinThreshold, and else sorts and merges."""
    if how not in ("inner", "leftouter"):
        raise ValueError(f"unknown join: {how}")
    return probe.join(last_by_key(small, small_key, order), F.col(probe_key) == F.col(small_key), how)


def bucketed(df: DataFrame, table: str, key: str, buckets: int = 8) -> DataFrame:
    """df as a table bucketed and sorted by key: joins of such tables need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def composite_join(spark: SparkSession, a: str, b: str, a_key: str, b_key: str, how: str = "inner") -> DataFrame:
    """Join of two bucketed tables: merge join without exchange."""
    if how not in ("inner", "outer"):
        raise ValueError(f"unknown join: {how}")
    return spark.table(a).hint("merge").join(spark.table(b), F.col(a_key) == F.col(b_key), "inner" if how == "inner" else "fullouter")


def reduced_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, where: Column, how: str = "inner") -> DataFrame:
    """Join of a's rows where the condition holds with b's rows of their keys. Catalyst adds a Bloom filter
    on b at run time where it pays; the semi join is the exact meaning."""
    kept = a.filter(where)
    return equi_join(kept, b.join(kept.select(F.col(a_key).alias(b_key)).distinct(), b_key, "left_semi"), a_key, b_key, how)


def token_overlap(df: DataFrame, id_col: str, tokens: Column, least: int = 3) -> DataFrame:
    """Ordered pairs of rows whose texts share at least so many tokens, with their number; a row doesn't pair with itself, and
    rows that repeat an id are one with all their tokens.

    Tokens are put in order of how many rows have them. Two rows that share `least` tokens share one that isn't among the last
    least - 1 of either, its most frequent: only the others are joined on, and what meets is counted exactly."""
    each = df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).distinct()
    frequent = each.groupBy("token").agg(F.count("*").alias("n"))
    sets = each.join(frequent, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all")).filter(F.size("all") >= least)
    sets = sets.select("id", F.col("all.token").alias("all"))
    rare = sets.select("id", "all", F.explode(F.slice("all", F.lit(1), F.size("all") - (least - 1))).alias("token"))
    l, r = rare.select(F.col("id").alias("a"), F.col("all").alias("all_a"), "token"), rare.select(F.col("id").alias("b"), F.col("all").alias("all_b"), "token")
    # a pair is counted at the first token that both have
    both = F.array_intersect("all_a", "all_b")
    pairs = l.join(r, "token").filter("a < b").select("a", "b", "token", both.alias("both")).filter((F.get("both", F.lit(0)) == F.col("token")) & (F.size("both") >= least))
    shared = F.size("both").cast("long").alias("shared")
    way = F.explode(F.array(F.struct(F.col("a").alias("left_id"), F.col("b").alias("right_id")), F.struct(F.col("b").alias("left_id"), F.col("a").alias("right_id")))).alias("way")
    return pairs.select(way, shared).select("way.*", "shared")


def theta_pairs(a: DataFrame, b: DataFrame, where: Column, rows: int = 8, columns: int = 8) -> DataFrame:
    """All pairs where a condition holds, for inputs whose product is wanted. The product is a grid of rows x columns cells: a row of a
    meets the rows of b in the cells of its grid row, so no side is broadcast and each cell is a task's share."""
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    names = a.columns, b.columns
    deal = lambda df, n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = a.withColumn("__row", deal(a, rows)).withColumn("__column", F.explode(upto(columns)))
    right = b.withColumn("__column_b", deal(b, columns)).withColumn("__row_b", F.explode(upto(rows)))
    met = left.join(right, (F.col("__row") == F.col("__row_b")) & (F.col("__column") == F.col("__column_b")))
    return met.filter(where).select(*names[0], *names[1])
