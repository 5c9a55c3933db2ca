"""A sharded key-value hash store on files: host=N/hash=NAME folders of (field, value).

Stands in for a server's hash tables: writing routes fields to hosts and the last value of a field wins;
reading lists only the hosts and hashes that are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def write_hash(df: DataFrame, path: str, field: str, value: str, name: str, hosts: int, order: str | None = None) -> None:
    """Fields by hash over the hosts. The last value of a field is the one with the greatest order, or without an order the last of the scan."""
    rows = _last(df.dropna(subset=[field]).select(F.col(field).cast("string").alias("field"), F.col(value).cast("string").alias("value"), _order(order)), "field")
    rows.withColumn("host", F.pmod(F.xxhash64("field"), F.lit(hosts)).cast("int")).withColumn("hash", F.lit(name)).write.mode("overwrite").partitionBy("host", "hash").parquet(path)


def read_hash(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("hash") == name).select("field", "value")


def _order(order: str | None) -> Column:
    return (F.col(order) if order else F.monotonically_increasing_id()).alias("__at")


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by("value", "__at").alias("value"))


def write_months(df: DataFrame, path: str, field: str, value: str, time: Column, order: str | None = None) -> None:
    """One hash per month, two months per host; the last value of a field as in write_hash()."""
    month0 = F.month(time) - 1
    rows = df.select(F.col(field).cast("string").alias("field"), F.col(value).cast("string").alias("value"), month0.alias("month0"), _order(order)).dropna(subset=["field", "month0"])
    rows = _last(rows, "month0", "field")
    rows.withColumn("host", F.floor(F.col("month0") / 2).cast("int")).write.mode("overwrite").partitionBy("host", "month0").parquet(path)


def read_months(spark: SparkSession, path: str, months: Sequence[str]) -> DataFrame:
    """Rows of the named months; other folders aren't read."""
    at = [MONTHS.index(m) for m in months]
    hosts = sorted({m // 2 for m in at})
    return spark.read.parquet(path).filter(F.col("host").isin(hosts) & F.col("month0").isin(at)).select("month0", "field", "value")
