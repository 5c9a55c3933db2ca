"""Synthetic comment rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def comments(spark: SparkSession, tasks: int, per_task: int, vocabulary: Sequence[str], seed: int = 1, legacy_malformed: bool = False) -> DataFrame:
    """tasks * per_task lines `<row Id= PostId= Score= Text= CreationDate= UserId= />`; texts have 1 to 30 words."""
    pick = lambda top, i: F.floor(F.rand(seed + i) * top).cast("long")
    ids = spark.range(0, tasks * per_task, 1, max(1, tasks)).withColumnRenamed("id", "at_row")
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    row = ids.select("at_row", pick(10**9, 0).alias("Id"), pick(10**8, 1).alias("PostId"), pick(15_000, 2).alias("Score"), pick(10**6, 3).alias("UserId"), pick(30, 4).alias("n"), pick(2_000_000_000, 5).alias("at"))
    word = lambda i: F.concat(F.get(vocab, F.pmod(F.xxhash64(F.lit(seed), "at_row", i), F.lit(len(vocabulary))).cast("int")), F.lit(" "))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n")), word), "")
    date = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    user = F.concat(F.lit('UserId"=' if legacy_malformed else 'UserId="'), F.col("UserId").cast("string"), F.lit('"'))
    parts = [F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in (("Id", F.col("Id")), ("PostId", F.col("PostId")), ("Score", F.col("Score")), ("Text", text), ("CreationDate", date))]
    return row.select(F.concat(F.lit("<row "), F.concat_ws(" ", *parts, user), F.lit(" />")).alias("value"))
