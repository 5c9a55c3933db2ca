"""Bloom filters: sizing, training and probing with DataFrame functions."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources.text import lines

#: The plan holds filters of at most so many bits, 64 in a number.
LITERAL_BITS = 1 << 22


def sizing(n: Column, p: Column) -> tuple[Column, Column]:
    """(bits, hash functions) for n members at false positive rate p."""
    m = F.floor(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0)))
    return m.cast("long"), F.round(m / n * F.ln(F.lit(2.0))).cast("long")


def size_for(n: int, p: float) -> tuple[int, int]:
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, round(m / n * math.log(2))


def _bit(key: Column, i: int, m: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(m))


def _bits(key: Column, m: int, k: int) -> Column:
    return F.array_distinct(F.array(*[_bit(key, i, m) for i in range(k)]))


def train(df: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """Set bits, at most m rows."""
    return df.dropna(subset=[key]).select(F.explode(_bits(F.col(key), m, k)).alias("bit")).distinct()


def save(bits: DataFrame, path: str, m: int, k: int) -> None:
    """The filter as a file: its size, number of hash functions and set bits, 64 in a number."""
    _words(bits).select("at", "bits", F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(set bits, size, number of hash functions) of a saved filter; one without members has no bits and says no to all."""
    saved = spark.read.parquet(path)
    one = saved.select("m", "k").first()
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    bits = saved.select("at", F.explode(each).alias("i")).select((F.col("at") * F.lit(64).cast("long") + F.col("i")).alias("bit"))
    return (bits, one.m, one.k) if one else (bits, 1, 1)


def train_on_folder(spark: SparkSession, path: str, m: int, k: int) -> DataFrame:
    """The filter of the lines of all files of a folder, plain or gzip, without blanks around them."""
    return train(lines(spark, path).select(F.trim("value").alias("value")).filter("value <> ''"), "value", m, k)


def _words(bits: DataFrame) -> DataFrame:
    return bits.groupBy(F.expr("bit div 64").cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def probe(df: DataFrame, key: str, bits: DataFrame, m: int, k: int, most: int = LITERAL_BITS) -> DataFrame:
    """Rows whose key may be a member. A filter of up to `most` bits travels in the plan; a larger one stays a
    table, which is joined once per hash function."""
    if m > most:
        for i in range(k):
            df = df.join(bits.select(F.col("bit").alias("__bit")), _bit(F.col(key), i, m) == F.col("__bit"), "left_semi")
        return df
    slots = _words(bits)
    got = [0] * -(-m // 64)
    for at, held in slots.toLocalIterator():
        got[at] = held
    # one constant array, folded when the plan is made: a probe is a look at one number
    filled = F.split(F.lit(",".join(map(str, got))), ",").cast("array<bigint>")

    def held(bit: Column) -> Column:
        return F.getbit(F.get(filled, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1

    each = [held(_bit(F.col(key), i, m)) for i in range(k)]
    return df.filter(reduce(and_, each, F.col(key).isNotNull()))
