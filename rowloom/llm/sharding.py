"""Two-pass external shuffle into shards.

Pass 1 scatters records by a seeded hash into memory-sized buckets, uniformly whatever their keys:
the hash takes the record's place in the scan and nothing else, so equal ids and texts spread too. Pass 2 puts
every bucket in an order that doesn't depend on arrival, shuffles it with Fisher-Yates and writes
it. Bucket counts (one small row per bucket) give each record its global position; shard s holds the
positions from s * N / shards on. The law is `rows`: counts differ by one at most.

Cases: a null text has 16 bytes and the CRC of the empty text; null and repeated ids are ordinary records;
an empty table gives an empty result; a text longer than a bucket's share makes one larger bucket.
All columns of the records travel in one struct, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import record, scratch, table, written

SHARDS = 40
SEED = 20
BUCKET_BYTES = 32 << 20
RECORD_BYTES = 16


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0 to n - 1."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    rng.shuffle(order)  # Fisher-Yates, in place
    return order


def shuffled_buckets(docs: DataFrame, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs as written buckets: bucket, place (its turn in the bucket), size and the record as struct `row`."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES
    total = docs.select(size.alias("size")).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    uid = F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), size.alias("size"), record(docs.columns))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(buckets)).cast("int"))
    rows = rows.repartitionById(buckets, F.col("bucket"))  # one bucket a task

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        bucket, key = t.column("bucket").to_numpy(), t.column("uid").to_numpy()
        order = np.lexsort((key, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            b = int(bucket[part[0]])
            part = part[fisher_yates(len(part), seed * 1_000_003 + b)]
            for at in range(0, len(part), 1024):
                some = t.take(pa.array(part[at : at + 1024])).combine_chunks()
                place = pa.array(np.arange(at, at + some.num_rows, dtype=np.int64))
                for r in some.append_column("place", place).to_batches():
                    yield r

    out = rows.mapInArrow(shuffle, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())]))
    path = scratch(spark)
    out.drop("uid").write.parquet(path)
    return spark.read.schema(out.drop("uid").schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The shuffled records with shard and slot: `row`, size, shard, slot."""
    rows = shuffled_buckets(docs, text_col, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all"))
    counts = written(counts)  # its size is then known before the join is planned
    placed = rows.join(counts, F.col("bucket") == F.col("of")).withColumn("at", F.col("first") + F.col("place"))
    # shard s starts at ceil(s * all / shards)
    s = F.expr(f"at * {shards} div all")
    start = F.expr(f"(s * all + {shards - 1}) div {shards}")
    return placed.withColumn("s", s).select("row", "size", F.col("s").cast("int").alias("shard"), (F.col("at") - start).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
