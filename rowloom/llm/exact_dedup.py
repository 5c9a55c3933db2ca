"""Exact dedup by a log-structured merge index, DataFrame functions only.

Each input partition is a memtable: it flushes one run, sorted by digest, into a table. The runs' filter has a slot for
every hash of a digest and says which slots several rows set: a digest in another slot is there once and skips
all that follows. Compaction merges what is left of the runs: per digest the winning row (most code points, then smallest
id) and the group's size. Hits, digests with several rows, are verified byte by byte: only their texts are read again and
shuffled, and the least and the greatest normalised text of a digest must be the same bytes; a digest that fails is
split by the texts themselves.

The filter has 2**23 slots, a bounded broadcast; beyond some millions of rows it lets more pass, and compaction does the work.

Cases: a null text counts as empty; rows that repeat an id are separate rows of which one at most
stays (the earliest of the table); a null id sorts after all others; an empty table gives an empty
result. Rows are known by their file and place in it; what is no scan of files is written first. Only
doc_id and text are read, under names of their own, so clashing columns do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import WS_CLASS, maybe_in, numbered, placed, probed, record, slot, table, those_not_in, unpacked, written


def normal(text: Column) -> Column:
    """text (null: empty) without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+", "")


def flush_runs(docs: DataFrame, files: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The runs: uid, doc_id, chars, text_sha256, digest; each part file is sorted by digest."""
    sha = F.sha2(normal(F.col("text")).cast("binary"), 256)
    runs = numbered(docs, files, "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), sha.alias("text_sha256"))
    return written(runs.withColumn("digest", digest(F.col("text_sha256"))).sortWithinPartitions("digest"))


def compact(runs: DataFrame, by: str) -> DataFrame:
    """One row per key: the row that stays and the size of its group."""
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "uid")
    merged = runs.groupBy(F.col(by).alias("key")).agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return merged.select("key", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")


def dedup_index(docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """Per row of docs: uid (its place, see numbered()), doc_id, keep_id, keep_uid, group_size, text_sha256."""
    docs, files = placed(docs)
    return _index(docs, files, digest)


def _index(docs: DataFrame, files: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    runs = flush_runs(docs, files, digest)
    several = runs.groupBy(slot("digest").alias("slot")).count().filter("count > 1").select("slot")
    runs = probed(runs, slot("digest"), written(several))
    own = ["uid", "doc_id", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.lit(1).cast("long").alias("group_size"), "text_sha256"]
    single, doubtful = runs.filter("not maybe").select(*own), runs.filter("maybe").drop("maybe")
    index = written(compact(doubtful, "digest"))
    hits = written(doubtful.join(index.filter("group_size > 1").select(F.col("key").alias("digest")), "digest", "left_semi").select("uid", "digest"))
    # the texts of hits, and of no other rows
    texts = maybe_in(numbered(docs, files, "text"), "uid", hits, "uid").filter("maybe").select("uid", normal(F.col("text")).alias("norm")).join(hits, "uid")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    bad = written(ends.filter("low <> high").select("digest"))
    out = ["uid", "doc_id", "keep_id", "keep_uid", "group_size", "text_sha256"]
    if bad.isEmpty():
        return single.unionByName(doubtful.join(index, F.col("digest") == F.col("key")).select(*out))
    # texts that differ under one digest: they tell themselves apart
    split = doubtful.join(bad, "digest", "left_semi").join(texts.select("uid", "norm"), "uid")
    split = split.join(compact(split, "norm"), F.col("norm") == F.col("key")).select(*out)
    rest = doubtful.join(bad, "digest", "left_anti").join(index, F.col("digest") == F.col("key")).select(*out)
    return single.unionByName(rest).unionByName(split)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = docs.columns
    docs, files = placed(docs)
    dropped = written(_index(docs, files).filter("uid <> keep_uid").select("uid"))
    return those_not_in(numbered(docs, files, record(names)), "uid", dropped, "uid").select(*unpacked(names))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = dedup_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


OP4_SQL = f"""
WITH n AS (
  SELECT doc_id, coalesce(length("text"), 0) AS chars, regexp_replace(coalesce("text", ''), '[{WS_CLASS}]+', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, pos = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
