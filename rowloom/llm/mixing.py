"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

Every document draws an exponential key -ln(u) / weight, u from a seeded hash of its id and text.
Within a source, documents sorted by key are prefix-summed against the source's word budget: whole
epochs first (everybody is taken that often), then the fractional rest in key order. The numbers give
a part of the words of the document on the border; the mixed documents have it whole or not at all.

Cases: a null or blank text has size 0 and takes nothing; a null id or source is a value like any
other; rows that repeat an id are separate rows, equal keys go by id and size (in the mixed documents, equal
keys are taken alike); an empty table gives an empty result. The mixed documents carry the input's
columns inside one struct, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import WORD, id_text, record, table, unpacked, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Mean characters of a word with its space in ordinary prose; words of which half a text's weight comes.
ORDINARY, SCRAP = 6.0, 20
#: Documents of a source that one task sorts, on average.
ROWS_PER_BIN = 2_000


def quality(text: Column, size: Column) -> Column:
    """Weight from 0.1 to 1.1, known before any model is trained: near 1 for long texts whose words have ORDINARY characters
    with the space after them, less the further the mean is from that (junk, numbers, runs without spaces) and for scraps of few words."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    shape = F.least(mean / ORDINARY, F.lit(ORDINARY) / F.greatest(mean, F.lit(1.0)))
    return F.lit(0.1) + F.coalesce(shape, F.lit(0.0)) * (size / (size + SCRAP))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: rows, size and target. Targets are min(cap * size, level * weight); the
    level that shares the total out is found in order of size / weight, which equals passing
    excess on until no target is above its cap."""
    by = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    by = by.withColumn("at", F.row_number().over(order) - 1)
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    rank = Window.orderBy("ratio", "at")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(every))
    by = by.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("capped_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.try_divide(F.col("total") - F.col("capped"), F.col("all_w") - F.col("capped_w")))
    # the first source in this order that stays below its cap sets the level
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))).over(every)["level"])
    target = F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return by.select("source", "n_rows", "source_size", target.alias("target"))


def key(seed: str, size: Column) -> Column:
    """The exponential key of a row with doc_id and text: -ln(u) / quality."""
    u = uniform(F.concat(F.lit(seed + "|"), id_text("doc_id"), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return -F.log(u) / quality(F.col("text"), size)


def drawn(docs: DataFrame, weights: tuple, share: float, cap: float, seed: str, rows_per_bin: int) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs and left: what the source's fractional rest has left for a row when all
    with smaller keys have had their part. Texts are read once; what follows works on numbers. Prefix sums run in bins
    of key ranges, whose totals are summed before, so a source of any size spreads over many tasks."""
    size = word_count(F.col("text"))
    slim = written(docs.select("doc_id", "source", size.alias("size"), key(seed, size).alias("key")))
    targets = written(source_targets(slim, weights, share, cap))
    keyed = slim.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    # 1 - exp(-key) rises with the key and lies in (0, 1)
    n_bins = F.ceil(F.col("n_rows") / F.lit(rows_per_bin))
    keyed = keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * n_bins).cast("long"))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), F.coalesce(F.sum("bin_size").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    whole = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = whole - epochs * F.col("source_size") - F.col("start") - F.col("before")
    return rows.select("doc_id", "source", "size", "key", "source_size", "target", epochs.alias("epochs"), left.alias("left"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Each document's doc_id, source, size, source_size, target and taken: the words the mix takes, a part of the document on the border."""
    part = F.greatest(F.lit(0), F.least("size", "left"))
    return drawn(docs, weights, share, cap, seed, rows_per_bin).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


#: Sources up to which their list is broadcast.
MOST_SOURCES = 100_000


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy. A document on the border is taken whole where that comes
    nearer to the target, else left. Of each source, the epochs and the largest key taken decide; rows are not joined with their parts."""
    names = docs.columns
    rows = drawn(docs, weights, share, cap, seed, rows_per_bin)
    fits = 2 * F.col("left") >= F.col("size")
    by = rows.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(fits, F.col("key"))).alias("low"), F.min(F.when(~fits, F.col("key"))).alias("high"))
    # between the last key that is taken and the first that isn't
    by = written(by.select(F.col("source").alias("of_source"), "epochs", ((F.coalesce("low", F.lit(0.0)) + F.coalesce("high", F.lit(float("inf")))) / 2).alias("upto")))
    if by.count() <= MOST_SOURCES:
        by = F.broadcast(by)
    size = word_count(F.col("text"))
    out = docs.select(record(names), F.col("source").alias("own_source"), size.alias("words"), key(seed, size).alias("key"))
    out = out.filter("words > 0").join(by, F.col("own_source").eqNullSafe(F.col("of_source")))
    copies = (F.col("epochs") + F.when(F.col("key") <= F.col("upto"), 1).otherwise(0)).cast("int")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select(*unpacked(names))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_SIZE = f"coalesce(length(regexp_extract_all(\"text\", '{WORD}')), 0)::BIGINT"
OP5_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, {_SIZE} AS size, 
    0.1::DOUBLE + coalesce(least(length("text") / greatest({_SIZE}, 1)::DOUBLE / 6.0::DOUBLE, 6.0::DOUBLE / greatest(length("text") / greatest({_SIZE}, 1)::DOUBLE, 1.0::DOUBLE)), 0.0::DOUBLE) * ({_SIZE} / ({_SIZE} + 20)::DOUBLE) AS quality,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce("text", ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(pos % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM src),
r AS (
  SELECT *, most / w AS ratio, sum(source_size) OVER ()::DOUBLE * 1.5 AS total, sum(w) OVER () AS all_w,
    coalesce(sum(most) OVER (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    coalesce(sum(w) OVER (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w FROM w),
f AS (SELECT (total - capped) / (all_w - capped_w) AS level FROM r WHERE (total - capped) / (all_w - capped_w) <= ratio ORDER BY ratio, pos LIMIT 1),
l AS (SELECT r.*, f.level FROM r LEFT JOIN f ON true),
t AS (SELECT source, source_size, least(most, coalesce(level * w, most)) AS target FROM l),
k AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.u) / s.quality, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    round(t.target)::BIGINT AS whole, CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, whole - epochs * source_size - before)))::BIGINT AS taken FROM k
"""
