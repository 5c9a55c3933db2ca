"""Nesting, partitions, bins, total order, shuffling, anonymising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.filtering import not_of_type


def nest(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: Sequence[str]) -> DataFrame:
    """Parents with an array of their children, sorted; childless parents stay, orphans go."""
    rest = [c for c in children.columns if c not in (*order, child_key)]
    grouped = children.groupBy(child_key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("children"))
    return parents.join(grouped, F.col(key) == F.col(child_key), "left").drop(child_key)


def element(tag: str, attributes: Column, names: Sequence[str], content: Column | None = None) -> Column:
    """One XML element on one line: the fields of a struct as attributes, null ones left out, line breaks in values dropped."""

    def escaped(v: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", ""), ("\r", "")):
            v = F.replace(v, F.lit(char), F.lit(entity))
        return v

    parts = [F.coalesce(F.concat(F.lit(f' {n}="'), escaped(attributes[n].cast("string")), F.lit('"')), F.lit("")) for n in names]
    opened = F.concat(F.lit(f"<{tag}"), *parts)
    if content is None:
        return F.concat(opened, F.lit("/>"))
    return F.when(content == "", F.concat(opened, F.lit("/>"))).otherwise(F.concat(opened, F.lit(">"), content, F.lit(f"</{tag}>")))


def nested_xml(nested: DataFrame, parent: Sequence[str], child_tag: str, tag: str) -> Column:
    """One line per nested row: the parent's columns and the children's fields as attributes."""
    names = nested.schema["children"].dataType.elementType.names
    kids = F.array_join(F.transform("children", lambda c: element(child_tag, c, names)), "")
    return element(tag, F.struct(*parent), parent, F.coalesce(kids, F.lit("")))


def questions_with_answers(posts: DataFrame, id_col: str, parent: str, kind: str) -> DataFrame:
    """Rows of kind 1 with their answers, the rows of any other kind, or none, whose parent they are."""
    answers = not_of_type(posts, kind, 1)
    named = answers.select(F.col(parent).alias("__of"), *[c for c in posts.columns if c != parent])
    return nest(posts.filter(F.col(kind) == 1), named, id_col, "__of", [id_col])


def partition_number(year: Column, first: int) -> Column:
    return (year - first).cast("int")


def write_partitions(df: DataFrame, path: str, year: Column, first: int, parts: int) -> None:
    """A folder pid=0 to parts - 1 for each year from first on; years outside of them, which have no partition, go to pid=-1; rows without a year are dropped."""
    pid = partition_number(year, first)
    df.withColumn("pid", F.when(pid.between(0, parts - 1), pid).when(pid.isNotNull(), -1)).dropna(subset=["pid"]).write.mode("overwrite").partitionBy("pid").parquet(path)


def bins(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A row for every bin whose condition holds."""
    which = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda b: b.isNotNull())
    return df.withColumn("bin", F.explode(which))


def threshold_bin(value: Column, limit: Column, low: str = "below", high: str = "above") -> Column:
    return F.when(value < limit, low).otherwise(high)


def total_order(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """Sorted across and within parts."""
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def shuffled(df: DataFrame, seed: int, parts: int = 10) -> DataFrame:
    """Rows in random order."""
    return df.repartition(parts, F.rand(seed)).sortWithinPartitions(F.rand(seed + 1))


def anonymized(df: DataFrame, drop: Sequence[str], day: str) -> DataFrame:
    """Without the id columns, times cut to days."""
    return df.drop(*drop).withColumn(day, F.substring_index(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), "T", 1))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def month_shard(time: Column) -> Column:
    return F.floor((F.month(time) - 1) / 2).cast("int")
