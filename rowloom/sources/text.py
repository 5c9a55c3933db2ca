"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files or folders, plain or gzip, without line ends."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"))


def key_tab_value(spark: SparkSession, path: str) -> DataFrame:
    """key and value on both sides of a line's first tab; value is null without one."""
    at = F.locate("\t", "value")
    return lines(spark, path).select(F.when(at > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value")).alias("key"), F.when(at > 0, F.substr("value", at + 1)).alias("value"))


def write_key_tab_value(df: DataFrame, path: str, *columns: str | Column) -> None:
    """Tab-joined columns, null as empty text; what was there is replaced."""
    df.select(F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


#: Words of a list up to which it becomes a part of the plan.
MOST_WORDS = 10_000


def word_list(spark: SparkSession, path: str, most: int = MOST_WORDS) -> list[str]:
    """The distinct words of a side file or folder, one a line, plain or gzip, without blanks around them; a longer list than most is an error."""
    found = lines(spark, path).select(F.trim("value").alias("word")).filter("word <> ''").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{path} has more than {most} words")
    return sorted(r.word for r in found)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder wherever it is; says whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_named(df: DataFrame, path: str, name: str, *columns: str) -> None:
    """Named outputs: a folder of text files for each value of a column, lines of the tab-joined columns."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")
    df.select(line, name).write.mode("overwrite").partitionBy(name).text(path)


def write_bins(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each value of the bin columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
