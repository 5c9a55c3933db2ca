"""Rows of the form `<row k="v" ... />`: parsing, projection and writing, as native expressions."""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[\x00-\x20]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is made once however often body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_pairs(line: Column) -> Column:
    """array<struct<k, v>> of a line's attributes, values still escaped.

    The line is trimmed, loses its first five and last three characters and is split at quotes, without
    trailing empty parts; parts pair up as key and value, a key loses its last character (the
    equals sign). Parsing stops at an empty key. The last of equal keys counts (see attr)."""
    trimmed = lambda x: F.regexp_replace(x, rf"\A{SPACES}+|{SPACES}+\z", "")
    inner = let(trimmed(line), lambda t: F.when(F.length(t) >= 8, F.substr(t, F.lit(6), F.length(t) - 8)).otherwise(""))

    def paired(parts: Column) -> Column:
        pair = lambda i: F.struct(trimmed(F.get(parts, i * 2)).alias("key"), F.get(parts, i * 2 + 1).alias("v"))
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), pair)
        return F.when(F.size(parts) >= 2, pairs).otherwise(F.array().cast("array<struct<key:string,v:string>>"))

    def upto_empty(pairs: Column) -> Column:
        stop = F.array_position(F.transform(pairs, lambda p: p["key"] == ""), True).cast("int")
        return F.when(stop > 0, F.slice(pairs, F.lit(1), stop - 1)).otherwise(pairs)

    pairs = let(let(F.split(F.regexp_replace(inner, '"+\\z', ""), '"', -1), paired), upto_empty)
    return F.transform(pairs, lambda p: F.struct(F.substr(p["key"], F.lit(1), F.length(p["key"]) - 1).alias("k"), p["v"].alias("v")))


def attr(pairs: Column, name: str) -> Column:
    """Value of an attribute, null if absent."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def parse_rows(lines: DataFrame, names: list[str], column: str = "value", skip_headers: bool = True) -> DataFrame:
    """lines with a column per attribute; header and wrapper lines are skipped on request. A line is parsed once, whatever
    the number of attributes."""
    if skip_headers:
        lines = lines.filter(F.regexp_replace(column, rf"\A{SPACES}+", "").startswith("<row "))
    values = let(row_pairs(F.col(column)), lambda pairs: F.struct(*[attr(pairs, n).alias(f"a{i}") for i, n in enumerate(names)]))
    return lines.select(column, F.explode(F.array(values)).alias("__row")).select(column, *[F.col(f"__row.a{i}").alias(n) for i, n in enumerate(names)])


def to_row(pairs: Column, end: str = "/>") -> Column:
    """`<row k="v" ... />` from pairs, in their order."""
    return F.concat(F.lit("<row "), F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit('="'), p["v"], F.lit('" '))), ""), F.lit(end))


def keyed(lines: DataFrame, name: str, column: str = "value") -> DataFrame:
    """(key, row): every line under one of its attributes; lines without it are dropped."""
    return parse_rows(lines, [name], column).select(F.col(name).alias("key"), F.col(column).alias("row")).dropna(subset=["key"])


def anonymized_row(line: Column, drop: Sequence[str] = ("Id", "UserId"), day: str = "CreationDate") -> Column:
    """The line written back without the dropped attributes and with the time cut off the day; null for a line without attributes."""

    def rewritten(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p: ~p["k"].isin(*drop))
        cut = F.transform(kept, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == day, F.substring_index(p["v"], "T", 1)).otherwise(p["v"]).alias("v")))
        return F.when(F.size(pairs) > 0, to_row(cut, end=">"))

    return let(last_of_each(row_pairs(line)), rewritten)


def last_of_each(pairs: Column) -> Column:
    """pairs without those that a later one of the same key replaces."""
    return let(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda q: q["k"] == p["k"])))


def timestamp(text: Column) -> Column:
    """`yyyy-MM-dd'T'HH:mm:ss.SSS` as a timestamp without zone, null if it doesn't parse."""
    return F.when(text.rlike(r"\.[0-9]{1,3}\z"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.[SSS][SS][S]"))).cast("timestamp_ntz")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


@F.pandas_udf(StringType())
def unescape_html4(text: pd.Series) -> pd.Series:
    """HTML 4 entities decoded; a semicolon is required, other names (apos) stay."""
    names = html.entities.name2codepoint

    def one(m) -> str:
        code = m.group(1)
        if code[0] != "#":
            return chr(names[code]) if code in names else m.group()
        value = int(code[2:], 16) if code[1] in "xX" else int(code[1:])
        return chr(value) if value < 0x110000 else m.group()

    return text.str.replace(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", one, regex=True)


def words(text: Column) -> Column:
    """Tokens between space, tab, line and form feeds, without empty ones."""
    return F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda t: t != "")


def plain_words(text: Column) -> Column:
    """Lower-cased words: quotes go, everything but a-z becomes a space."""
    return F.filter(F.split(F.replace(F.lower(text), F.lit("'"), F.lit("")), "[^a-z]+"), lambda t: t != "")


def token_set(text: Column, stop: Column | None = None) -> Column:
    """Sorted distinct tokens of lower-cased a-z, 0-9 text without stop words."""
    t = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", ""), r"\s+")
    empty = F.array(F.lit(""))
    return F.sort_array(F.array_except(t, F.concat(stop, empty) if stop is not None else empty))
