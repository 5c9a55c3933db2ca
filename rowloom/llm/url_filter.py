"""URL filter: longest matching host/path rule, else logistic regression on hashed n-grams.

Cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by
the model (bias only); repeated urls get equal verdicts; an empty table gives an empty result; with
no labelled url of one of the classes the model allows everything it is asked. Other columns are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import ascii_lower, table

#: (verdict, host, start of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The labelled table holds at most so many distinct urls of each verdict.
MAX_LABELLED = 4000
BUCKETS = 1 << 14


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first `://` to `/`, `?`, `#` or the end, lower-cased; path up to `?` or `#`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_ids(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed character n-grams (2 to 4) of host and path, each with its own prefix; none of an empty one."""
    out = []
    for tag, s in (("h", host), ("p", path)):
        s = f"^{s}$" if s else ""
        out += [zlib.crc32(f"{tag}{s[i : i + n]}".encode("utf-8", "surrogatepass")) % buckets for n in (2, 3, 4) for i in range(len(s) - n + 1)]
    return np.unique(np.array(out, np.int64))


def fit(urls: pd.DataFrame, buckets: int = BUCKETS, epochs: int = 30, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of P(block) by AdaGrad over the labelled table (host, path, verdict)."""
    y = (urls["verdict"].to_numpy() == "block").astype(float)
    w, bias = np.zeros(buckets), 0.0
    if not len(y) or y.min() == y.max():
        return w, -1.0
    feats = [ngram_ids(h, p, buckets) for h, p in zip(urls["host"], urls["path"])]
    seen, seen_b = np.full(buckets, 1e-2), 1e-2
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = feats[i]
            scale = 1 / np.sqrt(max(1, len(f)))
            g = 1 / (1 + np.exp(-np.clip(w[f].sum() * scale + bias, -30, 30))) - y[i]
            gf = g * scale + ridge * w[f]
            seen[f] += gf * gf
            w[f] -= rate * gf / np.sqrt(seen[f])
            seen_b += g * g
            bias -= rate * g / np.sqrt(seen_b)
    return w, bias


def score_urls(df: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """df (with host, path) plus block_score, P(block) by the model."""
    shared = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # buckets * 4 bytes

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = shared.value
        for hosts, paths in parts:
            z = [w[f := ngram_ids(h, p, len(w))].sum() / np.sqrt(max(1, len(f))) + b for h, p in zip(hosts, paths)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return df.withColumn("block_score", score("host", "path"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Judge every url. The labelled table is drawn from the urls that rules decide: at most
    max_labelled distinct ones of each verdict, in the order of a hash. Returns id, host, path, rule, verdict, block_score."""
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    labelled = parts.filter("found is not null").select("host", "path", F.col("found.verdict").alias("verdict")).distinct()
    drawn = [
        labelled.filter(F.col("verdict") == v).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled).toPandas() for v in ("allow", "block")
    ]
    weights, bias = fit(pd.concat(drawn, ignore_index=True))
    scored = score_urls(parts, weights, bias)
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "block_score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
