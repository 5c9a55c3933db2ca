"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected to a few dimensions, shifted and put in Hilbert order, several times with
different projections and shifts. Every ordering is range-partitioned into CELLS equally full key ranges;
a query looks at the window of WINDOW neighbouring ranges around its own key. Windows of all orderings
are merged and reranked by exact cosines.

Many orderings with small windows find more than few with large ones: by default a query is compared ORDERINGS * WINDOW / CELLS = 0.98
times with a row, less than an exact search. Ranges hold LEAST_CELL rows at least, so small tables are searched in full.

Identical vectors are searched once: of each, the k + 1 smallest ids stand for all others, which can't
be among k nearest. Window sizes are shares of the table, so recall doesn't fall as it grows;
blocks of rows and of queries keep every task's memory bounded. In a block, all rows that rounding can't tell from a query's
k-th are ranked by their exact cosines, so ties go by id however many there are.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates; vectors are
searched among those of their own length; fewer candidates than k give fewer rows; ties go to the smaller
id; rows that repeat an id are separate rows, each a candidate for the others, and each with its own ranks as a query; a null
id takes no part; an empty table gives an empty result. Only id and vector are read, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import table, written

ORDERINGS = 21
DIMENSIONS = 10
BITS = 6
CELLS = 64
WINDOW = 3
LEAST_CELL = 64
K = 5
#: More than rounding can part two equal cosines by in a product of unit vectors.
CLOSE = 1e-10
#: Rows of a block, of candidates or of queries.
BLOCK = 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) with so many bits in each dimension (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, orderings: int, dimensions: int, bits: int, seed: int) -> np.ndarray:
    """rows x orderings Hilbert keys of vectors by random projections and shifts. Projections come in sets that are
    orthogonal to each other, as many as the vectors have room for."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    dim = vectors.shape[1]
    wide = min(dimensions, dim)
    out = np.empty((len(vectors), orderings), np.int64)
    turn = np.empty((dim, 0))
    for j in range(orderings):
        if turn.shape[1] < wide:
            turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        p, turn = turn[:, :wide], turn[:, wide:]
        at = unit @ p * np.sqrt(dim) / 3 + rng.uniform(0, 1, wide)  # most of [-1, 2]
        out[:, j] = hilbert(np.clip((at + 1) / 3 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)
    return out


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, rounded once to double precision: equal for vectors of one direction."""
    a, b = (np.asarray(x, np.longdouble) for x in (a, b))
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(float)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def rerank(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, query_id, uid, vec_id and score of the k nearest rows of x to each of q, but itself: by the product of unit
    vectors first, then, for all that rounding can't tell from the k-th, exactly."""
    out = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("query", "query_id", "uid", "vec_id")} | {"score": np.empty(0)})]
    if len(q) and len(x):
        quid, xuid, qid, xid = q["uid"].to_numpy(), x["uid"].to_numpy(), q["id"].to_numpy(), x["id"].to_numpy()
        qv, xv = stacked(q["v"]), stacked(x["v"])
        unit = lambda v: (lambda w: w / np.linalg.norm(w, axis=1, keepdims=True))(v / np.abs(v).max(axis=1, keepdims=True))
        ahead, behind = unit(qv), unit(xv).T
        kth = max(0, len(xuid) - k - 1)  # one more than k, as the query itself may be among them
        for s in range(0, len(quid), 256):
            near = ahead[s : s + 256] @ behind
            least = np.partition(near, kth, axis=1)[:, kth]
            a, b = np.nonzero(near >= least[:, None] - CLOSE)
            other = quid[s + a] != xuid[b]
            a, b = s + a[other], b[other]
            got = pd.DataFrame({"query": quid[a], "query_id": qid[a], "uid": xuid[b], "vec_id": xid[b], "score": cosines(qv[a], xv[b])})
            got = got.sort_values(["query", "score", "vec_id", "uid"], ascending=[True, False, True, True])
            out.append(got.groupby("query").head(k))
    return pd.concat(out, ignore_index=True)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, bits: int = BITS, cells: int = CELLS, window: int = WINDOW, least_cell: int = LEAST_CELL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """query_id, rank, id and score of the k nearest found for the rows where queries holds."""
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        for _, same in v.groupby(v.map(len)):
            out[same.index] = pd.Series(list(curve_keys(stacked(same), orderings, dimensions, bits, seed)), index=same.index)
        return out

    rows = written(rows.withColumn("dim", F.size("v")).withColumn("keys", keys("v")))
    same = Window.partitionBy("v").orderBy("id", "uid")
    apart = written(rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth"))
    # of each length: how many rows and queries, and how many cells, blocks of rows and blocks of queries a cell has
    asked = rows.groupBy("dim").agg(F.count(F.when(F.col("is_query"), 1)).alias("asked"))
    plan = apart.groupBy("dim").agg(F.count("*").alias("total")).join(asked, "dim")
    plan = plan.withColumn("cells", F.greatest(F.lit(1), F.least(F.lit(cells), F.floor(F.col("total") / least_cell))).cast("int"))
    up = lambda x: F.greatest(F.lit(1), F.ceil(x)).cast("int")
    plan = plan.withColumn("window", F.least(F.lit(window), F.col("cells")))
    plan = written(plan.select(F.col("dim").alias("of"), "cells", "window", up(F.col("total") / F.col("cells") / block).alias("c_parts"), up(F.col("asked") * F.col("window") / F.col("cells") / block).alias("d_parts")))
    # cut points: orderings * (cells - 1) numbers for each length of which there are rows for more than one cell
    several = apart.join(plan.filter("cells > 1"), F.col("dim") == F.col("of")).select("dim", "cells", F.posexplode("keys").alias("j", "key"))
    cuts = {(r.dim, r.j): np.array(r.at)[[i * cells // r.cells - 1 for i in range(1, r.cells)]] for r in several.groupBy("dim", "cells", "j").agg(F.percentile_approx("key", [i / cells for i in range(1, cells)], 10_000).alias("at")).collect()}
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("array<int>")
    def cell(dim: pd.Series, keys: pd.Series) -> pd.Series:
        none = np.empty(0, np.int64)
        out = pd.Series([None] * len(dim), index=dim.index, dtype=object)
        for d, some in keys.groupby(dim):
            k = np.stack(some.to_numpy())
            at = [np.searchsorted(shared.value.get((d, j), none), k[:, j]) for j in range(orderings)]
            out[some.index] = pd.Series(list(np.stack(at, axis=1).astype(np.int32)), index=some.index)
        return out

    part = lambda parts: F.pmod(F.xxhash64("uid"), parts).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at = F.posexplode(cell("dim", "keys")).alias("ordering", "at")
    cand = apart.join(plan, F.col("dim") == F.col("of")).select("uid", "id", "v", "dim", part(F.col("c_parts")).alias("c"), "d_parts", at)
    cand = cand.select("uid", "id", "v", "dim", "ordering", F.col("at").alias("cell"), "c", F.explode(upto(F.col("d_parts"))).alias("d"))
    asks = rows.filter("is_query").join(plan, F.col("dim") == F.col("of")).select("uid", "id", "v", "dim", part(F.col("d_parts")).alias("d"), "c_parts", "cells", "window", at)
    first = F.greatest(F.lit(0), F.least(F.col("at") - F.floor(F.col("window") / 2).cast("int"), F.col("cells") - F.col("window")))
    asks = asks.select("uid", "id", "v", "dim", "ordering", F.explode(F.sequence(first, first + F.col("window") - 1)).alias("cell"), "c_parts", "d")
    asks = asks.select("uid", "id", "v", "dim", "ordering", "cell", F.explode(upto(F.col("c_parts"))).alias("c"), "d")
    on = ["dim", "ordering", "cell", "c", "d"]
    found = asks.groupBy(*on).cogroup(cand.groupBy(*on)).applyInPandas(lambda q, x: rerank(q, x, k), "query long, query_id long, uid long, vec_id long, score double")
    found = found.groupBy("query", "query_id", "uid", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
