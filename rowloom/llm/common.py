"""Helpers shared by the corpus operators: scratch tables, paths, byte-level word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and the codes 9 to 13.
WS_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{WS_CLASS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}  # by application: this session's folder


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local
    session takes a temporary folder, and a cluster is an error. What is there goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rowloom-")
        _OWN[app] = f"{base.rstrip('/')}/rowloom-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _OWN[app])
    return f"{_OWN[app]}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _clean(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError, TypeError):  # the session may have ended before
        remove(spark, path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def sending(spark: SparkSession, batch: str | None) -> Iterator[None]:
    """For what runs inside: batch, bytes of a batch that is sent to Python workers, where the session's own setting is too large for
    wide rows. It is as before afterwards."""
    before = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, batch)
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors. batch: as in sending()."""
    path = path or scratch(df.sparkSession)
    with sending(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What is sent to a Python worker at once: texts of 10,000 rows would take tens of MB in the executor, twice while they grow, and
#: again in the worker, beside the heap.
BATCH = "2m"


#: Rows of a batch that are worked on at once where rows hold texts.
ROWS = 512


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A batch, which may be large, in parts of so many rows, without a copy."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def settled(run: Callable) -> Callable:
    """run, a function over batches in a Python worker, after which the worker gives its free memory back: workers stay
    for the next stages, beside the executor's heap."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Files of a table up to which their list is broadcast.
MOST_FILES = 100_000


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as a scan of files, and the stored list (file, nth) of these, for numbered(). What is no scan is written first."""
    try:
        files = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("file"))
        files.schema  # noqa: B018  resolves the plan
    except AnalysisException:
        docs = written(docs)
        files = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("file"))
    return docs, written(files.distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("nth")))


def numbered(docs: DataFrame, files: DataFrame, *columns: Column | str) -> DataFrame:
    """columns of docs and uid, a row's place: its file's number in files and its row in the file, the same in every
    scan however files are split."""
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(F.struct(*columns).alias("own"), meta["file_path"].alias("of_file"), meta["row_index"].alias("at"))
    if files.count() <= MOST_FILES:
        files = F.broadcast(files)
    rows = rows.join(files, F.col("of_file") == F.col("file"))
    return rows.select("own.*", (F.shiftleft("nth", 40) + F.col("at")).alias("uid"))


#: log2 of the slots of a filter on numbers: 2**17 rows of 64 slots, whatever the table holds.
SLOT_BITS = 23


def slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << SLOT_BITS))


def probed(rows: DataFrame, at: Column, slots: DataFrame) -> DataFrame:
    """rows with `maybe`: whether the slot `at` is among slots (one column, `slot`). What is broadcast are
    2**(SLOT_BITS - 6) rows at most."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    rows = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("__word"), "left")
    return rows.withColumn("maybe", F.coalesce(F.getbit("__bits", (at % 64).cast("int")), F.lit(0)) == 1).drop("__word", "__bits")


def maybe_in(rows: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """rows with `maybe`: false where col is surely none of ids. Beyond some millions of ids it is true everywhere."""
    return probed(rows, slot(col), ids.select(slot(id_col).alias("slot")))


def those_in(rows: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose col is one of ids: the filter first, so that few others are shuffled."""
    near = maybe_in(rows, col, ids, id_col).filter("maybe").drop("maybe")
    return near.join(ids.select(F.col(id_col).alias(col)).distinct(), col, "left_semi")


def those_not_in(rows: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose col is none of ids; only those that may be are shuffled."""
    rows = maybe_in(rows, col, ids, id_col)
    doubtful = rows.filter("maybe").join(ids.select(F.col(id_col).alias(col)), col, "left_anti")
    return rows.filter("not maybe").unionByName(doubtful).drop("maybe")


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def record(names: list[str]) -> Column:
    """All columns of a row in one struct, `row`, so that names made up beside it can't clash."""
    return F.struct(*[F.col(quoted(c)) for c in names]).alias("row")


def unpacked(names: list[str]) -> list[Column]:
    """The columns of record(names) again."""
    return [F.col(f"row.{quoted(c)}").alias(c) for c in names]


def id_text(col: str) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(col, UPPER, UPPER.lower())


def word_count(col: Column) -> Column:
    """Number of words in col, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


_U = np.uint64
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_VALUE = _VALUE[_LOWER]  # a letter and its lower case share a value
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _R), ("down", _RINV)):
            p = np.full(size, _U(base))
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each white-space separated word of data, A-Z lower-cased.

    All bytes are hashed at once: prefix sums of value * R**position, whose differences over a
    word are scaled back to position 0."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))
