"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each document is encoded, ends with id 0 and is cut into full sequences and a rest. Rests are packed
in units of a bounded number of documents, inside the task that reads them, so nothing is
shuffled: in descending order of length each goes to the sequence of lowest estimated cost
(linear plus quadratic in the pieces' lengths) that has room; a rest that fits nowhere whole is
cut over the room that is left. A unit opens no more sequences than its tokens need, so at most one
sequence's worth of padding is left per unit.

Ids are those of the byte-level BPE vocabulary byte_bpe_50k; the encoder reads the same vocabulary as
ranks and its added token, which tests hold against the tokenizers library as it is by default: the
string of the added token in a text is that one token.

Cases: null and empty texts are the single id 0; rows that repeat an id are packed as separate
documents; a null id is kept; an empty table gives an empty result; very long texts are encoded in
whole, stretch by stretch. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import settled, slices, table

CAPACITY = 1024
#: Pieces that a worker sends back at once: 4 KB of ids each at most, with CAPACITY.
PIECES = 512
#: Added tokens of the vocabulary, which the ranks don't hold.
ADDED = {"<|endoftext|>": 50256}
#: Documents whose rests are packed together.
UNIT = 2048
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return partial(encoding.encode, allowed_special="all")


def pack_unit(rests: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """rests: (document, length), lengths below capacity. Returns (document, cut, length, sequence, offset),
    where cut counts the rest's tokens before the piece."""
    total = sum(n for _, n in rests)
    if not total:
        return []
    k = -(-total // capacity)
    room, cost = np.full(k, capacity, np.int64), np.zeros(k)
    out = []

    def put(doc: int, cut: int, n: int, at: int) -> None:
        out.append((doc, cut, n, at, int(capacity - room[at])))
        room[at] -= n
        cost[at] += LINEAR * n + QUADRATIC * n * n

    for doc, n in sorted(rests, key=lambda r: (-r[1], r[0])):
        cut = 0
        while n:
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(room.argmax())
            take = min(n, int(room[at]))
            put(doc, cut, take, at)
            cut, n = cut + take, n - take
    return out


def pieces(batches: Iterator[pa.RecordBatch], encode: Callable[[str], list[int]], base: int, capacity: int = CAPACITY, unit: int = UNIT) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents (id, text) of a task, PIECES at a time. base: its first sequence_id."""
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    made, pending = 0, []

    def flush(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        nonlocal made, pending
        placed = pack_unit([(i, len(ids) % capacity) for i, (_, ids) in enumerate(pending)], capacity)
        rows = [(i, len(pending[i][1]) // capacity * capacity + cut, n, made + at, offset) for i, cut, n, at, offset in placed]
        made += max((r[3] for r in placed), default=-1) + 1
        for i, (_, ids) in enumerate(pending):
            for s in range(0, len(ids) // capacity * capacity, capacity):
                rows.append((i, s, capacity, made, 0))
                made += 1
        for at in range(0, len(rows), PIECES):
            some = rows[at : at + PIECES]
            blobs = [pending[i][1][s : s + n].tobytes() for i, s, n, _, _ in some]
            cols = [[s for _, s, *_ in some], [r[2] for r in some], [zlib.crc32(b) for b in blobs], [len(pending[r[0]][1]) for r in some], [base + r[3] for r in some], [r[4] for r in some]]
            ids = pa.array([pending[r[0]][0] for r in some], type=schema.field("id").type)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols), pa.array(blobs, pa.binary())], names=["id", *names, "ids"])
        pending = []

    held = 0
    for batch in (some for b in batches for some in slices(b)):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.array([*encode(text), 0], dtype="<u4")
            pending.append((key, ids))
            held += len(ids)
            if len(pending) >= unit or held >= 4_000_000:
                yield from flush(batch.schema)
                held = 0
        schema = batch.schema
    if pending:
        yield from flush(schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, unit: int = UNIT, vocab: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids
    themselves (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(batches, encoder(vocab or vocabulary()), TaskContext.get().partitionId() << 40, capacity, unit)

    return rows.mapInArrow(settled(run), SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
