"""Hierarchical Pitman-Yor language model over words.

Three levels of restaurants: the context of the previous word, below it the class of that word (its last bytes, or the start of
the text), which all contexts of the class share as their parent, and the root, which all classes share; the root's base is
uniform over the known words and one unknown. A dish is a word, a customer one of its occurrences; a new table sends a customer
to the parent. Contexts are slots that previous words are hashed to, one for TOKENS_PER_CONTEXT tokens of the corpus, so their
number grows with it, up to MOST_CONTEXTS.

Seating is sampled by blocked Gibbs: the customers of a dish leave a restaurant together; their tables are taken from its
total, and their tables' customers from the parent, before they take seats again one by one (beyond EXACT customers, a
GROUPSth of those seated at once, of equal chances). Dishes do so at the same time, given the totals of the sweep before. Discounts
follow from the dishes of one and of two customers, strengths are sampled by auxiliary variables. Predictive probabilities are averaged
over the sweeps after burn-in.

How it runs: each scan task turns its documents into blocks of tokens sorted by word, context and document, cut into parts by
a hash of the word; a block has a part's tokens in one row, and a row its own documents only. The texts are read three times: for the parts' sizes,
for counts, and for scores, so tokens are shuffled but never stored. Of a part, training gathers the dishes'
counts: its state is as large as its distinct dishes, whatever the number of tokens. For scoring, a part's rows pass by its
state one by one. Parts with hot words have more rows than others: they are dealt over several tasks, counted in two steps and scored beside copies of
the state. What parts share are the restaurants' totals, a few numbers for each context, which sweeps send through the driver. Words are
known by 64-bit hashes.

Cases: null and empty texts are one end token; a null id counts as the empty text for the held-out rule;
rows that repeat an id are scored separately; with no training rows every word is unknown and base scores
use N = V = 0; an empty table gives an empty result; long texts are read whole. Only id and text are read, under
names of their own, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import _LOWER, _SPACE, id_text, mix, remove, scratch, settled, table, word_hashes, written

_U = np.uint64
#: Classes of the previous word: 0 is the start of a text. A class is known by the word's last SUFFIX bytes.
CLASSES = 256
SUFFIX = 3
#: Tokens of the corpus for each context, and a bound on the contexts: what sweeps send to and from the driver.
TOKENS_PER_CONTEXT, MOST_CONTEXTS = 128, 1 << 20
#: Bytes of text for one token, about.
TOKEN_BYTES = 6
SWEEPS, BURN_IN = 5, 2
#: Customers of a dish that are seated one by one; beyond, in groups of a GROUPSth of the seated.
EXACT, GROUPS = 256, 64
#: Bytes of text in a block, and of all text in a part.
BLOCK_BYTES, PART_BYTES = 8 << 20, 20 << 20
#: Contexts whose totals are added up in one task.
CHUNK = 1 << 13
SEED = 11
END = _U(0xE4D0E4D0E4D0E4D1)


def slots_for(size: int) -> int:
    """Contexts of a class, a power of two, for a corpus of so many bytes."""
    asked = size // TOKEN_BYTES // TOKENS_PER_CONTEXT // CLASSES
    return min(MOST_CONTEXTS // CLASSES, 1 << max(0, int(asked).bit_length()))


def tokens(data: bytes, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with the end token, context of each: class of the previous word * slots + its slot)."""
    starts, h = word_hashes(data)
    ctx = np.zeros(len(h) + 1, np.int64)
    if len(h):
        b = _LOWER[np.frombuffer(data, np.uint8)]
        space = _SPACE[np.frombuffer(data, np.uint8)]
        ends = np.flatnonzero(np.diff(space.astype(np.int8), append=np.int8(1)) == 1)
        code = np.zeros(len(h), np.uint64)
        for i in range(SUFFIX):
            at = ends - i
            code = code * _U(257) + np.where(at >= starts, b[np.maximum(at, 0)].astype(np.uint64) + _U(1), _U(0))
        ctx[1:] = ((mix(code) % _U(CLASSES - 1)).astype(np.int64) + 1) * slots + (mix(h ^ END) % _U(slots)).astype(np.int64)
    return np.append(h, END), ctx


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _spread(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**24, byte by byte: all lowest bytes first, which squeezes better."""
    return _squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T))


def _from_planes(x: bytes) -> np.ndarray:
    b = _spread(x, np.uint8).reshape(3, -1).astype(np.int64)
    return b[0] | b[1] << 8 | b[2] << 16


#: A part's tokens of one block: its words, and of each word the pairs with a context, and of each pair the tokens.
COUNTED = ["words", "per_word", "ctx", "per_pair"]
#: A block has fewer documents than 2**DOC_BITS, of BLOCK_BYTES / 64 at least one byte each.
DOC_BITS, CTX_BITS = 18, 20


class Block:
    """Documents as they come, up to BLOCK_BYTES, and then their tokens by part, word, context and document."""

    def __init__(self, parts: int, slots: int):
        self.parts, self.slots = parts, slots
        self.clear()

    def clear(self) -> None:
        self.words, self.ctxs, self.lens, self.size = [], [], [], 0

    def add(self, data: bytes) -> bool:
        """Whether the block is full now."""
        w, c = tokens(data, self.slots)
        self.words.append(w), self.ctxs.append(c), self.lens.append(len(w))
        self.size += len(data) + 64
        return self.size >= BLOCK_BYTES

    def dealt(self) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
        """(part, number of tokens, the columns COUNTED, documents of the tokens) of each part."""
        w = np.concatenate(self.words)
        own, word = np.unique(w, return_inverse=True)
        # words by part, then by hash; one number for each token, in whose order they come
        by_part = np.argsort(part_of(own, self.parts), kind="stable")
        rank = np.empty(len(own), np.uint64)
        rank[by_part] = np.arange(len(own), dtype=np.uint64)
        doc = np.repeat(np.arange(len(self.lens), dtype=np.uint64), self.lens)
        code = np.sort(rank[word] << _U(DOC_BITS + CTX_BITS) | np.concatenate(self.ctxs).astype(np.uint64) << _U(DOC_BITS) | doc)
        own = own[by_part]
        pair = code >> _U(DOC_BITS)
        at = (pair >> _U(CTX_BITS)).astype(np.int64)
        part = part_of(own, self.parts)[at]
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            first_pair = np.flatnonzero(np.diff(pair[lo:hi], prepend=~pair[lo]))
            pairs = at[lo:hi][first_pair]
            first_word = np.flatnonzero(np.diff(pairs, prepend=-1))
            blobs = [
                _squeeze(own[pairs[first_word]]), _squeeze(np.diff(np.append(first_word, len(pairs))).astype("<u4")),
                _planes((pair[lo:hi][first_pair] & _U((1 << CTX_BITS) - 1)).astype(np.int64)), _squeeze(np.diff(np.append(first_pair, hi - lo)).astype("<u4")),
            ]
            yield int(part[lo]), int(hi - lo), blobs, (code[lo:hi] & _U((1 << DOC_BITS) - 1)).astype(np.int64)


def part_sizes(rows: DataFrame, parts: int) -> DataFrame:
    """(part, n): the tokens of each part, of (id, off, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = np.zeros(parts, np.int64), [np.empty(0, np.uint64)], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(np.append(word_hashes(text.as_py() or b"")[1], END))
                size += len(held[-1])
                if size >= max(parts, BLOCK_BYTES // 8):
                    n += np.bincount(part_of(np.concatenate(held), parts), minlength=parts)
                    held, size = [], 0
        if held:
            n += np.bincount(part_of(np.concatenate(held), parts), minlength=parts)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["part", "n"])

    return rows.select("text").mapInArrow(settled(run), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))


def counted_blocks(rows: DataFrame, parts: int, slots: int) -> DataFrame:
    """part, block and the columns COUNTED of the documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(parts, slots), TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for part, _, blobs, _ in block.dealt():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=["part", "block", *COUNTED])
            block.clear()
            number += 1

        for batch in batches:
            for text in batch.column(0):
                if block.add(text.as_py() or b""):
                    yield from flush()
        if block.lens:
            yield from flush()

    return rows.filter("not off").select("text").mapInArrow(settled(run), f"part int, block long, {', '.join(f'{c} binary' for c in COUNTED)}")


TOKENS = [*COUNTED, "docs"]


def token_blocks(rows: DataFrame, parts: int, slots: int) -> DataFrame:
    """part, block and the columns TOKENS of all documents; and, as part -1, the ids (as text), held-out flags and token numbers of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(parts, slots), TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bool] = []

        def out(part: int, blobs: list[bytes | None], ids_: list, held_: list, lens_: list) -> pa.RecordBatch:
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([ids_], pa.list_(pa.string())), pa.array([held_], pa.list_(pa.bool_())), pa.array([lens_], pa.list_(pa.int64()))], names=["part", "block", *TOKENS, "ids", "held", "lens"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            yield out(-1, [None] * len(TOKENS), list(ids), list(held), list(block.lens))
            for part, _, blobs, docs in block.dealt():
                yield out(part, [*blobs, _planes(docs)], [], [], [])
            block.clear(), ids.clear(), held.clear()
            number += 1

        for batch in batches:
            for key, off, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(key), held.append(bool(off))
                if block.add(text.as_py() or b""):
                    yield from flush()
        if ids:
            yield from flush()

    return rows.mapInArrow(settled(run), f"part int, block long, {', '.join(f'{c} binary' for c in TOKENS)}, ids array<string>, held array<boolean>, lens array<long>")


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> _U(40)) % _U(parts)).astype(np.int64)


def gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with the columns COUNTED, added up: the sorted words, and of the dishes, in order, the word's place in them, context and count."""
    of, ctx, n = [], [], []
    for r in rows.itertuples():
        of.append(np.repeat(_spread(r.words, np.uint64), _spread(r.per_word, "<u4"))), ctx.append(_from_planes(r.ctx)), n.append(_spread(r.per_pair, "<u4"))
    words, place = np.unique(np.concatenate(of), return_inverse=True)
    pair, at = np.unique(place << 32 | np.concatenate(ctx), return_inverse=True)
    return words, pair >> 32, pair & 0xFFFFFFFF, np.bincount(at, weights=np.concatenate(n), minlength=len(pair)).astype(np.int64)


class Dishes:
    """A part's training counts: dishes of contexts (word, ctx, count) in order, words numbered from 0; of classes (mid_word, mid_class), and which of them each dish of a context is sent to."""

    def __init__(self, word: np.ndarray, ctx: np.ndarray, count: np.ndarray, words: int, slots: int):
        self.word, self.ctx, self.count, self.words, self.slots = word, ctx, count, words, slots
        self.cls = ctx // slots
        self.mid, self.mid_of = np.unique(word * CLASSES + self.cls, return_inverse=True)
        self.mid_word, self.mid_class = self.mid // CLASSES, self.mid % CLASSES

    def to_mid(self, leaf: np.ndarray) -> np.ndarray:
        return np.bincount(self.mid_of, weights=leaf, minlength=len(self.mid)).astype(np.int64)

    def to_root(self, mid: np.ndarray) -> np.ndarray:
        return np.bincount(self.mid_word, weights=mid, minlength=self.words).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.ctx, weights=x, minlength=CLASSES * self.slots).astype("<i8")

    def by_class(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.mid_class, weights=x, minlength=CLASSES).astype(np.int64)


class Totals:
    """What parts share. Of level 0 (root), 1 (classes), 2 (contexts): customers and tables of each restaurant, discount and strength."""

    def __init__(self, n: int, known: int, customers: list, tables: list, discount: list, strength: list):
        self.n, self.known, self.customers, self.tables, self.discount, self.strength = n, known, customers, tables, discount, strength


def seat(count: np.ndarray, above: np.ndarray, whole: np.ndarray, rises: bool, total: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes after count customers each took seats one by one: the k-th opens a table with weight (strength + discount * all tables) * chance
    against customers - discount * own tables. The chance is the dish's probability in the parent, above / whole; where it rises, each
    own table adds a customer to both. total: the other dishes' tables."""
    tables = (count > 0).astype(np.int64)
    at = np.flatnonzero(count > 1)
    seated = 1
    while len(at):
        group = 1 if seated < EXACT else seated // GROUPS
        more = np.minimum(count[at] - seated, group)
        own = tables[at]
        new = (strength + discount * (total[at] + own)) * (above[at] + rises * own) / (whole[at] + rises * own)
        p = new / (new + np.maximum(seated - discount * own, 1e-9))
        tables[at] += rng.random(len(at)) < p if group == 1 else rng.binomial(more, np.clip(p, 0, 1))
        seated += group
        at = at[count[at] > seated]
    return tables


def left_behind(customers: np.ndarray, tables: np.ndarray, left: np.ndarray, all_customers, all_tables, discount: float, strength: float, parent) -> tuple[np.ndarray, np.ndarray]:
    """Of a parent's dishes whose `left` customers have left: (above, whole), whose quotient is the dish's probability once own customers are added to both.
    The first of these opens a table where no other customer is left."""
    rest = customers - left
    kept = np.maximum(np.minimum(tables, rest), 1)
    return rest - discount * kept + (strength + discount * (all_tables - tables + kept)) * parent, strength + all_customers - left


def served(customers: np.ndarray, tables: np.ndarray, all_customers, all_tables, discount: float, strength: float, parent) -> np.ndarray:
    """Predictive probability of dishes in their restaurants."""
    return (np.maximum(customers - discount * tables, 0) + (strength + discount * all_tables) * parent) / (strength + all_customers)


def sweep(d: Dishes, leaf: np.ndarray, mid: np.ndarray, root: np.ndarray, total: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Gibbs sweep over a part: tables of the dishes of contexts and classes and of the words in the root."""
    (d0, d1, d2), (s0, s1, s2) = total.discount, total.strength
    (c0, c1, _), (t0, t1, t2) = total.customers, total.tables
    uniform = 1 / (total.known + 1)
    # customers of the classes' dishes and of the root's: the tables below them
    mids, roots = d.to_mid(leaf), d.to_root(mid)
    top = served(roots, root, c0, t0, d0, s0, uniform)[d.word]
    above = left_behind(mids[d.mid_of], mid[d.mid_of], leaf, c1[d.cls], t1[d.cls], d1, s1, top)
    leaf = seat(d.count, *above, True, t2[d.ctx] - leaf, d2, s2, rng)
    mids = d.to_mid(leaf)
    above = left_behind(roots[d.mid_word], root[d.mid_word], mid, c0, t0, d0, s0, uniform)
    mid = seat(mids, *above, True, t1[d.mid_class] - mid, d1, s1, rng)
    root = seat(d.to_root(mid), np.full(d.words, uniform), np.ones(d.words), False, t0 - root, d0, s0, rng)
    return leaf, mid, root


def sample(d: Dishes, leaf: np.ndarray, mid: np.ndarray, root: np.ndarray, total: Totals) -> tuple:
    """A seating as predictive() takes it, with the customers that follow from it."""
    return leaf, d.to_mid(leaf), mid, d.to_root(mid), root, total


def predictive(d: Dishes, samples: list[tuple], word: np.ndarray, known: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Probability of words (numbers in d, where known) in contexts, averaged over samples of tables and totals."""
    def places(of: np.ndarray, code: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(of):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(of, code), len(of) - 1)
        return at, there & (of[at] == code)

    cls = ctx // d.slots
    leaf_at, is_leaf = places(d.word << 32 | d.ctx, word << 32 | ctx, known)
    mid_at, is_mid = places(d.mid, word * CLASSES + cls, known)
    pick = lambda x, at, there: np.where(there, x[at] if len(x) else 0, 0)
    out = np.zeros(len(word))
    for leaf, mids, mid, roots, root, total in samples:
        (d0, d1, d2), (s0, s1, s2) = total.discount, total.strength
        (c0, c1, c2), (t0, t1, t2) = total.customers, total.tables
        top = served(pick(roots, word, known), pick(root, word, known), c0, t0, d0, s0, 1 / (total.known + 1))
        middle = served(pick(mids, mid_at, is_mid), pick(mid, mid_at, is_mid), c1[cls], t1[cls], d1, s1, top)
        out += served(pick(d.count, leaf_at, is_leaf), pick(leaf, leaf_at, is_leaf), c2[ctx], t2[ctx], d2, s2, middle)
    return out / len(samples)


STATE = "part int, n long, known long, words binary, word binary, ctx binary, count binary, leaf array<binary>, mid array<binary>, root array<binary>, customers array<binary>, tables array<binary>, mid_tables array<long>, root_tables long, twos array<long>"


def _chunks(x: np.ndarray) -> list[bytes]:
    return [_squeeze(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]


def hot_parts(sizes: DataFrame) -> DataFrame:
    """(of, copies) of the parts with more than twice the mean of tokens: over how many tasks their rows are dealt."""
    mean = sizes.agg(F.avg("n").alias("mean"))
    return written(sizes.join(mean, F.col("n") > 2 * F.col("mean")).select(F.col("part").alias("of"), F.ceil(F.col("n") / F.col("mean")).cast("int").alias("copies")))


def salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with their salt, null in parts that one task can take."""
    return rows.join(hot, F.col("part") == F.col("of"), "left").withColumn("salt", F.pmod(F.xxhash64("block"), "copies").cast("int"))


def count_dishes(data: DataFrame, hot: DataFrame, slots: int) -> DataFrame:
    """A row per part: its dishes and a first seating, one table for each dish of a restaurant."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        words, word, ctx, count = gathered(rows)
        per = np.bincount(word, minlength=len(words)).astype("<u4")
        return pd.DataFrame({"part": rows["part"].iloc[:1], "words": [_squeeze(words)], "per_word": [_squeeze(per)], "ctx": [_planes(ctx)], "per_pair": [_squeeze(count.astype("<u4"))]})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words, word, ctx, count = gathered(rows)
        d = Dishes(word, ctx, count, len(words), slots)
        leaf, mid, root = np.ones(len(word), "<u4"), np.ones(len(d.mid), "<u4"), np.ones(len(words), "<u4")
        mids, roots = d.to_mid(leaf), d.to_root(mid)
        return pd.DataFrame({
            "part": rows["part"].iloc[:1], "n": [count.sum()], "known": [len(words)], "words": [_squeeze(words)], "word": [_squeeze(np.diff(word, prepend=0).astype("<u4"))],
            "ctx": [_planes(ctx)], "count": [_squeeze(count.astype("<u4"))], "leaf": [[_squeeze(leaf)]], "mid": [[_squeeze(mid)]], "root": [[_squeeze(root)]],
            "customers": [_chunks(d.by_context(count))], "tables": [_chunks(d.by_context(leaf))], "mid_tables": [d.by_class(mid)], "root_tables": [root.sum()],
            "twos": [[int((x == k).sum()) for x in (roots, mids, count) for k in (1, 2)]],
        })

    schema = f"part int, {', '.join(f'{c} binary' for c in COUNTED)}"
    rows = salted(data, hot).withColumn("salt", F.coalesce("salt", F.lit(0))).select("part", "salt", *COUNTED)
    merged = written(rows.groupBy("part", "salt").applyInPandas(merge, schema))
    return merged.groupBy("part").applyInPandas(run, STATE)


def dishes(row: dict, slots: int) -> Dishes:
    word = np.cumsum(_spread(row["word"], "<u4").astype(np.int64))
    return Dishes(word, _from_planes(row["ctx"]), _spread(row["count"], "<u4").astype(np.int64), row["known"], slots)


def seatings(row: dict, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(_spread(row[level][i], "<u4").astype(np.int64) for level in ("leaf", "mid", "root"))


def next_sweep(state: DataFrame, total: Totals, number: int, slots: int) -> DataFrame:
    """state with one more seating."""
    shared = state.sparkSession.sparkContext.broadcast(total)  # 32 bytes a context, MOST_CONTEXTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                d = dishes(row, slots)
                leaf, mid, root = sweep(d, *seatings(row, -1), shared.value, np.random.default_rng([SEED, row["part"], number]))
                for level, x in (("leaf", leaf), ("mid", mid), ("root", root)):
                    row[level] = [*row[level], _squeeze(x.astype("<u4"))]
                row |= {"tables": _chunks(d.by_context(leaf)), "mid_tables": d.by_class(mid).tolist(), "root_tables": int(root.sum())}
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return state.mapInArrow(run, STATE)


def added(state: DataFrame, name: str, contexts: int) -> np.ndarray:
    """The sum over parts of a number for each context."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "total": [sum(_spread(x, "<i8") for x in rows["some"]).tobytes()]})

    chunks = state.select(F.posexplode(name).alias("chunk", "some")).groupBy("chunk").applyInPandas(run, "chunk int, total binary")
    out = np.zeros(contexts, np.int64)
    for r in chunks.collect():  # contexts / CHUNK rows
        x = np.frombuffer(r.total, "<i8")
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] = x
    return out


def resampled(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> float:
    """A strength drawn given the seating, by auxiliary variables: a Beta for each restaurant, and for its tables but the first whether
    the strength had opened them (their number, by its mean); the prior is Gamma(1, 1)."""
    busy = customers > 1
    c, t = customers[busy].astype(float), tables[busy].astype(float)
    if not len(c):
        return strength
    log_x = np.log(np.maximum(rng.beta(strength + 1, c - 1), 1e-300)).sum()
    ratio = strength / max(discount, 1e-6)
    opened = (ratio * np.log((ratio + np.maximum(t, 1) - 0.5) / (ratio + 0.5))).sum()
    return float(rng.gamma(1 + rng.poisson(max(opened, 0)), 1 / (1 - log_x)))


def totals(state: DataFrame, slots: int, before: Totals | None, number: int) -> Totals:
    """The totals of the last seating."""
    contexts = CLASSES * slots
    one = state.agg(F.sum("n"), F.sum("known"), F.sum("root_tables"), *[F.sum(F.get("twos", F.lit(i))) for i in range(6)]).first()
    one = [x or 0 for x in one]
    mid = np.zeros(CLASSES, np.int64)
    for pos, t in state.select(F.posexplode("mid_tables")).groupBy("pos").agg(F.sum("col")).collect():
        mid[pos] = t
    leaf = added(state, "tables", contexts)
    customers = before.customers[2] if before else added(state, "customers", contexts)
    discount = before.discount if before else [min(0.95, max(0.05, (a + 1) / (a + 1 + 2 * b))) for a, b in zip(one[3::2], one[4::2])]
    customers, tables = [int(mid.sum()), leaf.reshape(CLASSES, slots).sum(axis=1), customers], [one[2], mid, leaf]
    strength = before.strength if before else [10.0, 10.0, 10.0]
    rng = np.random.default_rng([SEED, number])
    strength = [resampled(s, d, np.atleast_1d(c), np.atleast_1d(t), rng) for s, d, c, t in zip(strength, discount, customers, tables)]
    return Totals(one[0], one[1], customers, tables, discount, strength)


def score(data: DataFrame, hot: DataFrame, parts: int, state: DataFrame, sweeps: list[Totals], slots: int, burn_in: int = BURN_IN) -> DataFrame:
    """A row per part and block: for those of the block's documents that have a word of the part, the known tokens, base and model scores
    summed over these; and the rows of part -1 as they are. sweeps: the totals after each seating in state, the first one included."""
    # those before burn-in aren't used, but where there are no others
    first = min(1 + burn_in, len(sweeps) - 1)
    shared = data.sparkSession.sparkContext.broadcast(sweeps[first:])  # 32 bytes a context and sweep, MOST_CONTEXTS at most
    columns = ["block", "docs", "known", "base", "score", "ids", "held", "lens"]

    def run(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):  # a copy of the state that no row was dealt to
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        if rows["part"].iloc[0] < 0:
            return rows.assign(docs=None, known=None, base=None, score=None)[columns]
        totals_ = shared.value
        last = totals_[-1]
        if len(states):
            row = states.iloc[0].to_dict()
            words, d = _spread(row["words"], np.uint64), dishes(row, slots)
            samples = [sample(d, *seatings(row, first + i), t) for i, t in enumerate(totals_)]
        else:  # nothing to learn from
            none = np.empty(0, np.int64)
            words, d = none.view(np.uint64), Dishes(none, none, none, 0, slots)
            samples = [(none, none, none, none, none, t) for t in totals_]
        count = np.bincount(d.word, weights=d.count, minlength=d.words)
        out = []
        for r in rows.itertuples():
            own = _spread(r.words, np.uint64)
            at = np.minimum(np.searchsorted(words, own), max(0, len(words) - 1))
            known = words[at] == own if len(words) else np.zeros(len(own), bool)
            at = np.where(known, at, 0)
            c = np.where(known, count[at], 0) if len(words) else np.zeros(len(own))
            base = np.log10((c + 0.1) / (last.n + 0.1 * (last.known + 1)))
            of = np.repeat(np.arange(len(own)), _spread(r.per_word, "<u4"))
            logp = np.log10(predictive(d, samples, at[of], known[of], _from_planes(r.ctx)))
            docs, doc = np.unique(_from_planes(r.docs), return_inverse=True)
            pair = np.repeat(np.arange(len(of)), _spread(r.per_pair, "<u4"))
            by_doc = lambda x: np.bincount(doc, weights=x[pair], minlength=len(docs))
            out.append((r.block, _planes(docs), _squeeze(by_doc(known[of].astype(float)).astype("<u4")), _squeeze(by_doc(base[of])), _squeeze(by_doc(logp)), [], [], []))
        return pd.DataFrame(out, columns=columns)

    alone = F.when(F.col("part") < 0, F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).otherwise(0)
    rows = salted(data, hot).withColumn("salt", F.coalesce("salt", alone)).select("part", "salt", "block", *TOKENS, "ids", "held", "lens")
    copies = state.join(hot, F.col("part") == F.col("of"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    copies = copies.select("part", "salt", "known", "words", "word", "ctx", "count", "leaf", "mid", "root")
    return rows.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInPandas(run, f"block long, docs binary, known binary, base binary, score binary, ids array<string>, held array<boolean>, lens array<long>")


def by_document(sums: DataFrame) -> DataFrame:
    """id (as text), held_out, n_tokens, n_known, base_score, score: the parts' sums of each block, added up."""
    columns = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows[rows["docs"].isnull()].iloc[0]
        known, base, model = np.zeros(len(row["lens"]), np.int64), np.zeros(len(row["lens"])), np.zeros(len(row["lens"]))
        for r in rows[rows["docs"].notnull()].sort_values("docs").itertuples():  # in the same order in every run
            at = _from_planes(r.docs)
            known[at] += _spread(r.known, "<u4")
            base[at] += _spread(r.base, np.float64)
            model[at] += _spread(r.score, np.float64)
        return pd.DataFrame(dict(zip(columns, [row["ids"], row["held"], row["lens"], known, base, model])))

    return sums.groupBy("block").applyInPandas(run, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, part_bytes: int = PART_BYTES, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    off = F.crc32(id_text(id_col).cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).cast("string").alias("id"), off.alias("off"), F.col(text_col).cast("binary").alias("text"))
    size = int(docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0)
    parts, slots = max(1, -(-size // part_bytes)), slots_for(size)
    hot = hot_parts(part_sizes(rows, parts))
    # a seating's table goes when the next one is there
    path = scratch(docs.sparkSession)
    state = written(count_dishes(counted_blocks(rows, parts, slots), hot, slots), path)
    seen = [totals(state, slots, None, 0)]
    for i in range(sweeps):
        before, path = path, scratch(docs.sparkSession)
        state = written(next_sweep(state, seen[-1], i, slots), path)
        remove(docs.sparkSession, before)
        seen.append(totals(state, slots, seen[-1], i + 1))
    out = by_document(score(token_blocks(rows, parts, slots), hot, parts, state, seen, slots, burn_in))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(seen[0].n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
