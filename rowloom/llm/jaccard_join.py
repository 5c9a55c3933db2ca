"""N-gram Jaccard join by parity sketches, and its linked components.

A document is the set of its distinct shingles, as 64-bit hashes. A parity sketch XORs every shingle into a bit
array, so two sketches differ in at most as many bits as the sets have shingles apart. Sketches are cut
into segments; sets of a size band whose symmetric difference is at most D agree on one of D + 1 segments
at least (pigeonhole), so sets that share (band, segment, its content) hold every linked pair. A segment
is kept as a fingerprint, the XOR of the hashes of its odd bits. SPARE more segments than D + 1 are used, so
that segments without a shingle need not be joined on. A second, wider sketch per set rejects candidates
by its Hamming distance; the sets of the others are compared exactly.

No join emits the pairs of a group. Documents with one set are one node. Segments with the same members are one group.
In a group, a task first finds by sketch the members that may have a partner in another component; only these are
sent on with their shingles, and compared exactly: a search in breadth over the links, from component to component, which
emits the edges of a forest at most. A large group is dealt in blocks: the members of its largest component meet those
outside of it, and the latter each other. Two passes: first, of each set, the largest group that it is in, which connects most; then all
groups that still hold several components. Each group is searched to its end in its pass, so the components are those of all links.

Components come from alternating stars: their rounds grow with the logarithm of the longest path.

Cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows that repeat an id or text are separate rows with one component; a null id takes the least id
linked with it; an empty table gives an empty result. Rows are known by their file and place in it; what is no scan of files
is written first. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import BATCH, mix, numbered, placed, record, settled, slices, table, those_in, those_not_in, unpacked, word_hashes, written

_U = np.uint64
#: Bits of a set's sketch: at least, and at most.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 16
#: Size bands: [LIMITS[i], LIMITS[i + 1]); below the first, linked sets are equal.
RATIO = 1.5
#: Members of a part of a group, and shingles of its sets; a block is two parts.
MEMBERS, ENTRIES = 1_000, 1 << 18
#: Bytes of a batch that are worked on at once, where groups are smaller.
HELD = 8 << 20


class Plan:
    """Bands and segments for links: whole * intersection >= part * union."""

    def __init__(self, part: int = 90, whole: int = 100, width: int = 3):
        self.part, self.whole, self.width = part, whole, width
        self.limits = [1]
        while self.most_apart(2 * (self.limits[0])) < 1:
            self.limits[0] += 1
        while self.limits[-1] < 1 << 40:
            self.limits.append(int(self.limits[-1] * RATIO) + 1)

    def most_apart(self, sizes: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to sizes."""
        return sizes * (self.whole - self.part) // (self.whole + self.part)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.limits, n, side="right")) - 1

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, those of them beyond the pigeonhole's need)."""
        apart = self.most_apart(2 * (self.limits[band + 1] - 1))
        # segments that the band's smallest sets leave empty, with some room
        spare = 3 + int(1.5 * apart * math.exp(-self.limits[band] / (apart + 1)))
        return apart + 1 + spare, spare

    def bits(self, n: int) -> int:
        """Bits of the sketch of a set of n shingles, the same power of two for all of a band: some eight times the largest distance."""
        at = self.bands(n)
        asked = 8 * self.most_apart(2 * (self.limits[at[-1] + 1] - 1)) if at else 0
        return min(MOST_BITS, max(LEAST_BITS, 1 << (asked - 1).bit_length() if asked else 0))

    def bands(self, n: int) -> list[int]:
        """A set joins in its own band and in those above where a larger partner can be."""
        own = self.band(n)
        if n * self.whole // self.part < self.limits[0]:
            return []
        up = self.band(n * self.whole // self.part)
        return list(range(max(own, 0), up + 1))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    _, h = word_hashes(data)
    if not len(h):
        return h
    w = min(width, len(h))
    s = np.full(len(h) - w + 1, _U(w))
    for i in range(w):
        s = mix(s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - w + 1 + i])
    return np.unique(s)


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch, as signed 64-bit words."""
    odd = np.bincount((shingles % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch of width words from a wider one, both powers of two."""
    return np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def segment_keys(shingles: np.ndarray, plan: Plan) -> np.ndarray:
    """Join keys: a fingerprint of every segment of the set's sketch in its bands."""
    out = []
    for band in plan.bands(len(shingles)):
        n, spare = plan.segments(band)
        # only as many of the band's segments as the set's own largest distance to a partner asks for
        ask = min(n, plan.most_apart(len(shingles) + len(shingles) * plan.whole // plan.part) + 1 + spare)
        at = ((shingles >> _U(17)) % _U(n)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at = at[order]
        order, at = order[at < ask], at[at < ask]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        prints, used = np.bitwise_xor.reduceat(shingles[order], first) if len(at) else np.empty(0, _U), at[first]
        if ask - len(used) > spare:
            empty = np.setdiff1d(np.arange(ask), used)
            prints, used = np.append(prints, np.zeros(len(empty), _U)), np.append(used, empty)
        out.append(mix(prints ^ mix(used.astype(_U) * _U(1_000_003) + _U(band + 1))))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def describe(rows: DataFrame, plan: Plan) -> DataFrame:
    """uid, id, n, lo and hi (digest of the set), sketch, keys of each row (uid, id, text as bytes)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                n, lo, hi, sketches, keys = [], [], [], [], []
                for text in some.column(2):
                    s = shingle_set(text.as_py() or b"", plan.width)
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    lo.append(int.from_bytes(d[:8], "little", signed=True))
                    hi.append(int.from_bytes(d[8:], "little", signed=True))
                    sketches.append(sketch(s, plan.bits(len(s))))
                    keys.append(segment_keys(s, plan))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), pa.int64())) for x in (sketches, keys)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), *lists], names=["uid", "id", "n", "lo", "hi", "sketch", "keys"])

    return rows.mapInArrow(settled(run), f"uid long, id {kind}, n long, lo long, hi long, sketch array<long>, keys array<long>")


def alike(m: np.ndarray, x: np.ndarray, k: np.ndarray, y: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether sets of m and k shingles may be linked, by their sizes and the Hamming distance of their sketches."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (np.minimum(m, k) * plan.whole >= np.maximum(m, k) * plan.part) & (apart <= (m + k) * (plan.whole - plan.part) // (plan.whole + plan.part))


def partners(n: np.ndarray, comp: np.ndarray, sketches: np.ndarray, plan: Plan) -> np.ndarray:
    """Which members may, by size and sketch, be linked with one of another component."""
    if len(n) <= 24:
        return (alike(n[:, None], sketches[:, None], n, sketches, plan) & (comp[:, None] != comp)).any(axis=1)
    live = np.zeros(len(n), bool)
    for x in range(len(n)):
        if not live[x]:
            rest = np.flatnonzero(comp != comp[x])
            near = rest[alike(n[rest], sketches[rest], n[x], sketches[x], plan)]
            live[near] = True
            live[x] = len(near) > 0
    return live


def links(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, shingles: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Edges (a, b) that connect the components as all links between the sets do: a forest. shingles: those of all sets,
    one after the other. Sets are counted against all that wait at once, by an index from a shingle to its sets."""
    ends = np.cumsum(n)
    if len(sid) == 2:
        both = len(np.intersect1d(shingles[: n[0]], shingles[n[0] :], assume_unique=True))
        return [(int(sid[0]), int(sid[1]))] if comp[0] != comp[1] and plan.whole * both >= plan.part * (int(n.sum()) - both) else []
    _, comp, size = np.unique(comp, return_inverse=True, return_counts=True)
    _, word = np.unique(shingles, return_inverse=True)
    order = np.argsort(word, kind="stable")
    holder, sorted_word = np.repeat(np.arange(len(sid)), n)[order], word[order]
    waiting, indexed = np.ones(len(sid), bool), 0
    start = count = held = np.empty(0, np.int64)
    out: list[tuple[int, int]] = []
    for first in np.argsort(size, kind="stable"):
        queue = np.flatnonzero(waiting & (comp == first)).tolist()
        waiting[queue] = False
        while queue and waiting.any():
            left = int(waiting.sum())
            if not indexed or 2 * left <= indexed:
                indexed, keep = left, waiting[holder]
                held, count = holder[keep], np.bincount(sorted_word[keep], minlength=int(sorted_word[-1]) + 1)
                start = np.cumsum(count) - count
            x = queue.pop()
            at = word[ends[x] - n[x] : ends[x]]
            many = count[at]
            spot = np.repeat(start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(held[spot], minlength=len(sid))
            for y in np.flatnonzero(waiting & (plan.whole * both >= plan.part * (n[x] + n - both))):
                if waiting[y]:
                    out.append((int(sid[x]), int(sid[y])))
                    whole = np.flatnonzero(waiting & (comp == comp[y]))
                    waiting[whole] = False
                    queue.extend(whole.tolist())
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole (key, block) groups, and where the groups begin and the last ends, from rows sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None

    def full() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
        held.clear()
        return t, np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1, [len(key)]))

    # a part of a batch at a time, about HELD bytes
    for batch in (some for b in batches for some in slices(b, max(1, b.num_rows * HELD // max(1, b.nbytes)))):
        key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        if held and last != (key[0], block[0]):
            yield full()
        other = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            held.append(batch.slice(0, cut))
            yield full()
        held.append(batch.slice(cut))
        last = (key[-1], block[-1])
    if held:
        yield full()


def flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a list column as unsigned numbers, where each row's begin and the last row's end)."""
    lists = t.column(name).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))


def dealt(cand: DataFrame, comp: DataFrame) -> DataFrame:
    """key, block, sid, comp of the groups that hold several components, a row for each block that a member is in."""
    named = cand.join(comp, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", F.coalesce("comp", "sid").alias("comp"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    parts = lambda c, w: F.greatest(F.ceil(c / F.lit(MEMBERS)), F.least(c, F.ceil(w / F.lit(ENTRIES))))
    most = F.max(F.struct("c", "w", "comp"))
    per = per.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("several"), F.sum("c").alias("c"), F.sum("w").alias("w"), most.alias("major")).filter("several > 1")
    outer = F.when(parts(F.col("c"), F.col("w")) <= 2, 0).otherwise(parts(F.col("c") - F.col("major.c"), F.col("w") - F.col("major.w")))
    per = written(per.select("of", F.col("major.comp").alias("major"), outer.cast("int").alias("p"), parts(F.col("major.c"), F.col("major.w")).cast("int").alias("q")))  # stored: a join of its own, whose large groups can then be split
    part = lambda k: F.pmod(F.xxhash64("sid"), F.greatest(k, F.lit(1))).cast("int")
    to = lambda k: F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))
    p, q = F.col("p"), F.col("q")
    each_other = F.transform(to(p), lambda j: F.least(part(p), j) * p + F.greatest(part(p), j))
    outside = F.concat(each_other, F.transform(to(q), lambda j: p * p + part(p) * q + j))
    inside = F.transform(to(p), lambda i: p * p + i * q + part(q))
    block = F.when(p == 0, F.array(F.lit(0))).when(F.col("comp") == F.col("major"), inside).otherwise(outside)
    return named.join(per, F.col("key") == F.col("of")).select("key", F.explode(block).alias("block"), "sid", "comp")


def lively(rows: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Of rows (key, block, sid, comp), those that may by sketch be linked with another component's in their block."""
    rows = rows.join(reps.select("sid", "n", "sketch"), "sid").select("key", "block", "sid", "comp", "n", "sketch")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches):
            n, comp = t.column("n").to_numpy(), t.column("comp").to_numpy()
            words, at = flat(t, "sketch")
            width = np.diff(at)
            live = np.zeros(len(n), bool)
            lo, hi = cuts[:-1], cuts[1:]
            pair = (hi - lo == 2) & (width[lo] == width[np.minimum(lo + 1, len(n) - 1)])
            for w in np.unique(width[lo[pair]]):  # most groups: judged at once
                x = lo[pair & (width[lo] == w)]
                one, other = (words[at[i][:, None] + np.arange(w)] for i in (x, x + 1))
                live[x] = live[x + 1] = alike(n[x], one, n[x + 1], other, plan) & (comp[x] != comp[x + 1])
            for i, j in zip(lo[~pair].tolist(), hi[~pair].tolist()):
                w = width[i:j].min()
                same = words[at[i] : at[j]].reshape(-1, w) if width[i:j].max() == w else np.stack([folded(words[at[k] : at[k + 1]], w) for k in range(i, j)])
                live[i:j] = partners(n[i:j], comp[i:j], same, plan)
            yield from t.filter(pa.array(live)).select(["key", "block", "sid", "comp"]).to_batches()

    return rows.mapInArrow(settled(run), "key long, block int, sid long, comp long")


def bodies(texts: DataFrame, sids: DataFrame, plan: Plan) -> DataFrame:
    """(node, shingles) of the texts whose uid is in sids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                sets = [shingle_set(x.as_py() or b"", plan.width) for x in some.column("text")]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("uid"), lists], names=["node", "shingles"])

    return those_in(texts.select("uid", "text"), "uid", sids, "sid").mapInArrow(settled(run), "node long, shingles array<long>")


def found_links(live: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) between components, by the sets themselves, in each block of live."""
    rows = live.join(sets, F.col("sid") == F.col("node")).select("key", "block", "sid", "comp", "shingles")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_groups(batches):
            sid, comp = t.column("sid").to_numpy(), t.column("comp").to_numpy()
            shingles, at = flat(t, "shingles")
            out = [e for i, j in zip(cuts, cuts[1:]) for e in links(sid[i:j], np.diff(at[i : j + 1]), comp[i:j], shingles[at[i] : at[j]], plan)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(settled(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b) but each component's least one, which is comp.

    Alternating stars: each node's greater neighbours move to its least one, then each node's lesser ones. What hangs together stays so;
    the longest path shortens by a factor in every round, until all edges lead to a least node."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.max("v").alias("high")).select("u", "m", ((F.col("m") < F.col("u")) & ((F.col("high") > F.col("u")) | (F.col("high") > F.col("m")))).alias("open")))
        if least.filter("open").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(low, F.col("a") == F.col("u")).filter("b <> m").select("b", "m")
        edges = written(moved.union(low).toDF("a", "b").distinct())


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan | None = None, keep_uid: bool = False) -> DataFrame:
    """id, n_shingles, component_id of every row of docs (with uid, the row's place as in numbered(), and
    first_uid, that of its component's row with the least id, on request)."""
    docs, files = placed(docs)
    return _components(docs, files, id_col, text_col, plan or Plan(), keep_uid)


def _components(docs: DataFrame, files: DataFrame, id_col: str, text_col: str, plan: Plan, keep_uid: bool) -> DataFrame:
    texts = numbered(docs, files, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).select("uid", "id", "text")
    rows = written(describe(texts, plan), batch=BATCH)
    by_set = rows.filter("n > 0").groupBy("n", "lo", "hi").agg(F.min("uid").alias("sid"), F.min("id").alias("min_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"))
    sets = written(by_set)
    twice = written(rows.select("uid", "n", "lo", "hi").join(sets.select("n", "lo", "hi", "sid"), ["n", "lo", "hi"]).filter("uid <> sid").select("uid"))
    reps = those_not_in(rows.filter(F.size("keys") > 0).select("uid", "n", "sketch", "keys"), "uid", twice, "uid").withColumnRenamed("uid", "sid")
    comp = components(connected(reps, texts, plan))
    named = sets.join(comp, F.col("sid") == F.col("node"), "left").select("n", "lo", "hi", "min_id", "first", F.coalesce("comp", "sid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.min("first")["uid"].alias("first_uid"))
    named = written(named.join(least, "comp").select(F.col("n").alias("k_n"), F.col("lo").alias("k_lo"), F.col("hi").alias("k_hi"), "component_id", "first_uid"))
    out = rows.select("uid", "id", "n", "lo", "hi").join(named, (F.col("n") == F.col("k_n")) & (F.col("lo") == F.col("k_lo")) & (F.col("hi") == F.col("k_hi")), "left")
    out = out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        "uid", F.coalesce("first_uid", "uid").alias("first_uid"),
    )
    return out if keep_uid else out.drop("uid", "first_uid")


def connected(reps: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) that connect the sets reps (sid, n, sketch, keys) as all their links do."""
    keyed = reps.select("sid", F.explode("keys").alias("key"))
    # most keys are there once: two numbers a row are shuffled, and aggregated where they arrive
    ends = keyed.repartition("key").groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    shared = written(ends.filter("low < high").select("key"))
    member = written(those_in(reps.select("sid", "n", F.explode("keys").alias("key")), "key", shared, "key"))
    # segments with the same members are one group
    said = [F.bit_xor(F.xxhash64("sid", F.lit(i))) for i in (1, 2)]
    groups = member.groupBy("key").agg(F.count("*").alias("members"), said[0].alias("x"), said[1].alias("y"))
    groups = written(groups.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members"))
    cand = written(member.join(groups, "key"))
    first = written(cand.groupBy("sid").agg(F.max(F.struct("members", "key"))["key"].alias("key")).select("key").distinct())
    edges = comp = None
    for some in (cand.join(first, "key", "left_semi"), cand.join(first, "key", "left_anti")):
        comp = components(edges) if edges is not None else cand.limit(0).select(F.col("sid").alias("node"), F.col("sid").alias("comp"))
        live = written(lively(dealt(some, comp), reps, plan), batch=BATCH)
        sets = written(bodies(texts, live.select("sid").distinct(), plan), batch=BATCH)
        new = written(found_links(live, sets, plan), batch=BATCH)
        edges = new if edges is None else edges.union(new)
    return edges


def one_of_each(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The row of each component with the least id (null last, equal ids by place in the table), with all columns of docs."""
    names = docs.columns
    docs, files = placed(docs)
    dropped = written(_components(docs, files, "doc_id", "text", plan or Plan(), True).filter("uid <> first_uid").select("uid"))
    return those_not_in(numbered(docs, files, record(names)), "uid", dropped, "uid").select(*unpacked(names))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
