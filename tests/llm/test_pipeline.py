"""Every stage of the pipeline against brute force over the stage before, and the queries' contracts."""

import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rowloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from rowloom.llm.common import written

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage, over whole documents and rows with nulls and odd names beside them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("row", F.lit("x")).withColumn("uid", F.lit(7)).withColumn("`", F.lit(8))
    odd = [(None, "the words of it and the rest of that", None, None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 34", "en", "s", 5), (-4, "<|endoftext|> at its ends and <|endoftext|><|endoftext|>", "en", "s", 50)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = written(docs.unionByName(odd, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF_DIR))
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_stay(stages):
    assert [n for n, _, _ in stages] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_stage(stages):
    _, before, after = stages[0]
    lettered = [r for r in before.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert Counter(map(tuple, lettered)) == Counter(map(tuple, after.collect()))


def test_exact_stage(stages):
    _, before, after = stages[1]
    best = {}
    for r in before.collect():
        rank = (-len(r.text), r.doc_id is None, r.doc_id or 0)
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, rank), rank)
    got = Counter((-len(r.text), r.doc_id is None, r.doc_id or 0) for r in after.collect())
    assert got == Counter(best.values())


def test_near_stage(stages):
    _, before, after = stages[2]
    rows = before.collect()
    sets = []
    for r in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(r.text)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    least = {}
    for r, n in zip(rows, name):
        rank = (r.doc_id is None, r.doc_id or 0)
        least[n] = min(least.get(n, rank), rank)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == Counter(least.values())


def test_mixing_stage(stages):
    _, before, after = stages[3]
    sizes, mixed, texts = Counter(), Counter(), {}
    for r in before.collect():
        sizes[r.source] += len(words(r.text))
        texts[r.doc_id] = words(r.text)
    copies = Counter()
    for r in after.collect():
        mixed[r.source] += len(words(r.text))
        assert words(r.text) == texts[r.doc_id]
        copies[r.doc_id] += len(words(r.text))
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: s.encode()), *[s for s in sizes if s is None]]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: share * weight[s] for s in free}
    longest = {s: max(len(words(r.text)) for r in before.collect() if r.source == s) for s in order}
    assert all(abs(mixed[s] - target[s]) <= 1 + longest[s] / 2 for s in order)
    assert all(n <= 2 * len(texts[d]) for d, n in copies.items())


def test_packing_stage(stages):
    _, before, after = stages[4]
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        want.update(zip([r.doc_id] * 10**6, [*tok.encode(r.text, add_special_tokens=False).ids, 0]))
    got, at = Counter(), {}
    for r in after.collect():
        ids = memoryview(r.ids).cast("I").tolist()
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
        got.update((r.doc_id, i) for i in ids)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 1024


COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score", "op2_neighbours": "query_id rank vec_id score",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_mix_sources": "doc_id size source_size target taken", "op6_jaccard_join": "doc_id n_shingles component_id",
    "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8_url_filter": "page_id host path rule verdict",
    "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    out = __spark_entry__.queries()[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    per_row = {"op2_neighbours": None, "op8_url_filter": "pages", "op10_packing": None}.get(name, "documents")
    if per_row:
        assert out.count() == spark.read.parquet(f"{SF_DIR}/{per_row}.parquet").count()


@pytest.mark.parametrize("module, inner, outer", [(exact_dedup, "_index", "deduplicated"), (mixing, "drawn", "mixed_documents"), (jaccard_join, "_components", "one_of_each")])
def test_scans_split_otherwise(spark, tmp_path, monkeypatch, module, inner, outer):
    """A stage's second scan may be split into other partitions than its first: the same rows stay."""
    rows = [(i, " ".join(f"w{i % 50}x{j}" for j in range(8 + i % 50 % 7)), "en", "ab"[i % 2]) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(12, "doc_id").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    want = Counter(map(tuple, getattr(module, outer)(docs).collect()))
    real = getattr(module, inner)

    def then_split(*a, **b):
        out = real(*a, **b)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # with the cost of opening one: a file a partition
        return out

    monkeypatch.setattr(module, inner, then_split)
    try:
        got = Counter(map(tuple, getattr(module, outer)(spark.read.parquet(f"{tmp_path}/t")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


@pytest.mark.parametrize("module, name", [(packing, "packing"), (language_id, "language_id")])
def test_batches(spark, monkeypatch, module, name):
    """What executors and workers hold of texts and ids at once has a bound in bytes, whatever the rows are."""
    wide = 200_000

    def bounded(run):
        def wrapped(batches):
            for side in (lambda x: x, run):
                batches = (lambda some: (checked(b) for b in some))(side(batches))
            yield from batches

        def checked(batch):  # of texts and pieces, or a column of texts
            size = batch.get_total_buffer_size() if hasattr(batch, "get_total_buffer_size") else sum(len(str(x or "")) for x in getattr(batch, "array", batch))
            assert len(batch) == 1 or size <= (4 << 20) + 2 * wide, size
            return batch

        return wrapped

    monkeypatch.setattr(module, "settled", bounded)
    docs = written(spark.range(100).repartition(1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), wide // 8).alias("text")))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = getattr(corpus_pipeline, name)(spark, docs, SF_DIR)
    assert got.select("doc_id").distinct().count() == 100
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_packing_pieces():
    """Pieces leave the worker PIECES at a time, and are the same however the rows come in batches."""
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * (i * 37 % 5000) for i in range(3000)])], names=["id", "text"])
    encode = lambda text: list(range(1, len(text) + 1))
    got = list(packing.pieces(iter([rows]), encode, 7))
    assert max(b.num_rows for b in got) <= packing.PIECES and max(b.nbytes for b in got) <= 3 << 20
    parted = packing.pieces((rows.slice(at, 113) for at in range(0, 3000, 113)), encode, 7)
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(parted))
