"""Edge cases of the analytics operators on small fixtures."""

import gzip

import pytest
from pyspark.sql import functions as F

from rowloom.operators import bloom, filtering, joins, organize, summarize
from rowloom.plans import pipelines
from rowloom.sources import text


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_top_ties(spark):
    users = spark.createDataFrame([(1, 50), (2, 50), (3, 40), (4, None)], "id int, rep int")
    assert [tuple(r) for r in filtering.top(users, "rep", "id").collect()] == [(2, 50), (3, 40)]
    assert [r.id for r in filtering.top(users, "rep", "id", ties="keep").collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        filtering.top(users, "rep", "id", ties="first")


def test_whole_line_must_match(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), (None,)], "t string")
    assert values(filtering.grep(df, "t", "a.c")) == [("abc",)]
    assert values(filtering.grep(df, "t", "x|abc")) == [("abc",)]


def test_hot_words(spark):
    df = spark.createDataFrame([("word. Word word",), ("Word word.",), ("w'ord",), (None,)], "t string")
    assert values(filtering.hot_words(df, "t", ["word"])) == [("w'ord",), ("word. Word word",)]
    assert filtering.hot_words(df, "t", ["word"], case_sensitive=False).count() == 3


def test_first_match_bucket(spark):
    df = spark.createDataFrame([(x,) for x in ("Dallas TX", "Dallas,TX", "lives in Rome", "", None)], "t string")
    assert values(summarize.first_match_bucket(df, "t", ["TX", "IN"])) == [("IN", 1), ("NullOrEmpty", 2), ("TX", 1), ("Unknown", 1)]


def test_deviation_of_one_value(spark):
    one = spark.createDataFrame([(0, 3)], "k int, v int")
    assert summarize.median_stddev(one, F.col("k"), F.col("v")).first()["stddev"] is None
    assert str(summarize.median_stddev(one, F.col("k"), F.col("v"), nan_on_single=True).first()["stddev"]) == "nan"


def test_unique_count_of_nothing(spark):
    assert filtering.count_distinct(spark.createDataFrame([], "u int"), "u").first()[0] == 0


def test_replicated_join_takes_the_last_row(spark):
    users = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "x")], "id int, at int, name string")
    posts = spark.createDataFrame([(1,), (1,), (3,)], "user int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (old, "-1"):  # broadcast, and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        assert values(joins.replicated_join(posts, users, "user", "id", "at").select("user", "name")) == [(1, "new"), (1, "new")]
        assert joins.replicated_join(posts, users, "user", "id", "at", "leftouter").count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reduced_join_and_overlap(spark):
    a = spark.createDataFrame([(1, 1500), (2, 1501), (3, 2000)], "a int, rep int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "b int")
    kept = {how: joins.reduced_join(a, b, "a", "b", F.col("rep") > 1500, how).count() for how in joins.KINDS}
    assert kept == {"inner": 2, "leftouter": 3, "rightouter": 2, "fullouter": 3, "symmetric_anti": 1}
    t = spark.createDataFrame([(1, "a b c d"), (2, "d c b b"), (3, "a b"), (4, None)], "id int, t string")
    assert values(joins.token_overlap(t, "id", F.split("t", " "))) == [(1, 2, 3), (2, 1, 3)]
    assert joins.theta_pairs(b, b.withColumnRenamed("b", "c"), F.col("b") != F.col("c")).count() == 4


def test_large_bloom_filter_stays_a_table(spark):
    m, k = bloom.size_for(100, 0.01)
    bits = bloom.train(spark.range(100), "id", m, k)
    probes = spark.range(1000)
    assert values(bloom.probe(probes, "id", bits, m, k)) == values(bloom.probe(probes, "id", bits, m, k, most=0))


def test_nesting(spark):
    posts = spark.createDataFrame([(1, "p"), (2, "q")], "id int, title string")
    comments = spark.createDataFrame([(7, 1, "b"), (6, 1, "a"), (8, 9, "orphan")], "cid int, post int, body string")
    nested = organize.nest(posts, comments, "id", "post", ["cid"])
    got = {r.id: r.children and [c.cid for c in r.children] for r in nested.collect()}
    assert got == {1: [6, 7], 2: None}
    lines = [r[0] for r in nested.orderBy("id").select(organize.nested_xml(nested, ["id", "title"], "comments", "post")).collect()]
    assert lines == ['<post id="1" title="p"><comments cid="6" body="a"/><comments cid="7" body="b"/></post>', '<post id="2" title="q"/>']
    odd = organize.nest(spark.createDataFrame([(1, 'a<b>&"\n')], "id int, title string"), comments.limit(0), "id", "post", ["cid"])
    assert odd.select(organize.nested_xml(odd, ["id", "title"], "comments", "post")).first()[0] == '<post id="1" title="a&lt;b&gt;&amp;&quot;"/>'


def test_questions_keep_only_their_answers(spark):
    posts = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 1, 2), (4, 8, 2), (5, None, 1), (6, 5, None)], "id int, parent int, kind int")
    got = {r.id: r.children and [c.id for c in r.children] for r in organize.questions_with_answers(posts, "id", "parent", "kind").collect()}
    assert got == {1: [2, 3], 5: [6]}


def test_bins_order_and_shuffle(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2 == 0).alias("even"))
    assert organize.bins(df, {"even": F.col("even"), "small": F.col("id") < 10, "null": F.lit(None).cast("boolean")}).count() == 60
    assert [r.id for r in organize.total_order(df.repartition(5), 4, "id").collect()] == list(range(100))
    assert values(organize.shuffled(df, 3)) == values(df)
    shards = spark.range(50).select(organize.shard_of(F.col("id"), 6).alias("s")).distinct().collect()
    assert {r.s for r in shards} <= set(range(6))
    assert spark.sql("select date'2020-12-01' as d").select(organize.month_shard(F.col("d"))).first()[0] == 5


def test_anonymized(spark):
    df = spark.sql("select 1 as Id, 2 as UserId, timestamp_ntz'2020-01-02 03:04:05' as At, 'x' as Text")
    assert values(organize.anonymized(df, ["Id", "UserId"], "At")) == [("2020-01-02", "x")]


def test_chained_bins(spark):
    posts = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "u int")
    users = spark.createDataFrame([(1, 10)], "id int, rep int")
    binned = pipelines.activity_bins(posts, users, "u", "id", "rep")
    assert values(binned) == [(1, 3, 10, "aboveavg"), (2, 1, None, "belowavg")]
    assert values(pipelines.bin_averages(binned)) == [("aboveavg", 10.0), ("belowavg", None)]


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"k\tv\tw\r\nalone\r\n")
    with gzip.open(tmp_path / "in" / "b.gz", "wb") as f:
        f.write(b"z\t\n")
    rows = text.key_tab_value(spark, str(tmp_path / "in"))
    assert values(rows) == [("alone", None), ("k", "v\tw"), ("z", "")]
    text.write_key_tab_value(rows, str(tmp_path / "out"), "key", "value")
    assert values(text.lines(spark, str(tmp_path / "out"))) == [("alone\t",), ("k\tv\tw",), ("z\t",)]
    text.write_bins(rows, str(tmp_path / "bins"), "key")
    assert values(spark.read.parquet(str(tmp_path / "bins")).filter("key = 'z'").select("value")) == [("",)]


def test_medians(spark):
    import random

    r = random.Random(4)
    rows = [("even", x) for x in (1.0, 2.0, 4.0, 9.0)] + [("one", 5.0)] + [("many", r.choice([1.5, 2.5, r.random() * 100])) for _ in range(5001)] + [("same", 7.0)] * 999 + [("two", 1.0)] * 50 + [("two", 2.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    many = sorted(v for k, v in rows if k == "many")
    want = {"even": 3.0, "one": 5.0, "many": many[2500], "same": 7.0, "two": 1.5}
    for f in (summarize.median_stddev, summarize.median_stddev_histogram):
        assert {x.key: x.median for x in f(df, F.col("k"), F.col("v")).collect()} == want


def test_saved_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join(f" k{i} \n" for i in range(50)) + "\n")
    with gzip.open(tmp_path / "in" / "b.gz", "wt") as f:
        f.write("".join(f"g{i}\n" for i in range(50)))
    m, k = bloom.size_for(100, 0.01)
    bits = bloom.train_on_folder(spark, str(tmp_path / "in"), m, k)
    bloom.save(bits, str(tmp_path / "f"), m, k)
    loaded, *size = bloom.load(spark, str(tmp_path / "f"))
    assert size == [m, k] and values(loaded) == values(bits)
    keys = spark.createDataFrame([(f"{c}{i}",) for c in "kgx" for i in range(50)] + [(None,)], "key string")
    got = {r.key for r in bloom.probe(keys, "key", loaded, *size).collect()}
    assert got >= {f"{c}{i}" for c in "kg" for i in range(50)} and len(got) <= 105
    bloom.save(bits.limit(0), str(tmp_path / "none"), m, k)
    assert bloom.probe(keys, "key", *bloom.load(spark, str(tmp_path / "none"))).count() == 0


def test_side_files_and_named_outputs(spark, tmp_path):
    (tmp_path / "words").write_text("b \na\r\n\nb\nc")
    assert text.word_list(spark, str(tmp_path / "words")) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        text.word_list(spark, str(tmp_path / "words"), 2)
    df = spark.createDataFrame([(1, "x", None), (2, "y", "v")], "id int, bin string, v string")
    text.write_named(df, str(tmp_path / "out"), "bin", "id", "v")
    assert values(spark.read.text(str(tmp_path / "out"))) == [("1\t", "x"), ("2\tv", "y")]
    assert text.remove(spark, str(tmp_path / "out")) and not text.remove(spark, str(tmp_path / "out"))


def test_partitions_by_year(spark, tmp_path):
    df = spark.createDataFrame([(1, 2008), (2, 2011), (3, 2012), (4, 2007), (5, None)], "id int, year int")
    organize.write_partitions(df, str(tmp_path / "out"), F.col("year"), 2008, 4)
    assert values(spark.read.parquet(str(tmp_path / "out")).select("id", "pid")) == [(1, 0), (2, 3), (3, -1), (4, -1)]
    assert (tmp_path / "out" / "pid=3").is_dir()


def test_counters(spark, tmp_path):
    users = spark.createDataFrame([(x,) for x in ("Dallas TX", "tx", "Rome", "", None)], "t string")
    assert pipelines.state_counters(users, "t", ["TX", "IN"]) == {"TX": 2, "IN": 0, "NullOrEmpty": 2, "Unknown": 1}
    posts = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "u int")
    known = spark.createDataFrame([(1, 10)], "id int, rep int")
    assert pipelines.counted_bins(posts, known, "u", "id", "rep", str(tmp_path)) == {"records": 4, "users": 2}
    assert values(spark.read.parquet(f"{tmp_path}/bins").select("user", "posts", "reputation", "bin")) == [(1, 3, 10, "aboveavg"), (2, 1, None, "belowavg")]


def test_theta_pairs_are_the_product(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    for grid in ((1, 1), (3, 2), (8, 8)):
        assert values(joins.theta_pairs(a, b, F.col("a") >= F.col("b"), *grid)) == sorted(((i, j) for i in range(7) for j in range(5) if i >= j), key=str)


def test_row_without_ids(spark):
    from rowloom.functions import rows

    line = '<row Id="1" Score="4" UserId="2" CreationDate="2010-01-02T03:04:05.678" Score="5" />'
    got = spark.createDataFrame([(line,), ("",)], "value string").select(rows.anonymized_row(F.col("value"))).collect()
    assert [r[0] for r in got] == ['<row CreationDate="2010-01-02" Score="5" >', None]
