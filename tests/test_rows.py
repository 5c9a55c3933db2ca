import pytest
from pyspark.sql import functions as F

from rowloom.functions import rows as R
from rowloom.operators import bloom, joins, summarize
from rowloom.sources import generator, kv_store

GOLDEN = [
    ('<row Id="1" Text="a &lt;" UserId="" Z="9" />', [("Id", "1"), ("Text", "a &lt;"), ("UserId", ""), ("Z", "9")]),
    ('<row Id="1" Text="" />', [("Id", "1")]),
    ('  <row Id="1" Id="2" />', [("Id", "1"), ("Id", "2")]),
    ('<row A="1" "x" B="2" />', [("A", "1")]),
    ("", []),
    ("<posts>", []),
    ('<row Id="1" T="x">', [("Id", "1")]),
]


@pytest.mark.parametrize("line, pairs", GOLDEN)
def test_row_pairs(spark, line, pairs):
    got = spark.createDataFrame([(line,)], "value string").select(R.row_pairs(F.col("value"))).first()[0]
    assert [tuple(x) for x in got] == pairs


def test_last_attribute_wins(spark):
    df = spark.createDataFrame([('<row Id="1" Id="2" />',)], "value string")
    assert R.parse_rows(df, ["Id", "No"]).select("Id", "No").first() == ("2", None)


def test_unescape_and_length(spark):
    df = spark.createDataFrame([("&apos;&amp;&#39;&amp x",)], "t string")
    assert df.select(R.unescape_html4("t")).first()[0] == "&apos;&'&amp x"
    assert spark.createDataFrame([("\U0001f600a",)], "t string").select(R.utf16_length(F.col("t"))).first()[0] == 3


def test_timestamps(spark):
    text = ["2010-01-02T03:04:05.678", "2010-01-02T03:04:05", "2010-13-02T03:04:05.678", "2010-01-02T03:04:05.678Z"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in text], "t string").select(R.timestamp(F.col("t"))).collect()]
    assert got[0].microsecond == 678000 and got[1:] == [None, None, None]


def test_symmetric_anti_and_bad_kind(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (2,), (3,)], "b int")
    sizes = {how: joins.equi_join(a, b, "a", "b", how).count() for how in joins.KINDS}
    assert sizes == {"inner": 2, "leftouter": 3, "rightouter": 3, "fullouter": 4, "symmetric_anti": 2}
    with pytest.raises(ValueError):
        joins.equi_join(a, b, "a", "b", "sideways")


def test_median_variants_agree(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (0, 4), (0, 9), (1, 5)], "k int, v int")
    one = summarize.median_stddev(df, F.col("k"), F.col("v")).orderBy("key").collect()
    two = summarize.median_stddev_histogram(df, F.col("k"), F.col("v")).orderBy("key").collect()
    assert one[0]["median"] == two[0]["median"] == 3.0 and abs(one[0]["stddev"] - two[0]["stddev"]) < 1e-9
    assert one[1]["stddev"] is None and two[1]["stddev"] is None


def test_bloom_has_no_false_negative(spark):
    assert bloom.size_for(1000, 0.01)[0] == 9585 and bloom.size_for(100, 0.1)[0] == 479
    m, k = bloom.size_for(200, 0.01)
    bits = bloom.train(spark.range(200).withColumnRenamed("id", "k"), "k", m, k)
    found = bloom.probe(spark.range(2000).withColumnRenamed("id", "k"), "k", bits, m, k)
    assert found.filter("k < 200").count() == 200 and found.count() < 300


def test_month_read_prunes_and_generator_parses(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "2010-02-03"), (2, 6, "2011-03-01"), (3, 7, "2012-12-01")], "id int, v int, d string").withColumn("d", F.to_date("d"))
    kv_store.write_months(df, str(tmp_path / "kv"), "id", "v", F.col("d"))
    assert kv_store.read_months(spark, str(tmp_path / "kv"), ["JAN", "FEB"]).count() == 1
    rows = R.parse_rows(generator.comments(spark, 2, 10, ["x", "y"]), ["Id", "UserId"])
    assert rows.count() == 20 and rows.filter("UserId is null").count() == 0
    bad = R.parse_rows(generator.comments(spark, 1, 5, ["x"], legacy_malformed=True), ["UserId"])
    assert bad.filter("UserId is not null").count() == 0
