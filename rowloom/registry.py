"""Named queries over the driver's tables and SQL that says the same."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import rows as R
from rowloom.operators import bloom, filtering, joins, organize, summarize
from rowloom.plans import pipelines
from rowloom.sources import generator, kv_store, text

SIZES = ("SMALL", "MEDIUM", "LARGE", "GREEN", "BLUE", "STEEL", "BRASS")


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share; a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def customers(s, d):
    return t(s, d, "customer").select("c_custkey", "c_acctbal")


def orders(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def events(s, d):
    return t(s, d, "events").select("event_id", "user_id", "value")


def labels(s, d):
    return t(s, d, "labels").select("doc_id", "quality")


def turns(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", "role")


#: Sides, their keys and the left side's value: every order has a customer, but labels and conversations both have rows without partners.
MATCHED = (customers, orders, "c_custkey", "o_custkey", "c_acctbal")
LOOSE = (labels, turns, "doc_id", "conv_id", "quality")


def join(how, of):
    left, right, left_key, right_key, _ = of
    return lambda s, d: joins.equi_join(left(s, d), right(s, d), left_key, right_key, how)


def broadcast(how, of):
    left, right, left_key, right_key, value = of
    return lambda s, d: joins.replicated_join(right(s, d), left(s, d), right_key, left_key, value, how)


def bucket(how, of):
    left, right, left_key, right_key, _ = of

    def run(s, d):
        app = re.sub(r"\W", "_", s.sparkContext.applicationId)  # sessions that share a warehouse don't meet
        names = f"rowloom_{left.__name__}_{app}", f"rowloom_{right.__name__}_{app}"
        joins.bucketed(left(s, d), names[0], left_key)
        joins.bucketed(right(s, d), names[1], right_key)
        return joins.composite_join(s, *names, left_key, right_key, how)

    return run


def reduced(how):
    return lambda s, d: joins.reduced_join(customers(s, d), events(s, d), "c_custkey", "user_id", F.col("c_acctbal") > 8000, how)


def hierarchy(s, d):
    kids = t(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = organize.nest(t(s, d, "orders").select("o_orderkey"), kids, "o_orderkey", "l_orderkey", ["l_linenumber"])
    return n.select("o_orderkey", F.array_join(F.col("children.l_linenumber"), ",").alias("lines"))


def questions(s, d):
    c = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000).alias("parent"), F.when(F.col("turn") == 0, 1).otherwise(2).alias("kind"), "role")
    n = organize.questions_with_answers(c, "id", "parent", "kind")
    return n.select("id", F.array_join(F.transform("children", lambda x: x["id"].cast("string")), ",").alias("answers"))


def multi_bin(s, d):
    name = F.col("p_name")
    rules = {"steel": F.lower("p_type").contains("steel"), "brass": F.lower("p_type").contains("brass"), "s": F.lower(name).contains("s")}
    return organize.bins(t(s, d, "part").select("p_partkey", "p_type", "p_name"), rules).select("p_partkey", "bin")


def chain(s, d):
    return pipelines.activity_bins(t(s, d, "orders").select("o_custkey"), t(s, d, "customer"), "o_custkey", "c_custkey", "c_acctbal")


def per_reputation(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_nationkey")
    return pipelines.posts_per_value(t(s, d, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("c_nationkey"), 12)


def months(s, d):
    o = t(s, d, "orders")
    path = scratch(s)
    kv_store.write_months(o, path, "o_orderkey", "o_orderpriority", F.col("o_orderdate"))
    return kv_store.read_months(s, path, ["FEB", "MAR"]).select(F.col("month0").cast("int"), "field", "value")


def kv_roundtrip(s, d):
    path = scratch(s)
    kv_store.write_hash(t(s, d, "customer"), path, "c_custkey", "c_mktsegment", "segments", 6)
    return kv_store.read_hash(s, path, "segments")


def bloom_probe(s, d):
    """Members found by the filter and then held against the exact set."""
    hot = t(s, d, "customer").filter("c_acctbal >= 9000").select("c_custkey")
    m, k = bloom.size_for(max(1, hot.count()), 0.01)
    maybe = bloom.probe(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", bloom.train(hot, "c_custkey", m, k), m, k)
    return filtering.members(maybe, "o_custkey", hot, "c_custkey", F.lit(True)).select("o_orderkey", "o_custkey")


def merged(s, d):
    e = t(s, d, "events").select("user_id", "event_type", "ts")
    return pipelines.tagged(A=e.select(F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd"))), D=filtering.distinct(e, "user_id"))


def overlap(s, d):
    return joins.token_overlap(t(s, d, "benchmark"), "item_id", F.filter(F.split("text", r"\s+"), lambda x: x != ""))


def raw_rows(s, d):
    """Events as attribute rows, parsed again."""
    e = t(s, d, "events")
    kv = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("Id", "event_id"), ("UserId", "user_id"), ("Kind", "event_type"))])
    return R.parse_rows(e.select(R.to_row(kv).alias("value")), ["Id", "UserId", "Kind"]).select(F.col("Id").cast("long").alias("event_id"), F.col("UserId").cast("long").alias("user_id"), F.col("Kind").alias("event_type"))


def generate(s, d):
    return R.parse_rows(generator.comments(s, 4, 250, ["alpha", "beta", "gamma"]), ["Id", "PostId", "Score", "UserId", "CreationDate", "Text"]).drop("value")


def token_sets(s, d):
    out = t(s, d, "documents").select("doc_id", F.concat_ws(",", R.token_set(F.col("text"), F.array(F.lit("the"), F.lit("of")))).alias("tokens"))
    # exploded, not filtered: a filter would make the tokens a second time
    return out.select("doc_id", F.explode(F.filter(F.array("tokens"), lambda x: x != "")).alias("tokens"))


def token_sets_side_file(s, d):
    """The same with the stop words of a file."""
    path = scratch(s)
    s.createDataFrame([("the ",), ("of",), ("",), ("of",)], "value string").write.text(path)
    stop = F.array(*[F.lit(w) for w in text.word_list(s, path)])
    out = t(s, d, "documents").select("doc_id", F.concat_ws(",", R.token_set(F.col("text"), stop)).alias("tokens"))
    return out.select("doc_id", F.explode(F.filter(F.array("tokens"), lambda x: x != "")).alias("tokens"))


def event_rows(s, d):
    """Events as attribute rows."""
    e = t(s, d, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    kv = [F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("Id", "event_id"), ("UserId", "user_id"), ("Kind", "event_type"), ("CreationDate", "at"))]
    return e.select(R.to_row(F.array(*kv)).alias("value"))


def typed_turns(s, d):
    """Conversations as posts: the first turn a question, the second of no type, the others answers."""
    kind = F.when(F.col("turn") == 0, 1).when(F.col("turn") > 1, 2)
    return t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000).alias("parent"), kind.alias("kind"), "role")


def post_comment_xml(s, d):
    n = organize.nest(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "o_orderkey", "l_orderkey", ["l_linenumber"])
    return n.select(organize.nested_xml(n, ["o_orderkey", "o_orderstatus"], "comments", "post").alias("xml"))


def question_answer_xml(s, d):
    n = organize.questions_with_answers(typed_turns(s, d), "id", "parent", "kind")
    return n.select(organize.nested_xml(n, ["id", "role"], "answer", "question").alias("xml"))


def year_partitions(s, d):
    path = scratch(s)
    organize.write_partitions(t(s, d, "orders").select("o_orderkey", "o_orderdate"), path, F.year("o_orderdate"), 1995, 3)
    return s.read.parquet(path).select("pid", "o_orderkey")


def bloom_file(s, d):
    """A filter trained on a folder of lines, saved, loaded and probed; what it lets through is held against the exact set."""
    path, hot = scratch(s), t(s, d, "customer").filter("c_acctbal >= 9000").select("c_custkey")
    hot.select(F.col("c_custkey").cast("string").alias("value")).write.option("compression", "gzip").text(f"{path}/members")
    m, k = bloom.size_for(max(1, hot.count()), 0.01)
    bloom.save(bloom.train_on_folder(s, f"{path}/members", m, k), f"{path}/filter", m, k)
    rows = t(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("key"))
    maybe = bloom.probe(rows, "key", *bloom.load(s, f"{path}/filter"))
    return filtering.members(maybe, "o_custkey", hot, "c_custkey", F.lit(True)).select("o_orderkey", "o_custkey")


def cartesian_golden(s, d):
    """The lines of two files a side, each with each."""
    side = lambda x, name: s.createDataFrame([(f"{x}{i}{j}",) for i in (1, 2) for j in (1, 2, 3, 4)], f"{name} string")
    return joins.theta_pairs(side("A", "left_line"), side("B", "right_line"), F.lit(True), 2, 2)


def theta_join(s, d):
    return joins.theta_pairs(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), t(s, d, "nation").select("n_nationkey"), F.col("s_acctbal") < F.col("n_nationkey") * 100)


def state_counters(s, d):
    found = pipelines.state_counters(t(s, d, "part"), "p_name", SIZES)
    return s.createDataFrame(sorted(found.items()), "counter string, n long")


def chain_counters(s, d):
    found = pipelines.counted_bins(t(s, d, "orders").select("o_custkey"), t(s, d, "customer"), "o_custkey", "c_custkey", "c_acctbal", scratch(s))
    return s.createDataFrame([(found["records"], found["users"])], "records long, users long")


def named_outputs(s, d):
    path = scratch(s)
    text.write_named(chain(s, d).select("user", "posts", "bin"), path, "bin", "user", "posts")
    return s.read.text(path).select(F.col("value").alias("line"), "bin")


def kv_last_write(s, d):
    path = scratch(s)
    kv_store.write_hash(t(s, d, "events"), path, "user_id", "event_type", "last", 6, "event_id")
    return kv_store.read_hash(s, path, "last")


def sample_invariants(s, d):
    """Of a sample: rows that aren't in the table, and whether its size is near what was asked for."""
    e = t(s, d, "events")
    got, every = filtering.sample(e, 10, 3), e.count()
    foreign = got.join(e, "event_id", "left_anti").count()
    return s.createDataFrame([(foreign, abs(got.count() - every / 10) <= 5 * (every * 0.09) ** 0.5)], "foreign long, near boolean")


def generate_invariants(s, d):
    rows = generate(s, d).select(F.col("Id").cast("long").between(0, 10**9 - 1) & F.col("UserId").cast("long").between(0, 10**6 - 1) & F.col("Score").cast("long").between(0, 14_999) & F.col("Text").rlike(r"\A(?:(?:alpha|beta|gamma) ){1,30}\z") & R.timestamp(F.col("CreationDate")).isNotNull())
    return rows.toDF("good").agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"))


QUERIES = {
    "word_count": lambda s, d: summarize.word_count(t(s, d, "documents"), "text"),
    "minmax_count": lambda s, d: summarize.min_max_count(t(s, d, "events"), "user_id", "ts"),
    "avg_length_by_hour": lambda s, d: summarize.count_average(t(s, d, "events"), F.hour("ts"), R.utf16_length(F.col("props"))),
    "median_stddev": lambda s, d: summarize.median_stddev(t(s, d, "events"), F.hour("ts"), F.col("value")),
    "median_stddev_hist": lambda s, d: summarize.median_stddev_histogram(t(s, d, "events"), F.hour("ts"), F.length("props")),
    "first_match_bucket": lambda s, d: summarize.first_match_bucket(t(s, d, "part"), "p_name", SIZES),
    "inverted_index": lambda s, d: summarize.inverted_index(t(s, d, "pages"), F.regexp_extract("html", 'href="([^"#]*)', 1), "page_id"),
    "grep": lambda s, d: filtering.grep(t(s, d, "documents"), "text", "(?s).* of the .*").select("doc_id"),
    "hot_words": lambda s, d: filtering.hot_words(t(s, d, "documents"), "text", ("worthless", "which", "hein")).select("doc_id"),
    "sample": lambda s, d: filtering.sample(t(s, d, "events"), 10, 3),
    "top_ten": lambda s, d: filtering.top(t(s, d, "customer").select("c_acctbal", "c_custkey"), "c_acctbal", "c_custkey"),
    "distinct_users": lambda s, d: filtering.distinct(t(s, d, "events"), "user_id"),
    "unique_users": lambda s, d: filtering.count_distinct(t(s, d, "events"), "user_id"),
    "hot_user_semi": lambda s, d: filtering.members(t(s, d, "orders"), "o_custkey", t(s, d, "customer"), "c_custkey", F.col("c_acctbal") >= 9000).select("o_orderkey", "o_custkey"),
    "bloom_probe": bloom_probe,
    "bloom_sizing": lambda s, d: s.createDataFrame([(1000, 0.01), (100, 0.1)], "n long, p double").select("n", "p", bloom.sizing(F.col("n"), F.col("p"))[0].alias("m"), bloom.sizing(F.col("n"), F.col("p"))[1].alias("k")),
    "join_inner": join("inner", MATCHED), "join_left": join("leftouter", LOOSE), "join_right": join("rightouter", LOOSE), "join_full": join("fullouter", LOOSE), "join_symmetric_anti": join("symmetric_anti", LOOSE),
    "broadcast_inner": broadcast("inner", MATCHED), "broadcast_left": broadcast("leftouter", LOOSE), "bucketed_inner": bucket("inner", MATCHED), "bucketed_full": bucket("outer", LOOSE),
    "bloom_inner": reduced("inner"), "bloom_left": reduced("leftouter"), "bloom_right": reduced("rightouter"), "bloom_full": reduced("fullouter"), "bloom_anti": reduced("symmetric_anti"),
    "token_overlap_pairs": overlap, "token_sets": token_sets, "raw_rows": raw_rows,
    "hierarchy_nested": hierarchy, "question_answers": questions, "multi_bin": multi_bin,
    "anonymize": lambda s, d: organize.anonymized(t(s, d, "events"), ["event_id", "user_id"], "ts"),
    "job_chain_bins": chain, "job_control_avg": lambda s, d: pipelines.bin_averages(chain(s, d)), "posts_per_reputation": per_reputation,
    "month_pruned_read": months, "kv_roundtrip": kv_roundtrip, "generate": generate,
    "year_partition_counts": lambda s, d: t(s, d, "orders").groupBy(organize.partition_number(F.year("o_orderdate"), 1995).alias("pid")).agg(F.count("*").alias("n")),
    "total_order": lambda s, d: organize.total_order(t(s, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber"), 10, "l_shipdate", "l_orderkey", "l_linenumber"),
    "shuffle": lambda s, d: organize.shuffled(t(s, d, "customer").select("c_custkey", "c_name"), 5),
    "merged_anon_distinct": merged,
    "word_count_unescaped": lambda s, d: summarize.word_count(t(s, d, "pages"), "html", escaped=True),
    "inverted_index_unescaped": lambda s, d: summarize.inverted_index(t(s, d, "pages"), F.regexp_extract(R.unescape_html4("html"), 'href="([^"#]*)', 1), "page_id"),
    "post_comment_xml": post_comment_xml, "question_answer_xml": question_answer_xml, "year_partitions": year_partitions, "bloom_file": bloom_file,
    "post_type_kept": lambda s, d: filtering.not_of_type(typed_turns(s, d), "kind", 1).select("id", "kind"),
    "cartesian_golden": cartesian_golden, "theta_join": theta_join, "state_counters": state_counters, "chain_counters": chain_counters, "named_outputs": named_outputs,
    "rekey": lambda s, d: R.keyed(event_rows(s, d), "UserId"), "anonymize_rows": lambda s, d: event_rows(s, d).select(R.anonymized_row(F.col("value")).alias("line")),
    "token_sets_side_file": token_sets_side_file, "kv_last_write": kv_last_write, "sample_invariants": sample_invariants, "generate_invariants": generate_invariants,
}

_MATCHED = "SELECT c_custkey, c_acctbal, o_orderkey, o_custkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey"


def _loose(how: str, more: str = "") -> str:
    return f"SELECT doc_id, quality, conv_id, turn, role FROM labels {how} JOIN conversations ON doc_id = conv_id{more}"


def _reduced(how: str, more: str = "") -> str:
    a = "(SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 8000) c"
    b = "(SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)) e"
    return f"SELECT c_custkey, c_acctbal, event_id, user_id, value FROM {a} {how} JOIN {b} ON c_custkey = user_id{more}"


_CHAIN = "WITH n AS (SELECT o_custkey AS \"user\", count(*) AS posts FROM orders GROUP BY 1) SELECT \"user\", posts, c_acctbal AS reputation, CASE WHEN posts < (SELECT sum(posts) / count(*) FROM n) THEN 'belowavg' ELSE 'aboveavg' END AS bin FROM n LEFT JOIN customer ON c_custkey = \"user\""

_TYPED = "SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS parent, (CASE WHEN turn = 0 THEN 1 WHEN turn > 1 THEN 2 END)::INT AS kind, role FROM conversations"
_BUCKETS = f"SELECT CASE WHEN coalesce(p_name, '') = '' THEN 'NullOrEmpty' ELSE coalesce(list_filter(string_split_regex(upper(p_name), '\\s'), lambda x: list_contains({list(SIZES)}, x))[1], 'Unknown') END AS bucket FROM part"
_ROW = "'<row Id=\"' || event_id || '\" UserId=\"' || user_id || '\" Kind=\"' || event_type || '\" CreationDate=\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '\" />'"

ORACLE_SQL = {
    "word_count": "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(replace(lower(\"text\"), '''', ''), '[^a-z]', ' ', 'g'), '[ \\t\\n\\r\\f]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1",
    "minmax_count": "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY 1",
    "avg_length_by_hour": "SELECT hour(ts)::INT AS key, count(*) AS n, avg(length(props)) AS average FROM events GROUP BY 1",
    "median_stddev": "SELECT hour(ts)::INT AS key, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS stddev FROM events GROUP BY 1",
    "median_stddev_hist": "SELECT hour(ts)::INT AS key, quantile_cont(length(props)::DOUBLE, 0.5) AS median, stddev_samp(length(props)) AS stddev FROM events GROUP BY 1",
    "first_match_bucket": f"SELECT CASE WHEN coalesce(p_name, '') = '' THEN 'NullOrEmpty' ELSE coalesce(list_filter(string_split_regex(upper(p_name), '\\s'), lambda x: list_contains({list(SIZES)}, x))[1], 'Unknown') END AS bucket, count(*) AS n FROM part GROUP BY 1",
    "inverted_index": "SELECT term, string_agg(page_id::VARCHAR, ' ' ORDER BY page_id) AS ids FROM (SELECT page_id, regexp_extract(html, 'href=\"([^\"#]*)', 1) AS term FROM pages) WHERE term <> '' GROUP BY 1",
    "grep": "SELECT doc_id FROM documents WHERE contains(\"text\", ' of the ')",
    "hot_words": "SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split_regex(\"text\", '[ \\t\\n\\r\\f]+')) AS w FROM documents) WHERE replace(w, '''', '') IN ('worthless', 'which', 'hein')",
    "top_ten": "SELECT c_acctbal, max(c_custkey) AS c_custkey FROM customer GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "distinct_users": "SELECT DISTINCT user_id FROM events",
    "unique_users": "SELECT count(DISTINCT user_id) AS total FROM events",
    "hot_user_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000)",
    "bloom_probe": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000)",
    "bloom_sizing": "SELECT n, p, floor(-n * ln(p) / pow(ln(2.0::DOUBLE), 2))::BIGINT AS m, round(floor(-n * ln(p) / pow(ln(2.0::DOUBLE), 2)) / n * ln(2.0::DOUBLE))::BIGINT AS k FROM (VALUES (1000::BIGINT, 0.01::DOUBLE), (100::BIGINT, 0.1::DOUBLE)) v(n, p)",
    "join_inner": _MATCHED, "join_left": _loose("LEFT"), "join_right": _loose("RIGHT"), "join_full": _loose("FULL"), "join_symmetric_anti": _loose("FULL", " WHERE doc_id IS NULL OR conv_id IS NULL"),
    "broadcast_inner": _MATCHED, "broadcast_left": _loose("RIGHT"), "bucketed_inner": _MATCHED, "bucketed_full": _loose("FULL"),
    "bloom_inner": _reduced("INNER"), "bloom_left": _reduced("LEFT"), "bloom_right": _reduced("RIGHT"), "bloom_full": _reduced("FULL"), "bloom_anti": _reduced("FULL", " WHERE c_custkey IS NULL OR user_id IS NULL"),
    "token_overlap_pairs": "WITH e AS (SELECT DISTINCT item_id AS id, w FROM (SELECT item_id, unnest(string_split_regex(\"text\", '\\s+')) AS w FROM benchmark) WHERE w <> '') SELECT l.id AS left_id, r.id AS right_id, count(*) AS shared FROM e l JOIN e r ON l.w = r.w AND l.id <> r.id GROUP BY 1, 2 HAVING count(*) >= 3",
    "token_sets": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(\"text\"), '[^a-z0-9\\s]', '', 'g'), '\\s'), lambda x: x NOT IN ('', 'the', 'of')))), ',') AS tokens FROM documents WHERE tokens <> ''",
    "raw_rows": "SELECT event_id, user_id, event_type FROM events",
    "hierarchy_nested": "SELECT o_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "question_answers": "WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS parent, turn FROM conversations) SELECT q.id AS id, string_agg(a.id::VARCHAR, ',' ORDER BY a.id) AS answers FROM c q LEFT JOIN (SELECT * FROM c WHERE turn <> 0) a ON a.parent = q.id WHERE q.turn = 0 GROUP BY q.id",
    "multi_bin": "SELECT p_partkey, 'steel' AS bin FROM part WHERE contains(lower(p_type), 'steel') UNION ALL SELECT p_partkey, 'brass' FROM part WHERE contains(lower(p_type), 'brass') UNION ALL SELECT p_partkey, 's' FROM part WHERE contains(lower(p_name), 's')",
    "anonymize": "SELECT strftime(ts, '%Y-%m-%d') AS ts, event_type, value, props FROM events",
    "job_chain_bins": _CHAIN,
    "job_control_avg": f"SELECT bin, avg(reputation) AS average FROM ({_CHAIN}) GROUP BY 1",
    "posts_per_reputation": "SELECT c_nationkey AS value, count(*) AS n, CASE WHEN c_nationkey < 12 THEN 'below' ELSE 'above' END AS bin FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 3",
    "month_pruned_read": "SELECT (month(o_orderdate) - 1)::INT AS month0, o_orderkey::VARCHAR AS field, o_orderpriority AS value FROM orders WHERE month(o_orderdate) IN (2, 3)",
    "kv_roundtrip": "SELECT c_custkey::VARCHAR AS field, c_mktsegment AS value FROM customer",
    "year_partition_counts": "SELECT (year(o_orderdate) - 1995)::INT AS pid, count(*) AS n FROM orders GROUP BY 1",
    "total_order": "SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem",
    "shuffle": "SELECT c_custkey, c_name FROM customer",
    "word_count_unescaped": "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(replace(lower(regexp_replace(html, '&(amp|middot|copy|quot);', ' ', 'g')), '''', ''), '[^a-z]', ' ', 'g'), ' +')) AS w FROM pages) WHERE w <> '' GROUP BY 1",
    "inverted_index_unescaped": "SELECT term, string_agg(page_id::VARCHAR, ' ' ORDER BY page_id) AS ids FROM (SELECT page_id, regexp_extract(replace(replace(html, '&quot;', '\"'), '&amp;', '&'), 'href=\"([^\"#]*)', 1) AS term FROM pages) WHERE term <> '' GROUP BY 1",
    "post_comment_xml": "SELECT '<post o_orderkey=\"' || o_orderkey || '\" o_orderstatus=\"' || o_orderstatus || '\"' || coalesce('>' || string_agg('<comments l_linenumber=\"' || l_linenumber || '\" l_returnflag=\"' || l_returnflag || '\"/>', '' ORDER BY l_linenumber, l_returnflag) || '</post>', '/>') AS xml FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus",
    "question_answer_xml": f"WITH c AS ({_TYPED}) SELECT '<question id=\"' || q.id || '\" role=\"' || q.role || '\"' || coalesce('>' || string_agg('<answer id=\"' || a.id || '\"' || coalesce(' kind=\"' || a.kind || '\"', '') || ' role=\"' || a.role || '\"/>', '' ORDER BY a.id) || '</question>', '/>') AS xml FROM c q LEFT JOIN (SELECT * FROM c WHERE kind IS DISTINCT FROM 1) a ON a.parent = q.id WHERE q.kind = 1 GROUP BY q.id, q.role",
    "year_partitions": "SELECT (CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN year(o_orderdate) - 1995 ELSE -1 END)::INT AS pid, o_orderkey FROM orders",
    "bloom_file": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 9000)",
    "post_type_kept": f"SELECT id, kind FROM ({_TYPED}) WHERE kind IS DISTINCT FROM 1",
    "cartesian_golden": "SELECT a.x AS left_line, b.x AS right_line FROM (SELECT 'A' || i || j AS x FROM range(1, 3) r(i), range(1, 5) q(j)) a, (SELECT 'B' || i || j AS x FROM range(1, 3) r(i), range(1, 5) q(j)) b",
    "theta_join": "SELECT s_suppkey, s_acctbal, n_nationkey FROM supplier JOIN nation ON s_acctbal < n_nationkey * 100",
    "state_counters": f"WITH b AS ({_BUCKETS}) SELECT c.counter, count(b.bucket) AS n FROM (SELECT unnest({[*SIZES, 'NullOrEmpty', 'Unknown']}) AS counter) c LEFT JOIN b ON b.bucket = c.counter GROUP BY 1",
    "chain_counters": "SELECT count(o_custkey) AS records, count(DISTINCT o_custkey) AS users FROM orders",
    "named_outputs": f"SELECT \"user\" || chr(9) || posts AS line, bin FROM ({_CHAIN})",
    "rekey": f"SELECT user_id::VARCHAR AS key, {_ROW} AS \"row\" FROM events",
    "anonymize_rows": "SELECT '<row Kind=\"' || event_type || '\" CreationDate=\"' || strftime(ts, '%Y-%m-%d') || '\" >' AS line FROM events",
    "kv_last_write": "SELECT user_id::VARCHAR AS field, arg_max(event_type, event_id) AS value FROM events GROUP BY 1",
    "sample_invariants": "SELECT 0::BIGINT AS \"foreign\", true AS near", "generate_invariants": "SELECT 1000::BIGINT AS n, 1000::BIGINT AS good",
    "merged_anon_distinct": "SELECT 'A' AS tag, event_type || ' ' || strftime(ts, '%Y-%m-%d') AS \"text\" FROM events UNION ALL SELECT 'D', user_id::VARCHAR FROM (SELECT DISTINCT user_id FROM events)",
}
ORACLE_SQL["token_sets_side_file"] = ORACLE_SQL["token_sets"]
