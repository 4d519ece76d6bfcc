"""Queries of aggregates, evaluation and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmend.operators import evaluation as E
from quillmend.sources.tables import dealt, table


def weighted_vote(spark, sf_dir):
    return E.weighted_vote(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


def level_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("level", F.when(F.col("o_totalprice") >= 400000, "high").when(F.col("o_totalprice") >= 200000, "medium").otherwise("low"))
    return E.level_counts(o, "o_custkey", "level")


def confusion(spark, sf_dir):
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.confusion(l, ["lang"], F.col("quality") == 1, F.col("toxic") == 0)


def part_outcomes(spark, sf_dir):
    """Year and month of ship date against a shifted reading."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("truth"), F.when(F.col("l_linenumber") == 7, None).otherwise(F.year("l_shipdate") + (F.col("l_suppkey") % 9 == 0).cast("int")).alias("read"))
    return E.outcomes(li, ["l_returnflag"], F.col("truth"), F.col("read"))


def agreement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").substr(1, 1).alias("truth"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority").substr(1, 1)).otherwise("9").alias("a"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority").substr(1, 1)).alias("b"))
    return E.agreement(o, ["o_orderstatus"], "truth", "a", "b")


def engine_gap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return E.engine_gap(li, "l_returnflag", "l_linestatus", "l_discount", baseline="F", others=["O"])


def uplift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_tax").alias("before"), F.col("l_discount").alias("after"))
    return E.uplift(li, ["l_returnflag"], "before", "after")


def grouping_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return E.buckets(d, "lang", "source", F.col("quality"))


def edit_summary(spark, sf_dir):
    return E.edit_summary(table(spark, sf_dir, "events"), "event_type", "user_id", "value", top=8)


def area_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return E.prefix_rollup(li, "p_brand", [("Brand#1", "ones"), ("Brand#2", "twos")], "other", "l_quantity", "l_orderkey")


def latest_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("string").alias("as_of"))


def route_table(spark, sf_dir):
    return E.routes(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", shown=6)


def stratified(spark, sf_dir):
    return E.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 12)


def train_test(spark, sf_dir):
    return E.train_test(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.7)


def multi_choice(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("checked", F.col("value") > 5).groupBy("user_id", "event_type").agg(F.max("checked").alias("checked"), F.round(F.max("value") / 100, 3).alias("confidence"))
    return E.multi_choice(e, "user_id", "event_type", "event_type", "checked", "confidence").withColumn("picked", F.array_join("picked", ","))


def ensemble_pick(spark, sf_dir):
    return E.first_best(table(spark, sf_dir, "events"), "user_id", "value", "event_id", "event_type")


def token_lines(spark, sf_dir):
    """Rebuild the lines of documents from their words.

    Documents are dealt out by the key of both groupings before they become words, so that no word is shuffled, and few enough to a task that its words are put in order in memory.
    """
    w = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 2000).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).select("doc_id", "line", F.posexplode(F.split("l", " ")).alias("ord", "token"))
    return E.rebuild_lines(w.withColumn("confidence", F.length("token") / 10.0), ["doc_id"], "line", "ord", "token", "confidence").select("doc_id", F.md5("text").alias("text_md5"), "lines", F.round("confidence", 4).alias("confidence"))


def distinct_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])), ",").alias("seen"))


def best_of_two(spark, sf_dir):
    """The better of two readings by confidence, and the whole line only if it is much longer and sure."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"), (F.col("p_size") / 50).alias("ca"), (F.col("p_retailprice") / 1000 % 1).alias("cb"))
    return p.select("p_partkey", F.when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("best"), F.when((F.col("a") == "") | ((F.length("b") >= F.length("a") + 3) & (F.col("cb") >= 0.5)), F.col("b")).otherwise(F.col("a")).alias("line"))


def worst_fields(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("mean", "l_suppkey").limit(15)


def most_changed(spark, sf_dir):
    """The 15 users with most events, and the rest as one row."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "user_id"))  # one row per user, after aggregation
    top = n.withColumn("r", rank)
    return top.groupBy(F.when(F.col("r") <= 15, F.col("user_id")).alias("user_id")).agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"))


def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).filter("k < 12")
    tag = lambda d, n: d.distinct().withColumn("op", F.lit(n))
    return tag(c.union(s), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(c.subtract(s), "except"))


def missing_members(spark, sf_dir):
    """Expected event types that a user never had."""
    e = table(spark, sf_dir, "events").filter("user_id % 3 = 0 or event_type <> 'purchase'")
    have = e.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    want = F.array(*map(F.lit, ("click", "error", "purchase", "refund", "signup", "view")))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(want, "have")), ",").alias("missing"))


QUERIES = {f"agg_{f.__name__}": f for f in (weighted_vote, level_counts, confusion, part_outcomes, agreement, engine_gap, uplift, grouping_buckets, edit_summary, area_rollup, latest_rollup, route_table, stratified, train_test, multi_choice, ensemble_pick, token_lines, distinct_in_order, best_of_two, worst_fields, most_changed, set_operations, missing_members)}

ORACLE_SQL = {
    "agg_weighted_vote": """WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k FROM s)
        SELECT user_id, event_type AS winner, score FROM r WHERE k = 1""",
    "agg_level_counts": """WITH o AS (SELECT o_custkey, CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 200000 THEN 'medium' ELSE 'low' END AS level FROM orders)
        SELECT o_custkey, count(*) AS total, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, arg_min(level, CASE level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS worst FROM o GROUP BY 1""",
    "agg_confusion": """WITH l AS (SELECT lang, quality = 1 AS t, toxic = 0 AS p FROM labels JOIN documents USING (doc_id)),
        c AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) AS n FROM l GROUP BY 1)
        SELECT lang, tp, fp, fn, tn, round((tp + tn) / n::DOUBLE, 4) AS accuracy, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision FROM c""",
    "agg_part_outcomes": """WITH l AS (SELECT l_returnflag, year(l_shipdate) AS t, CASE WHEN l_linenumber = 7 THEN NULL ELSE year(l_shipdate) + (l_suppkey % 9 = 0)::INT END AS r FROM lineitem),
        o AS (SELECT l_returnflag, CASE WHEN t IS NULL AND r IS NULL THEN 'blank' WHEN t IS NULL THEN 'extra' WHEN r IS NULL THEN 'missing' WHEN t = r THEN 'correct' ELSE 'wrong' END AS k FROM l)
        SELECT l_returnflag, count(*) FILTER (k = 'correct') AS correct, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'wrong') AS wrong, count(*) FILTER (k = 'extra') AS extra, count(*) FILTER (k = 'blank') AS blank FROM o GROUP BY 1""",
    "agg_agreement": """WITH o AS (SELECT o_orderstatus, substr(o_orderpriority, 1, 1) AS t, CASE WHEN o_orderkey % 4 <> 0 THEN substr(o_orderpriority, 1, 1) ELSE '9' END AS a, CASE WHEN o_custkey % 3 <> 0 THEN substr(o_orderpriority, 1, 1) ELSE '' END AS b FROM orders)
        SELECT o_orderstatus, count(*) FILTER (a = b AND a <> '') AS agree, count(*) FILTER (a = b AND a <> '' AND a = t) AS agree_right, count(*) FILTER (a <> b AND a <> '' AND b <> '') AS differ, count(*) FILTER (a <> b AND a <> '' AND b <> '' AND a = t) AS differ_first_right, count(*) FILTER (a <> b AND a <> '' AND b <> '' AND b = t) AS differ_second_right, count(*) FILTER ((a = '') <> (b = '')) AS one_empty FROM o GROUP BY 1""",
    "agg_engine_gap": """WITH m AS (SELECT l_returnflag, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS f, round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1) SELECT l_returnflag, f AS baseline, o AS best, round(o - f, 6) AS gap FROM m""",
    "agg_uplift": """SELECT l_returnflag, round(avg(l_tax), 4) AS before, round(avg(l_discount), 4) AS after, count(*) FILTER (l_discount > l_tax) AS better, count(*) FILTER (l_discount < l_tax) AS worse, count(*) FILTER (l_discount = l_tax) AS same FROM lineitem GROUP BY 1""",
    "agg_grouping_buckets": """SELECT lang AS kind, source AS axis, grouping(lang) * 2 + grouping(source) AS bucket, count(quality) AS n, round(sum(quality), 4) AS total, round(avg(quality), 4) AS ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source), (source))""",
    "agg_edit_summary": """WITH t AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, user_id LIMIT 8)
        SELECT count(*) AS actions, count(*) FILTER (event_type = 'click') AS edits, count(*) FILTER (event_type = 'error') AS errors, round(sum(value) FILTER (event_type = 'click'), 2) AS amount, (SELECT string_agg(user_id || ':' || n, ',' ORDER BY n DESC, user_id) FROM t) AS most_edited FROM events""",
    "agg_area_rollup": """SELECT CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'ones' WHEN starts_with(p_brand, 'Brand#2') THEN 'twos' ELSE 'other' END AS area, round(sum(l_quantity), 2) AS amount, count(DISTINCT l_orderkey) AS files FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    "agg_latest_rollup": "SELECT o_custkey, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS as_of FROM orders GROUP BY 1",
    "agg_route_table": """WITH s AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT user_id, string_agg(event_type, ' → ' ORDER BY f) AS route FROM s GROUP BY 1),
        g AS (SELECT route, count(*) AS n, list(user_id ORDER BY user_id) AS u FROM r GROUP BY 1) SELECT route, n, array_to_string(u[1:6], ',') || CASE WHEN n > 6 THEN ' +' || (n - 6) ELSE '' END AS fields FROM g""",
    "agg_stratified": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 12",
    "agg_train_test": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= greatest(1, floor(count(*) OVER () * 0.7)) AS train FROM documents",
    "agg_multi_choice": """WITH e AS (SELECT user_id, event_type, max(value > 5) AS c, round(max(value) / 100, 3) AS f FROM events GROUP BY 1, 2) SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (c), '') AS picked, min(f) AS confidence FROM e GROUP BY 1""",
    "agg_ensemble_pick": "SELECT user_id, event_type AS picked, value AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1",
    "agg_token_lines": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents),
        w AS (SELECT doc_id, i, unnest(string_split(l, ' ')) AS t FROM l), m AS (SELECT doc_id, i, ((sum(length(t)) / 10)::DOUBLE / count(*))::DECIMAL(18, 9) AS c FROM w GROUP BY 1, 2), g AS (SELECT doc_id, md5(string_agg(l, chr(10) ORDER BY i)) AS text_md5, count(*) AS lines FROM l GROUP BY 1)
        SELECT doc_id, text_md5, lines, round(sum(c)::DOUBLE / count(*), 4) AS confidence FROM g JOIN m USING (doc_id) GROUP BY ALL""",
    "agg_distinct_in_order": "WITH s AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS seen FROM s GROUP BY 1",
    "agg_best_of_two": "SELECT p_partkey, CASE WHEN p_size / 50.0 >= p_retailprice / 1000 % 1 THEN p_name ELSE p_type END AS best, CASE WHEN p_name = '' OR (length(p_type) >= length(p_name) + 3 AND p_retailprice / 1000 % 1 >= 0.5) THEN p_type ELSE p_name END AS line FROM part",
    "agg_worst_fields": "SELECT l_suppkey, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY mean, l_suppkey LIMIT 15",
    "agg_most_changed": "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS r FROM n) SELECT CASE WHEN r <= 15 THEN user_id END AS user_id, sum(n)::BIGINT AS events, count(*) AS users FROM r GROUP BY 1",
    "agg_set_operations": """WITH s AS (SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 12), c AS (SELECT c_nationkey AS k FROM customer)
        SELECT k, 'union' AS op FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT k, 'except' FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""",
    "agg_missing_members": """WITH h AS (SELECT user_id, list_distinct(list(event_type)) AS h FROM events WHERE user_id % 3 = 0 OR event_type <> 'purchase' GROUP BY 1) SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase', 'refund', 'signup', 'view'], lambda x: NOT list_contains(h, x)), ',') AS missing FROM h""",
}
