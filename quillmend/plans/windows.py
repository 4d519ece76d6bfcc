"""Queries of windows, islands, folds and limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmend.operators import windows as O
from quillmend.sources.tables import table


def _readings(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.max("value") / 100, 4).alias("score"))
    return e.withColumn("checked", F.col("score") >= 0.35).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.45 + F.abs(F.col("score") - 0.5) * 1.1), 3))


_READ = "rd AS (SELECT user_id, event_type, round(max(value) / 100, 4) AS score, round(max(value) / 100, 4) >= 0.35 AS checked, round(least(1.0, 0.45 + abs(round(max(value) / 100, 4) - 0.5) * 1.1), 3) AS confidence FROM events GROUP BY 1, 2)"


def single_choice(spark, sf_dir):
    return O.single_choice(_readings(spark, sf_dir), "user_id", "event_type", "score", "checked", "confidence")


def resolve_strikes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    li = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), (F.col("q") > 10).alias("checked"), F.lit(1).alias("bands"), (F.col("q") / 10).cast("int").alias("all_bands"), (F.col("d") * 40).alias("len"))
    return O.resolve_strikes(li, "l_orderkey", "l_linenumber", "bands", "all_bands", "len", "checked")


def circled(spark, sf_dir):
    r = _readings(spark, sf_dir).withColumn("checked", F.col("score") > 5)
    return O.circled(r, "user_id", "event_type", "score", "checked", excess=0.02)


def best_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return O.best_page(o, ["o_custkey", "o_orderstatus"], "o_orderkey", "o_totalprice").select("o_orderkey", "kept")


def latest_snapshot(spark, sf_dir):
    return O.latest_snapshot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


def dedupe_first(spark, sf_dir):
    return O.first_of(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderkey")


def merged_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    return O.merged_coordinates(s, "c_nationkey", "c_acctbal", 60.0)


def intervals(spark, sf_dir):
    return O.intervals(table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal", 100.0)


def runs_above(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return O.runs_above(e, "user_id", "n", "value", 8.0, shortest=2)


def clusters_with_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    return O.runs_above(e, "user_id", "n", "value", 15.0, shortest=3, gap=3)


def anchored_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.lit(2500.0).alias("h"))
    return O.anchored_rows(s, "s_nationkey", "s_acctbal", "h", "s_suppkey")


def pair_splitter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return O.split_pairs(e, "user_id", "event_id", F.col("event_type") == "purchase").select("event_id", "group")


def record_splitter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 5 + 1).alias("page"))
    return O.split_records(e, "user_id", "event_id", "page")


def reading_order(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("top"), (F.col("p_partkey") * 37 % 1001).alias("left"), F.col("p_size").cast("double").alias("h"))
    return O.reading_order(s, "p_brand", "top", "left", "h", "p_partkey").select("p_partkey", "position")


def next_to_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return O.next_to_check(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "next")


def texts_after_marks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.substring("event_type", 1, 1).alias("ch"), (F.col("event_id") / 100.0).alias("x"))
    return O.texts_after_marks(e, "user_id", "event_id", "ch", "p", "x", 3.0, 23)


def debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts"), F.col("event_id").alias("before"), F.col("value").alias("after"))
    e = e.select("user_id", "event_type", "ts", F.lpad(F.col("before").cast("string"), 8, "0").alias("before"), F.col("after").cast("string").alias("after"))
    return O.debounce(e, ["user_id", "event_type"], "ts", "before", "after", 7200.0).select("user_id", "event_type", "before", "after", "edits")


def retention(spark, sf_dir):
    return O.retain(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id")


def first_seen(spark, sf_dir):
    return O.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


def separators_to_slots(spark, sf_dir):
    """Slots between marks that stand where a supplier's lines were shipped and are as wide as their quantity."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.min("l_quantity").alias("w")).select("l_suppkey", F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).alias("x"), "w")
    return O.slots_between(o.withColumn("end", F.col("x") + F.col("w")), ["l_suppkey"], "x", "end")


def recent_events(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id")


def status_look_ahead(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = F.lead("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(nxt, F.lit("end")).alias("next_role"))


def field_order(spark, sf_dir):
    """Order priorities as fields of each customer's form, placed by status, price and key; priorities that a customer lacks come last."""
    places = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("form"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("page"), F.floor(F.col("o_totalprice") / 1000).alias("y"), F.col("o_orderkey").alias("x"))
    definition = spark.sql("SELECT * FROM VALUES ('1-URGENT', 4), ('2-HIGH', 2), ('3-MEDIUM', 5), ('4-NOT SPECIFIED', 1), ('5-LOW', 3) AS t(field, ordinal)")
    return O.fields_in_order(places, F.broadcast(definition), "form")


QUERIES = {f"win_{f.__name__}": f for f in (single_choice, resolve_strikes, circled, best_page, latest_snapshot, dedupe_first, merged_coordinates, intervals, runs_above, clusters_with_gap, anchored_rows, pair_splitter, record_splitter, reading_order, next_to_check, texts_after_marks, debounce, retention, first_seen, separators_to_slots, recent_events, status_look_ahead, field_order)}

_N = "n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
ORACLE_SQL = {
    "win_single_choice": f"""WITH {_READ}, r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS s2 FROM rd WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_type))
        SELECT user_id, CASE WHEN checked THEN event_type END AS picked, CASE WHEN checked THEN least(confidence, round(least(1.0, 0.35 + (score - s2) * 0.65), 3)) ELSE confidence END AS confidence FROM r WHERE k = 1""",
    "win_resolve_strikes": """WITH RECURSIVE g AS (SELECT l_orderkey AS k, l_linenumber AS o, max(l_quantity) > 10 AS c, max(l_quantity) > 10 AND (max(l_quantity) / 10)::DOUBLE >= 2 AS can, max(l_discount) * 40 AS len FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS i, count(*) FILTER (c) OVER (PARTITION BY k) AS total FROM g),
        f AS (SELECT k, o, i, c, can AND len >= CASE WHEN total > 1 THEN 1.8 ELSE 2.2 END AS struck, total - (can AND len >= CASE WHEN total > 1 THEN 1.8 ELSE 2.2 END)::INT AS rest FROM m WHERE i = 1
              UNION ALL SELECT m.k, m.o, m.i, m.c, m.can AND m.len >= CASE WHEN f.rest > 1 THEN 1.8 ELSE 2.2 END, f.rest - (m.can AND m.len >= CASE WHEN f.rest > 1 THEN 1.8 ELSE 2.2 END)::INT FROM f JOIN m ON m.k = f.k AND m.i = f.i + 1)
        SELECT k AS l_orderkey, o::BIGINT AS l_linenumber, struck, c AND NOT struck AS still_checked FROM f""",
    "win_circled": f"""WITH {_READ}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS u, count(*) OVER (PARTITION BY user_id) AS n FROM rd),
        g AS (SELECT user_id, max(n) AS n, bool_or(score > 5) AS a, max(event_type) FILTER (k = 1) AS event_type, max(score) AS b, max(score) FILTER (k = 2) AS s, max(score) FILTER (u = n // 2 + 1) AS m FROM r GROUP BY 1)
        SELECT user_id, event_type, round(least(0.85, 0.40 + (b - greatest(m, s)) / 0.12 * 0.45), 3) AS confidence FROM g WHERE n >= 2 AND NOT a AND b - m - 0.02 >= -1e-12 AND b - s - 0.01 >= -1e-12""",
    "win_best_page": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1 AS kept FROM orders",
    "win_latest_snapshot": "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1",
    "win_dedupe_first": "SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1",
    "win_merged_coordinates": """WITH b AS (SELECT *, coalesce((c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) > 60)::INT, 1) AS b FROM customer), i AS (SELECT c_nationkey, c_acctbal, sum(b) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM b)
        SELECT c_nationkey, island, round(avg(c_acctbal), 6) AS centre, count(*) AS n FROM i GROUP BY 1, 2""",
    "win_intervals": "SELECT s_nationkey, low, high FROM (SELECT s_nationkey, s_acctbal AS low, lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS high FROM supplier) WHERE high - low >= 100",
    "win_runs_above": f"""WITH {_N}, b AS (SELECT *, coalesce((n - lag(n) OVER (PARTITION BY user_id ORDER BY n) > 1)::INT, 1) AS b FROM n WHERE value >= 8), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY n)::BIGINT AS run FROM b)
        SELECT user_id, run, min(n)::INT AS first, max(n)::INT AS last, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 2""",
    "win_clusters_with_gap": f"""WITH {_N}, b AS (SELECT *, coalesce((n - lag(n) OVER (PARTITION BY user_id ORDER BY n) > 3)::INT, 1) AS b FROM n WHERE value >= 15), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY n)::BIGINT AS run FROM b)
        SELECT user_id, run, min(n)::INT AS first, max(n)::INT AS last, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 3""",
    "win_anchored_rows": """WITH RECURSIVE m AS (SELECT s_nationkey AS k, s_suppkey AS i, s_acctbal AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n FROM supplier),
        f AS (SELECT k, i, n, y AS anchor, 1 AS row FROM m WHERE n = 1 UNION ALL SELECT m.k, m.i, m.n, CASE WHEN m.y - f.anchor > 1500 THEN m.y ELSE f.anchor END, f.row + (m.y - f.anchor > 1500)::INT FROM f JOIN m ON m.k = f.k AND m.n = f.n + 1)
        SELECT k AS s_nationkey, i AS s_suppkey, row FROM f""",
    "win_pair_splitter": """WITH a AS (SELECT *, event_type = 'purchase' AS a, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events), b AS (SELECT *, (a OR row_number() OVER (PARTITION BY user_id, s, a ORDER BY event_id) % 2 = 1)::INT AS n FROM a)
        SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS "group" FROM b""",
    "win_record_splitter": """WITH RECURSIVE m AS (SELECT user_id, event_id, event_id * 7 % 5 + 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        f AS (SELECT user_id, event_id, n, [p] AS seen, 1 AS record FROM m WHERE n = 1 UNION ALL SELECT m.user_id, m.event_id, m.n, CASE WHEN m.p = 1 OR list_contains(f.seen, m.p) THEN [m.p] ELSE list_append(f.seen, m.p) END, f.record + (m.p = 1 OR list_contains(f.seen, m.p))::INT FROM f JOIN m ON m.user_id = f.user_id AND m.n = f.n + 1)
        SELECT user_id, event_id, record FROM f""",
    "win_reading_order": """WITH m AS (SELECT p_brand, quantile_disc(p_size::DOUBLE, 0.5) AS med FROM part GROUP BY 1) SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / (med * 0.7)), p_partkey * 37 % 1001, p_retailprice)::INT AS position FROM part JOIN m USING (p_brand)""",
    "win_next_to_check": """SELECT o_orderkey, coalesce(min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey)) AS next FROM orders""",
    "win_texts_after_marks": """WITH e AS (SELECT user_id, event_id, substr(event_type, 1, 1) AS ch, event_id / 100.0 - lag(event_id / 100.0) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
        i AS (SELECT *, sum((ch = 'p' OR gap IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS raw, first_value(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM e),
        j AS (SELECT *, sum((ch = 'p')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM i),
        s AS (SELECT *, max((coalesce(gap, 0) > 3 AND ch <> 'p')::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS shut, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM j)
        SELECT user_id, island, string_agg(ch, '' ORDER BY event_id) AS text FROM s WHERE shut = 0 AND ch <> 'p' AND n <= 24 GROUP BY 1, 2""",
    "win_debounce": """WITH e AS (SELECT user_id, event_type, ts, lpad(event_id::VARCHAR, 8, '0') AS b, value::VARCHAR AS a FROM events),
        g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, b)) >= 7200000000)::INT, 1) AS x FROM e), i AS (SELECT *, sum(x) OVER (PARTITION BY user_id, event_type ORDER BY ts, b) AS k FROM g)
        SELECT user_id, event_type, first(b ORDER BY ts, b) AS before, last(a ORDER BY ts, b) AS after, count(*) AS edits FROM i GROUP BY user_id, event_type, k""",
    "win_retention": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30",
    "win_first_seen": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "win_separators_to_slots": """WITH o AS (SELECT l_suppkey, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS x, min(l_quantity) AS w FROM lineitem GROUP BY l_suppkey, l_shipdate), l AS (SELECT *, coalesce(lag(x + w) OVER (PARTITION BY l_suppkey ORDER BY x), 0) AS l FROM o)
        SELECT l_suppkey, round(l + (x - l) * 0.12, 2) AS low, round(x - (x - l) * 0.12, 2) AS high FROM l WHERE x - l >= 20""",
    "win_recent_events": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "win_status_look_ahead": "SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'end') AS next_role FROM conversations",
    "win_field_order": """WITH f AS (SELECT * FROM (VALUES ('1-URGENT', 4), ('2-HIGH', 2), ('3-MEDIUM', 5), ('4-NOT SPECIFIED', 1), ('5-LOW', 3)) AS t(field, ordinal)), p AS (SELECT o_custkey AS form, o_orderpriority AS field, min(struct_pack(page := o_orderstatus, y := floor(o_totalprice / 1000)::BIGINT, x := o_orderkey)) AS p FROM orders GROUP BY 1, 2)
        SELECT g.form, f.field, row_number() OVER (PARTITION BY g.form ORDER BY p NULLS LAST, ordinal)::INT AS position FROM (SELECT DISTINCT o_custkey AS form FROM orders) g CROSS JOIN f LEFT JOIN p ON p.form = g.form AND p.field = f.field""",
}
