"""Queries of the smaller form rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmend.operators import forms as O
from quillmend.sources.tables import per_value, table


def routing(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_partkey") % 3 == 0, "text").when(c("p_partkey") % 3 == 1, "choice").otherwise("textarea").alias("kind"), F.when(c("p_partkey") % 5 == 0, "name").otherwise("").alias("pii"), F.when(c("p_partkey") % 7 == 0, "digits").otherwise("").alias("charset"), (c("p_partkey") % 11 == 0).alias("dated"), (c("p_size") / 50).alias("conf"), c("p_name").alias("v"))
    return p.select("p_partkey", O.reader_for(c("kind"), c("charset"), c("dated")).alias("reader"), O.wants_proofreading(c("kind"), c("pii"), c("charset"), c("dated"), F.lit(False), c("conf"), c("v")).alias("proofread"), O.provisional(c("conf"), c("dated")).alias("confidence"))


def asking(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_name").alias("raw"), (c("p_partkey") % 13 == 0).alias("empty"), F.array(F.struct((c("p_size") / 50).alias("score"), F.when(c("p_partkey") % 4 == 0, "llm").otherwise("dict").alias("source"))).alias("cands"), (c("p_partkey") % 10 / 10).alias("script"), (c("p_partkey") % 9 / 9).alias("conf"))
    return p.select("p_partkey", O.worth_asking(c("raw"), c("empty"), c("cands"), c("script"), c("conf")).alias("ask"))


def loose_inputs(spark, sf_dir):
    v = F.get(F.array(*map(F.lit, (" No", "TRUE", "0", "", "yes", "Off", "json", " JSON "))), F.col("c_custkey").cast("int") % 8)
    return table(spark, sf_dir, "customer").select("c_custkey", O.truthy(v).alias("truthy"), O.chosen_format(v).alias("format"), O.failed(F.array(F.when(F.col("c_custkey") % 5 == 0, "x 読み取れるページがありません").otherwise("fine")), F.when(F.col("c_custkey") % 7 > 0, "f")).alias("failed"))


def candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    empty = F.array().cast("array<string>")
    typed = F.when(F.col("p_partkey") % 2 == 0, F.split("p_name", " ")[0]).otherwise("")
    stored = F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_type"), F.col("p_brand"))).otherwise(empty)
    out = O.candidate_list(typed, F.array(F.split("p_name", " ")[0], F.col("p_name")), stored, F.array(F.lit("d1"), F.lit("d2")), F.col("p_brand"), 2)
    return p.select("p_partkey", F.array_join(out, "|").alias("offered"), F.array_join(O.by_preference(F.split("p_name", " "), ["ring", "small", "bolt"]), ",").alias("preferred"))


def fresh_keys(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return O.fresh(wanted, table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("k")), ["k"])


def option_expansion(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    options = F.array(*map(F.lit, ("small", "small ring", "ring", "red", "bolt", "hot", "gear")))
    return per_value(p, "p_name", {"options": F.array_join(O.expanded_options(F.col("p_name"), options).cast("array<string>"), ",")}).select("p_partkey", "options")


def compared_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "digits").otherwise("date").alias("kind"), F.concat(F.lit("平成"), F.date_format("o_orderdate", "d"), F.lit(" 日")).alias("t"))
    return o.select("o_orderkey", O.compared_form(F.col("t"), F.col("kind"), lambda c: c).alias("form"))


def addresses(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("〒"), F.lpad(F.col("c_custkey").cast("string"), 3, "0").substr(1, 3), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit(" x"), "c_name")).otherwise(F.col("c_name")).alias("a"), F.concat(F.lit("[令和 "), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit("年 8月 1日現在]")).alias("h"))
    return c.select("c_custkey", O.split_address(F.col("a")).alias("s"), O.as_of_date(F.col("h")).alias("as_of")).select("c_custkey", "s.postal", "s.address", "as_of")


def date_slots(spark, sf_dir):
    """Digits of order dates by position, with and without marks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yy").alias("y"), F.date_format("o_orderdate", "MM").alias("m"), F.date_format("o_orderdate", "dd").alias("d"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat("y", F.lit("年"), "m", F.lit("月"), "d", F.lit("日"))).when(F.col("o_orderkey") % 3 == 1, F.concat("y", F.lit(" "), "m", F.lit(" "), "d")).otherwise(F.concat(F.lit("元年"), F.lit("2024"), F.lit("月"), "d", F.lit("日")))
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.cast("double").alias("x0")))
    return o.select("o_orderkey", O.assigned_parts(chars, F.array().cast("array<double>")).alias("p")).select("o_orderkey", "p.year", "p.month", "p.day")


def value_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select("p_partkey", O.value_text(words, F.array(F.col("p_size") > 20, F.col("p_size") % 2 == 0), F.array(F.col("p_size") < 5, F.lit(False))).alias("text"))


def commit_areas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return O.areas_of_commits(li, "l_orderkey", "p_brand", [("Brand#2", "two"), ("Brand#1", "one")])


def reader_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws("\t", F.lit("5"), F.lit("1"), (F.col("user_id") % 3).cast("string"), F.lit("1"), F.col("user_id").cast("string"), F.lit("1"), F.col("event_id").cast("string"), F.lit("0"), F.lit("7"), F.lit("9"), F.col("value").cast("string"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))).alias("l"))
    return O.read_tokens(e, "l").select("event_id", "block", "line", "token", "x0", "x1", "confidence")


def aligned_rows(spark, sf_dir):
    """The parts of each brand with an even key against those with an odd one."""
    p = table(spark, sf_dir, "part")
    side = lambda odd: F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 2 == odd, F.struct("p_partkey", "p_size"))))
    rows = lambda c: F.transform(c, lambda x, i: F.struct((x["p_size"] % 5).cast("double").alias("n"), (i / F.size(c)).alias("m")))
    g = p.groupBy("p_brand").agg(side(0).alias("a"), side(1).alias("b"))
    return O.align_sequences(g.select("p_brand", rows(F.col("a")).alias("a"), rows(F.col("b")).alias("b")), "p_brand", "a", "b")


QUERIES = {f"form_{f.__name__}": f for f in (routing, asking, loose_inputs, candidates, fresh_keys, option_expansion, compared_forms, addresses, date_slots, value_texts, commit_areas, reader_tokens, aligned_rows)}

ORACLE_SQL = {
    "form_routing": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN 'lines' ELSE 'characters' END AS reader, p_partkey % 3 <> 1 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_size / 50 >= 0.7 AND length(p_name) >= 4 AS proofread,
        CASE WHEN p_partkey % 11 = 0 THEN round(p_size / 50 * 0.5, 3) ELSE p_size / 50 END AS confidence FROM part""",
    "form_asking": "SELECT p_partkey, p_partkey % 13 <> 0 AND p_partkey % 4 <> 0 AND p_size / 50 < 0.72 AND p_partkey % 10 >= 5 AND p_partkey % 9 / 9 < 0.72 AS ask FROM part",
    "form_loose_inputs": "SELECT c_custkey, c_custkey % 8 IN (1, 4, 6, 7) AS truthy, CASE WHEN c_custkey % 8 IN (6, 7) THEN 'json' ELSE 'markdown' END AS format, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS failed FROM customer",
    "form_candidates": """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part), q AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN w[1] ELSE '' END AS t, CASE WHEN p_partkey % 2 = 0 THEN [w[1], p_name] WHEN p_partkey % 3 = 0 THEN [p_type, p_brand] ELSE ['d1', 'd2'] END AS i FROM p)
        SELECT p_partkey, array_to_string(list_filter(CASE WHEN list_contains(i, p_brand) THEN i ELSE list_prepend(p_brand, i) END, lambda x: x <> t), '|') AS offered,
          (SELECT string_agg(x, ',' ORDER BY CASE x WHEN 'ring' THEN 1 WHEN 'small' THEN 2 WHEN 'bolt' THEN 3 ELSE 99 END, x) FROM (SELECT unnest(w) AS x)) AS preferred FROM q""",
    "form_fresh_keys": "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)",
    "form_option_expansion": """WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part), o AS (SELECT *, ['small', 'small ring', 'ring', 'red', 'bolt', 'hot', 'gear'] AS o FROM w)
        SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN '1' WHEN list_contains(o, w[1]) AND list_contains(o, w[2]) THEN array_to_string(list_sort([list_position(o, w[1]) - 1, list_position(o, w[2]) - 1]), ',') END AS options FROM o""",
    "form_compared_forms": "SELECT o_orderkey, day(o_orderdate)::VARCHAR AS form FROM orders",
    "form_addresses": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(CASE WHEN c_custkey < 1000 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END, 1, 3) || '-' || substr(CASE WHEN c_custkey < 10000 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END, 1, 4) ELSE '' END AS postal,
        CASE WHEN c_custkey % 2 = 0 THEN 'x' || c_name ELSE c_name END AS address, printf('%04d-08-01', 2018 + c_custkey % 9 + 1) AS as_of FROM customer""",
    "form_date_slots": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE year(o_orderdate) % 100 END::INT AS year, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE month(o_orderdate) END::INT AS month, day(o_orderdate)::INT AS day FROM orders""",
    "form_value_texts": """WITH w AS (SELECT *, string_split(p_name, ' ') AS w FROM part), t AS (SELECT *, concat_ws('、', CASE WHEN p_size > 20 THEN w[1] END, CASE WHEN p_size % 2 = 0 THEN w[2] END) AS p FROM w) SELECT p_partkey, CASE WHEN p = '' THEN '（印なし）' ELSE p END || CASE WHEN p_size < 5 THEN '　※二重線で消された印: ' || w[1] ELSE '' END AS text FROM t""",
    "form_commit_areas": """WITH a AS (SELECT l_orderkey, CASE WHEN starts_with(p_brand, 'Brand#2') THEN 0 WHEN starts_with(p_brand, 'Brand#1') THEN 1 ELSE 2 END AS i FROM lineitem JOIN part ON p_partkey = l_partkey), d AS (SELECT l_orderkey, count(*) AS files FROM a GROUP BY 1), s AS (SELECT DISTINCT l_orderkey, i FROM a)
        SELECT l_orderkey, string_agg(['two', 'one', 'other'][i + 1], ',' ORDER BY i) AS areas, max(files) AS files FROM s JOIN d USING (l_orderkey) GROUP BY 1""",
    "form_reader_tokens": "SELECT event_id, (user_id % 3)::INT AS block, user_id::INT AS line, event_type AS token, event_id::DOUBLE AS x0, event_id + 7.0::DOUBLE AS x1, value AS confidence FROM events WHERE event_type <> 'view'",
}
