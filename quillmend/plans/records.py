"""Queries of records, dates, mining and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmend.functions import dates as D
from quillmend.operators import mining as N
from quillmend.operators import records as R
from quillmend.sources import records as Q
from quillmend.sources.tables import table

ERA_OF = "CASE WHEN year(d) >= 2019 THEN '令和' WHEN year(d) >= 1989 THEN '平成' ELSE '昭和' END"


def parse_dates(spark, sf_dir):
    """Order dates written in tolerant forms, parsed again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    y, m, d = F.year("d") - 1988, F.month("d"), F.dayofmonth("d")
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("平成"), y.cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))).when(k == 1, F.concat(F.lit("H "), y.cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"))).when(k == 2, F.concat(y.cast("string"), F.lit("日年"), m.cast("string"), F.lit("月"), d.cast("string"))).when(k == 3, F.concat_ws("/", y.cast("string"), m.cast("string"), d.cast("string"))).when(k == 4, F.concat(F.lit("平"), y.cast("string"), F.lit("年13月"), d.cast("string"), F.lit("日"))).otherwise("元年5月")
    e = D.enrich(text, F.lit("平成"))
    return o.select("o_orderkey", text.alias("raw"), e.alias("e")).select("o_orderkey", "raw", "e.era", "e.year", "e.month", "e.day", "e.text", "e.gregorian")


def ages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.format_string("%04d-%02d-%02d", (F.col("o_custkey") % 90 + 1900).cast("int"), (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_custkey") % 31 + 1).cast("int")).alias("birth"), (F.col("o_orderkey") % 100).cast("int").alias("stated"))
    return o.select("o_orderkey", D.age(F.col("birth"), F.col("at")).alias("age"), D.age_agrees(F.col("birth"), F.col("at"), F.col("stated")).alias("agrees"), D.full_date(F.col("birth")).isNotNull().alias("real"))


def slot_confidences(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(F.when(F.col("p_size") > 10, F.col("p_size")), F.when(F.col("p_partkey") % 3 > 0, F.lit(1)), F.when(F.col("p_partkey") % 7 > 2, F.lit(2))).alias("parts"), F.array(F.lit(0.9), F.lit(0.7), F.lit(0.4)).alias("c"), F.array(F.col("p_partkey") % 2 == 0, F.lit(False), F.col("p_partkey") % 5 == 0).alias("ink"))
    return p.select("p_partkey", D.slot_confidence(F.col("parts"), F.col("c"), F.col("ink")).alias("confidence"), D.merge_readings(F.col("parts")[0], F.lit(50) - F.col("parts")[0], 1, 31).alias("merged"))


def _entries(spark, sf_dir):
    """Conversation turns as entries: the role is the field."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc"), F.col("role").alias("field")).agg(F.min_by(F.regexp_extract("text", r"^(\S*)", 1), "turn").alias("v_text"), F.round(F.count(F.lit(1)) / 10, 2).alias("confidence"))


_E = "e AS (SELECT conv_id AS doc, role AS field, regexp_extract(arg_min(text, turn), '^(\\S*)', 1) AS v_text, round(count(*) / 10, 2) AS confidence FROM conversations GROUP BY 1, 2)"


def completed(spark, sf_dir):
    e = _entries(spark, sf_dir)
    definition = spark.sql("SELECT * FROM VALUES ('user', 1), ('assistant', 2), ('system', 3), ('tool', 4) AS t(field, ordinal)")
    return R.complete(e, e, definition).select("doc", "field", "ordinal", "v_text", "confidence", "level")


def era_fields(spark, sf_dir):
    e = _entries(spark, sf_dir)
    definition = spark.sql("SELECT * FROM VALUES ('user', 'system', '令和'), ('assistant', 'user', '') AS t(field, era_field, default_era)")
    return R.with_era(e, definition).select("doc", "field", "era")


def resolved_words(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("expected"), F.max("p_name").alias("last"))
    first = p.select("p_brand", F.when(F.col("p_brand").rlike("[13579]$"), F.col("last")).otherwise(F.col("expected")).alias("read"))
    second = p.filter("p_brand <> 'Brand#4'").select("p_brand", F.when(F.col("p_brand").rlike("[1-5]$"), F.col("last")).otherwise(F.lit("")).alias("read"))
    readings = R.combined_readings(first, second, ["p_brand"])
    overrides = spark.sql("SELECT * FROM VALUES ('Brand#3', 'fixed word'), ('Brand#99', 'none') AS t(p_brand, override)")
    return R.resolved_words(p.select("p_brand", "expected"), overrides, readings, ["p_brand"])


def answered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("v"), F.max("o_orderstatus").alias("t"))
    options = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW"))
    words = F.array(R.decorate(F.lit("urgent"), F.col("t")), R.decorate(F.lit("その他（高）"), F.col("t")), R.decorate(F.lit("low"), F.lit("")))
    return o.select("o_custkey", F.array_join(R.answers(F.col("v"), options, words), "|").alias("answer"), R.flat_value(F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.col("v")).alias("flat"))


def anonymised(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("pii", F.when(F.col("field") == "system", "name").when(F.col("field") == "assistant", "mask").otherwise("")).withColumn("is_text", F.lit(True)).withColumn("raw", F.col("v_text")).withColumn("candidates", F.array("v_text")).withColumn("trace", F.array("v_text"))
    e = e.withColumn("v_text", F.when((F.col("field") == "system") & (F.col("doc") % 2 == 0), "").otherwise(F.col("v_text")))
    flags = R.looks_anonymised(e)
    out = R.anonymise(e.join(flags.withColumnRenamed("anonymised", "auto"), "doc"), F.col("auto"))
    return out.select("doc", "field", "v_text", "raw", "confidence", "anonymised", F.size(F.coalesce("candidates", F.array())).alias("candidates"))


def traces(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    step = F.struct("event_id", F.struct(F.col("event_type").alias("step"), F.when(F.col("user_id") % 2 == 0, F.col("value").cast("string")).alias("detail"), F.when(F.col("event_type") == "click", "a").alias("before"), F.when(F.col("event_type") == "click", "b").alias("after")).alias("s"))
    t = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("trace"))
    return t.select("user_id", R.trace_summary(F.col("trace")).alias("summary"), F.md5(F.array_join(R.trace_lines(F.col("trace")), "\n")).alias("lines_md5"), R.engine_of(F.col("trace"), ["click", "view"]).alias("engine"))


def drift(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("row"), F.array_sort(F.collect_set("p_type")).alias("types"))
    opts = F.array(F.lit("small ring"), F.lit("red bolt"), F.lit("hot gear"), F.lit("old anvil"))
    d = R.form_drift(F.col("row"), opts, F.transform("types", F.lower), F.array(F.lit("small"), F.lit("promotion")), lambda c: F.regexp_replace(c, r"\s+", ""))
    return p.select("p_brand", d.alias("d")).select("p_brand", F.array_join("d.found", ",").alias("found"), F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"), R.drift_reported(F.col("d")).alias("reported"))


def confirmed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("confirmed"))
    return R.confirm(o, F.col("o_orderkey") % 2 == 0).groupBy("o_custkey").agg(F.count_if("confirmed").alias("confirmed"), F.count_if("newly").alias("newly"))


def suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value"), F.when(F.col("p_size") > 25, F.lower("p_type")).alias("suggestion"), F.array(F.lit("x")).alias("candidates"), (F.col("p_size") / 60).alias("confidence"))
    out = R.adopt_suggestion(p, "value", "suggestion", F.col("p_partkey") % 3 > 0)
    return out.select("p_partkey", "value", F.array_join("candidates", ",").alias("candidates"), F.round("confidence", 4).alias("confidence"), "applied")


def values_json(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("value", F.col("v_text"))
    return Q.from_records_json(Q.records_json(e))


def csv_export(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("value", F.col("v_text"))
    return Q.csv_table(e, ["user", "assistant"], {"user": "人", "assistant": "機械"})


def markdown_export(spark, sf_dir):
    e = _entries(spark, sf_dir).select("doc", F.lit("S").alias("section"), F.lit(1).alias("section_no"), F.length("field").alias("ordinal"), F.col("field").alias("label"), F.col("v_text").alias("value"), F.when(F.col("confidence") >= 0.3, "high").otherwise("low").alias("level"))
    return Q.markdown(e).select("doc", F.md5("markdown").alias("md5"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"), "props")
    return e.select("event_id", F.element_at("m", F.lit("k")).alias("k"), F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("v"))


def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return Q.links(p, "page_id", "html", "th|list", "ad").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.sum("score").cast("bigint").alias("score"))


def reachable_pages(spark, sf_dir):
    """Pages within two links of page 0, the first 40 of them; where a link leads follows from its page and length."""
    l = Q.links(table(spark, sf_dir, "pages"), "page_id", "html", "th", "ad")
    to = (F.col("page_id") * 7 + F.length("href")) % 1009
    return Q.reachable(l.select(F.col("page_id").cast("string").alias("src"), to.cast("string").alias("dst")).distinct(), spark.sql("SELECT '0' AS node"), 2, 40)


def mined_fixes(spark, sf_dir):
    """Changes between lines and a copy with confused letters, where one target is clear."""
    lines = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("truth"), F.regexp_replace(F.translate("p_name", "g", "q"), "ri", "re").alias("read"))
    return N.mined_fixes(N.diff_pairs(lines, "p_partkey", "truth", "read"), 5)


def clear_targets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("wrong"), "p_type").withColumn("right", F.col("p_type"))
    return N.mined_fixes(p.select("wrong", "right"), 5)


def generated_fixes(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    confusions = spark.sql("SELECT * FROM VALUES ('0', 'o'), ('1', 'l'), ('c', 'e'), ('q', 'g'), ('d', 't'), ('o', 'e'), ('h', 'b') AS t(bad, good)")
    made = N.generated_fixes(words, confusions)
    written = spark.sql("SELECT * FROM VALUES ('b1ue', 'BLUE'), ('zz', 'z') AS t(wrong, right)")
    return N.merged_fixes(made, written)


def real_words(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    fixes = spark.sql("SELECT * FROM VALUES ('bolt', 'volt'), ('xbolty', 'z'), ('d ri', 'z'), ('qqq', 'ggg'), ('rin', 'run') AS t(wrong, right)")
    return N.real_words_removed(fixes, words, table(spark, sf_dir, "part").select("p_name"), "p_name")


def dictionary_build(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return N.dictionary_build(p, "p_name", F.col("p_size") > 48)


def boilerplate_build(spark, sf_dir):
    return N.boilerplate_build(table(spark, sf_dir, "part"), "p_name", 8).select("phrase")


def commit_log(spark, sf_dir):
    """Order lines as a log of commits: parsed, then rolled up by area."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.when(F.col("l_tax") > 0.04, "-").otherwise(F.col("l_suppkey").cast("string")), F.concat(F.lower("l_returnflag"), F.lit("/x"), F.col("l_partkey").cast("string"))))), "\n").alias("body"))
    log = li.select(F.concat(F.lit("@"), F.col("l_orderkey").cast("string"), F.lit("|2024-01-01|work\n\n"), "body").alias("value"))
    c = Q.parse_numstat(log, "value")
    return c.groupBy(F.substring("file", 1, 2).alias("area")).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count_distinct("file").alias("files"), F.count_distinct("sha").alias("commits"))


def sheet_import(spark, sf_dir):
    """Customers as cells of a sheet below a header row."""
    c = table(spark, sf_dir, "customer")
    body = c.select(F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") + 10).alias("r"), F.posexplode(F.array("c_name", F.col("c_mktsegment"))).alias("col", "v"))
    head = c.select(F.col("c_nationkey").alias("sheet")).distinct().select("sheet", F.lit(3).cast("bigint").alias("r"), F.posexplode(F.array(F.lit("Name"), F.lit("Segment"))).alias("col", "v"))
    note = head.select("sheet", F.lit(1).cast("bigint").alias("r"), "col", F.lit("note").alias("v"))
    return Q.sheet_rows(body.unionByName(head).unionByName(note), ["sheet"], "r", "col", "v", {"name": ["Name", "名称"], "segment": ["Segment"]})


def upload_payloads(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"files":[{"name":"a b/'), "c_name", F.lit('","data":"data:x;base64,'), F.when(F.col("c_custkey") % 3 == 0, "JVBERi0xLjQ=").when(F.col("c_custkey") % 3 == 1, "iVBORw0KGgo=").otherwise("???"), F.lit('"}]}')).alias("payload"))
    return Q.uploads(c, "payload").select("c_custkey", "name", "size", "problem")


def wide_truth(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n1:nation"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("n2:name"))
    return Q.long_truth(s, "s_suppkey")


QUERIES = {f"rec_{f.__name__}": f for f in (parse_dates, ages, slot_confidences, completed, era_fields, resolved_words, answered, anonymised, traces, drift, confirmed, suggestions, values_json, csv_export, markdown_export)}
QUERIES |= {f"mine_{f.__name__}": f for f in (mined_fixes, clear_targets, generated_fixes, real_words, dictionary_build, boilerplate_build)}
QUERIES |= {f"src_{f.__name__}": f for f in (event_props, page_links, reachable_pages, commit_log, sheet_import, upload_payloads, wide_truth)}

_LINKS = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a FROM pages),
        h AS (SELECT DISTINCT page_id, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS label FROM a), l AS (SELECT *, lower(href || ' ' || label) AS w FROM h)""".replace("\\\\", "\\")
_W = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"
ORACLE_SQL = {
    "rec_parse_dates": """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) - 1988 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
        p AS (SELECT o_orderkey, CASE k WHEN 0 THEN '平成' || y || '年' || m || '月' || d || '日' WHEN 1 THEN 'H ' || y || '年' || m || '月' || d WHEN 2 THEN y || '日年' || m || '月' || d WHEN 3 THEN y || '/' || m || '/' || d WHEN 4 THEN '平' || y || '年13月' || d || '日' ELSE '元年5月' END AS raw,
          CASE WHEN k = 5 THEN 1 ELSE y END AS y, CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN 5 ELSE m END AS m, CASE WHEN k = 5 THEN NULL ELSE d END AS d FROM o)
        SELECT o_orderkey, raw, '平成' AS era, y::INT AS year, m::INT AS month, d::INT AS day, concat(y, '年', CASE WHEN m IS NOT NULL THEN m || '月' END, CASE WHEN d IS NOT NULL THEN d || '日' END) AS text,
          CASE WHEN m IS NOT NULL AND d IS NOT NULL THEN printf('%04d-%02d-%02d', 1988 + y, m, d) WHEN m IS NOT NULL THEN printf('%04d-%02d', 1988 + y, m) ELSE printf('%04d', 1988 + y) END AS gregorian FROM p""",
    "rec_ages": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, try_cast(printf('%04d-%02d-%02d', o_custkey % 90 + 1900, o_orderkey % 12 + 1, o_custkey % 31 + 1) AS DATE) AS b, o_orderkey % 100 AS s FROM orders),
        g AS (SELECT *, year(a) - year(b) - (month(a) * 100 + day(a) < month(b) * 100 + day(b))::INT AS g FROM o) SELECT o_orderkey, g::INT AS age, abs(g - s) <= 1 AS agrees, b IS NOT NULL AS real FROM g""",
    "rec_slot_confidences": """WITH p AS (SELECT p_partkey, p_size, p_size > 10 AS a, p_partkey % 3 > 0 AS b, p_partkey % 7 > 2 AS c, p_partkey % 2 = 0 AS i, p_partkey % 5 = 0 AS k FROM part),
        s AS (SELECT *, a::INT + b::INT + c::INT AS n, CASE WHEN a THEN 0.9 ELSE 0 END + CASE WHEN b THEN 0.7 ELSE 0 END + CASE WHEN c THEN 0.4 ELSE 0 END AS t FROM p), f AS (SELECT *, CASE WHEN n > 0 THEN t / n::DOUBLE WHEN i OR k THEN 0.2 ELSE 0.85 END AS f FROM s)
        SELECT p_partkey, round(CASE WHEN (NOT a AND i) OR (NOT c AND k) THEN least(f, 0.3) ELSE f END, 3) AS confidence, CASE WHEN a AND p_size BETWEEN 1 AND 31 THEN p_size WHEN a AND 50 - p_size BETWEEN 1 AND 31 THEN 50 - p_size END AS merged FROM f""",
    "rec_completed": f"""WITH {_E}, f AS (SELECT * FROM (VALUES ('user', 1), ('assistant', 2), ('system', 3), ('tool', 4)) AS t(field, ordinal)), g AS (SELECT DISTINCT doc FROM e)
        SELECT g.doc, f.field, ordinal, v_text, coalesce(confidence, 0.0) AS confidence, CASE WHEN coalesce(confidence, 0) >= 0.8 THEN 'high' WHEN coalesce(confidence, 0) >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM g CROSS JOIN f LEFT JOIN e ON e.doc = g.doc AND e.field = f.field""",
    "rec_era_fields": f"""WITH {_E}, f AS (SELECT * FROM (VALUES ('user', 'system', '令和'), ('assistant', 'user', '')) AS t(field, era_field, default_era)) SELECT a.doc, a.field, coalesce(nullif(b.v_text, ''), default_era) AS era FROM e a JOIN f USING (field) LEFT JOIN e b ON b.doc = a.doc AND b.field = f.era_field""",
    "rec_resolved_words": """WITH p AS (SELECT p_brand, min(p_name) AS x, max(p_name) AS l FROM part GROUP BY 1), r AS (SELECT *, CASE WHEN regexp_matches(p_brand, '[13579]$') THEN l ELSE x END AS a, CASE WHEN p_brand = 'Brand#4' THEN NULL WHEN regexp_matches(p_brand, '[1-5]$') THEN l ELSE '' END AS b FROM p)
        SELECT p_brand, CASE WHEN p_brand = 'Brand#3' THEN 'fixed word' ELSE x END AS word, CASE WHEN p_brand = 'Brand#3' THEN 'override' ELSE 'definition' END AS source, p_brand <> 'Brand#3' AND coalesce(a = b AND a <> '', false) AND coalesce(nullif(b, ''), a) <> x AS changed FROM r""",
    "rec_answered": """WITH o AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS v, max(o_orderstatus) AS t FROM orders GROUP BY 1)
        SELECT o_custkey, array_to_string(list_transform(v, lambda x: CASE x WHEN '1-URGENT' THEN 'urgent（' || t || '）' WHEN '2-HIGH' THEN t WHEN '5-LOW' THEN 'low' ELSE x END), '|') AS answer, array_to_string(v, '；') AS flat FROM o""",
    "rec_anonymised": f"""WITH {_E}, x AS (SELECT *, v_text AS raw, CASE WHEN field = 'system' AND doc % 2 = 0 THEN '' ELSE v_text END AS v FROM e), a AS (SELECT doc, count(*) FILTER (field = 'system') > 0 AND count(*) FILTER (field = 'system' AND trim(v) <> '') = 0 AND count(*) FILTER (field <> 'system' AND trim(v) <> '') > 0 AS auto FROM x GROUP BY 1),
        h AS (SELECT x.*, (field = 'system' AND (auto OR trim(v) = '')) OR (field = 'assistant' AND auto) AS hit FROM x JOIN a USING (doc))
        SELECT doc, field, CASE WHEN hit THEN CASE WHEN field = 'system' THEN '（匿名化済み）' ELSE '（マスク済み）' END ELSE v END AS v_text, CASE WHEN hit THEN '' ELSE raw END AS raw, CASE WHEN hit THEN 1.0 ELSE confidence END AS confidence, hit AS anonymised, CASE WHEN hit THEN 0 ELSE 1 END AS candidates FROM h""",
    "rec_drift": """WITH p AS (SELECT p_brand, list_distinct(list(p_name)) AS n, list_sort(list_distinct(list(p_type))) AS t FROM part GROUP BY 1), f AS (SELECT p_brand, t, list_filter(['small ring', 'red bolt', 'hot gear', 'old anvil'], lambda o: contains(array_to_string(list_transform(list_sort(n), lambda x: replace(x, ' ', '')), ''), replace(o, ' ', ''))) AS f FROM p),
        g AS (SELECT *, list_filter(['small ring', 'red bolt', 'hot gear', 'old anvil'], lambda o: NOT list_contains(f, o)) AS m, list_filter(list_transform(t, lambda x: lower(x)), lambda w: NOT (w = 'small' OR w = 'promo')) AS e FROM f)
        SELECT p_brand, array_to_string(f, ',') AS found, array_to_string(m, ',') AS missing, array_to_string(e, ',') AS extra, len(e) > 0 AND len(f) * 2 >= len(f) + len(m) AS reported FROM g""",
    "rec_confirmed": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' OR o_orderkey % 2 = 0) AS confirmed, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 2 = 0) AS newly FROM orders GROUP BY 1",
    "rec_suggestions": """WITH p AS (SELECT *, p_partkey % 3 > 0 AND p_size > 25 AND lower(p_type) <> p_name AS a FROM part) SELECT p_partkey, CASE WHEN a THEN lower(p_type) ELSE p_name END AS value, CASE WHEN a THEN p_name || ',x' ELSE 'x' END AS candidates, round(CASE WHEN a THEN greatest(p_size / 60, 0.55) ELSE p_size / 60 END, 4) AS confidence, a AS applied FROM p""",
    "rec_values_json": f"WITH {_E} SELECT doc, field, v_text AS value FROM e",
    "rec_csv_export": f"""WITH {_E} SELECT 0 AS row, '文書' AS doc, '人' AS "user", '確信度' AS user_confidence, '機械' AS assistant, '確信度' AS assistant_confidence UNION ALL
        SELECT 1, doc::VARCHAR, coalesce(max(v_text) FILTER (field = 'user'), ''), coalesce(max(confidence::VARCHAR) FILTER (field = 'user'), ''), coalesce(max(v_text) FILTER (field = 'assistant'), ''), coalesce(max(confidence::VARCHAR) FILTER (field = 'assistant'), '') FROM e GROUP BY doc""",
    "rec_markdown_export": f"""WITH {_E}, r AS (SELECT doc, length(field) AS o, field, '| ' || field || ' | ' || replace(v_text, '|', '\\|') || ' | ' || CASE WHEN confidence >= 0.3 THEN 'high' ELSE 'low' END || ' |' AS r, confidence < 0.3 AS low FROM e),
        d AS (SELECT doc, '## S' || chr(10) || string_agg(r, chr(10) ORDER BY o, r) AS t, string_agg(field, chr(10) || '- ' ORDER BY o, field) FILTER (low) AS l FROM r GROUP BY 1) SELECT doc, md5(t || CASE WHEN l IS NULL THEN '' ELSE chr(10) || chr(10) || '## 要確認' || chr(10) || '- ' || l END) AS md5 FROM d""",
    "mine_clear_targets": """WITH n AS (SELECT string_split(p_name, ' ')[1] AS wrong, p_type AS "right", count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS x FROM n WINDOW w AS (PARTITION BY wrong ORDER BY n DESC, "right")) SELECT wrong, "right", n FROM r WHERE k = 1 AND n >= 5 AND n > coalesce(x, 0)""",
    "mine_generated_fixes": f"""WITH {_W}, c AS (SELECT * FROM (VALUES ('0', 'o'), ('1', 'l'), ('c', 'e'), ('q', 'g'), ('d', 't'), ('o', 'e'), ('h', 'b')) AS t(bad, good)), a AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
        m AS (SELECT substr(word, 1, i - 1) || bad || substr(word, i + 1) AS wrong, word AS "right" FROM a JOIN c ON substr(word, i, 1) = good), g AS (SELECT wrong, min("right") AS "right" FROM m WHERE wrong NOT IN (SELECT word FROM w) GROUP BY 1 HAVING count(DISTINCT "right") = 1)
        SELECT wrong, "right", 0 AS ord FROM g WHERE wrong NOT IN ('b1ue', 'zz') UNION ALL SELECT * FROM (VALUES ('b1ue', 'BLUE', 1), ('zz', 'z', 1)) AS t(wrong, r, ord)""",
    "mine_real_words": f"""WITH {_W}, f AS (SELECT * FROM (VALUES ('bolt', 'volt'), ('xbolty', 'z'), ('d ri', 'z'), ('qqq', 'ggg'), ('rin', 'run')) AS t(wrong, r)) SELECT wrong, r AS "right" FROM f WHERE wrong NOT IN (SELECT word FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE length(word) >= 3 AND contains(wrong, word)) AND NOT EXISTS (SELECT 1 FROM part WHERE contains(p_name, wrong))""",
    "mine_dictionary_build": "SELECT p_name AS term, bool_or(p_size > 48) AS flagged FROM part GROUP BY 1",
    "mine_boilerplate_build": "SELECT DISTINCT replace(p_name, ' ', '') AS phrase FROM part WHERE length(replace(p_name, ' ', '')) >= 8",
    "src_event_props": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::BIGINT AS v FROM events",
    "rec_traces": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN user_id % 2 = 0 THEN value::VARCHAR END AS detail, event_type = 'click' AS c FROM events),
        s AS (SELECT user_id, event_type, min(i) AS f FROM e GROUP BY 1, 2), u AS (SELECT user_id, string_agg(event_type, ' → ' ORDER BY f) AS summary FROM s GROUP BY 1)
        SELECT user_id, summary, md5(string_agg(i || '. ' || event_type || CASE WHEN coalesce(detail, '') <> '' THEN '　' || detail ELSE '' END || CASE WHEN c THEN '　「a」→「b」' ELSE '' END, chr(10) ORDER BY i)) AS lines_md5,
          arg_min(struct_pack(d := detail), i) FILTER (event_type IN ('click', 'view'))['d'] AS engine FROM e JOIN u USING (user_id) GROUP BY 1, 2""",
    "src_page_links": rf"""WITH {_LINKS} SELECT page_id, count(*) AS links, sum(CASE WHEN regexp_matches(w, 'th|list') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(w, 'ad') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(href), '\.(xlsx?|csv|zip)$') THEN 5 ELSE 0 END)::BIGINT AS score FROM l GROUP BY 1""",
    "src_reachable_pages": rf"""WITH RECURSIVE {_LINKS}, g AS (SELECT DISTINCT page_id::VARCHAR AS src, ((page_id * 7 + length(href)) % 1009)::VARCHAR AS dst FROM l), r AS (SELECT '0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN g ON src = node WHERE depth < 2)
        SELECT node, min(depth) AS depth FROM r GROUP BY 1 ORDER BY depth, node LIMIT 40""",
    "src_commit_log": """SELECT lower(l_returnflag) || '/' AS area, sum(l_linenumber)::BIGINT AS added, sum(CASE WHEN l_tax > 0.04 THEN 0 ELSE l_suppkey END)::BIGINT AS deleted, count(DISTINCT l_partkey) AS files, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1""",
    "src_sheet_import": "SELECT c_nationkey AS sheet, c_custkey + 10 AS r, c_name AS name, c_mktsegment AS segment FROM customer",
    "src_upload_payloads": """SELECT c_custkey, replace(c_name, '#', '_') || CASE c_custkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '' END AS name, CASE WHEN c_custkey % 3 < 2 THEN 8 END AS size, CASE WHEN c_custkey % 3 = 2 THEN 'not base64' END AS problem FROM customer""",
    "src_wide_truth": "SELECT s_suppkey, 'n1' AS field, s_nationkey::VARCHAR AS truth FROM supplier UNION ALL SELECT s_suppkey, 'n2', CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END FROM supplier",
}
