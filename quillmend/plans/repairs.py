"""Queries of repairs of Japanese readings, and of the rules around them, over names spelt in look-alike characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmend.functions import dates as D
from quillmend.functions import similarity as S
from quillmend.functions import text as T
from quillmend.functions.kernels import written_shape
from quillmend.operators import evaluation as E
from quillmend.operators import forms as O
from quillmend.operators import matching as M
from quillmend.operators import mining as N
from quillmend.operators import records as R
from quillmend.operators import windows as W
from quillmend.sources import records as Q
from quillmend.sources.tables import per_value, table

from .matching import SIM_SQL

# Letters of the tables' names as katakana, their look-alikes and others.
LATIN, JAPANESE = "abcdefghijklmnopqrstuvwxyz", "カ力ロ口ニ二トタ夕エ工オ才ハ八チ千ー一ムヘへみのをん"
K = "ァ-ヿ"


def _readings(spark, sf_dir):
    """Every part's name and type, spelt in Japanese characters."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", "p_name", "p_type", F.translate(F.concat("p_name", F.lit(" "), F.lower("p_type")), LATIN, JAPANESE).alias("t"))


_R = f"r AS (SELECT p_partkey, p_size, p_name, p_type, translate(p_name || ' ' || lower(p_type), '{LATIN}', '{JAPANESE}') AS t FROM part)"


def _context_sql(source: str, column: str, rest: str = "p_partkey") -> tuple[str, str]:
    """Steps that apply the rules of neighbours one after the other, and the last one's name."""
    steps, at = [], source
    for i, (script, wrong, right) in enumerate(T.CONTEXT):
        is_wrong = f"regexp_matches(substr({column}, i, 1), '^{wrong}$')"
        near = " AND ".join(f"regexp_matches(substr({column}, i {d} 1, 1), '^[{script}]$')" for d in "-+")
        one = f"CASE WHEN {is_wrong} AND i > 1 AND {near} THEN '{right}' ELSE substr({column}, i, 1) END"
        steps.append(f"x{i} AS (SELECT {rest}, array_to_string(list_transform(range(1, length({column}) + 1), lambda i: {one}), '') AS {column} FROM {at})")
        at = f"x{i}"
    return ", ".join(steps), at


def _katakana_sql(column: str) -> str:
    looks = "".join(T.KATAKANA_LOOKALIKES)
    run = f"[{K}{looks}]{{2,}}|(?s:.)"
    return f"array_to_string(list_transform(regexp_extract_all({column}, '{run}'), lambda s: CASE WHEN length(s) > 1 AND regexp_matches(s, '[{K}]') THEN translate(s, '{looks}', '{''.join(T.KATAKANA_LOOKALIKES.values())}') ELSE s END), '')"


def in_context(spark, sf_dir):
    return _readings(spark, sf_dir).select("p_partkey", T.fix_in_context(F.col("t")).alias("fixed"))


def katakana_runs(spark, sf_dir):
    return _readings(spark, sf_dir).select("p_partkey", T.fix_katakana_runs(F.col("t")).alias("fixed"))


def hiragana(spark, sf_dir):
    return _readings(spark, sf_dir).select("p_partkey", T.to_hiragana(F.col("t")).alias("hiragana"))


def composed_forms(spark, sf_dir):
    """Match forms of whole documents, composed; of the tables' characters only accents compose."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.match_form(F.col("text"))).alias("form_md5"))


def proofread(spark, sf_dir):
    """The whole repair over every reading with a unit behind it."""
    r = _readings(spark, sf_dir).withColumn("t", F.concat(F.lit("|・"), "t", F.lit("  120"), F.when(F.col("p_size") % 2 == 0, "rnmHg").otherwise("rng"), F.lit("!")))
    pairs = T.pair_array({"ロー": "ロ長", "カカ": "力カ"})
    fixed = T.proofread(F.col("t"), pairs, compose=False)
    return per_value(r.select("p_partkey", "t"), "t", {"fixed": fixed, "same": fixed == T.proofread(F.col("t"), pairs)}).select("p_partkey", "fixed", "same")


def clean_readings(spark, sf_dir):
    raw = F.when(F.col("p_size") % 5 == 0, "（ ―｜）").otherwise(F.concat(F.lit("　"), F.translate("t", "カロ", "变两"), F.lit(" \u3000")))
    digits = F.concat(F.translate(F.col("p_size").cast("string"), "01", "Оｌ"), F.lit("ー2"))
    return _readings(spark, sf_dir).select("p_partkey", T.clean_reading(raw).alias("clean"), T.trim_space(raw).alias("trimmed"), T.map_digits(digits).alias("digits"))


def label_forms(spark, sf_dir):
    raw = F.concat(F.lit("□口"), F.replace("t", F.lit(" "), F.lit("：―・")), F.lit("（□）ロ"))
    return _readings(spark, sf_dir).select("p_partkey", T.label_form(raw, compose=False).alias("form"))


def trimmed_edges(spark, sf_dir):
    """Stray marks at both ends, brackets that close nowhere, and signs before numbers."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" ｜：_"), "t", F.lit("：＝"))).when(k == 1, F.concat(F.lit("（"), "t")).when(k == 2, F.concat(F.lit("（"), "t", F.lit("）"))).otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit("，")))
    return _readings(spark, sf_dir).select("p_partkey", T.trim_edges(raw).alias("trimmed"))


def joined_japanese(spark, sf_dir):
    return _readings(spark, sf_dir).select("p_partkey", T.join_japanese(F.concat("t", F.lit("　"), "t", F.lit(" a カ"))).alias("joined"))


def words_in_row(spark, sf_dir):
    row = F.concat(F.lit("□ "), F.translate("p_name", LATIN, JAPANESE), F.lit("：□"), "p_type", F.lit("☐の("), "t", F.lit(")□"), F.translate(F.lower("p_type"), LATIN, JAPANESE))
    return _readings(spark, sf_dir).select("p_partkey", F.array_join(T.words_in_row(row), "|").alias("words"))


def answers(spark, sf_dir):
    """Model answers cleaned: thoughts and lead-ins off, the longest quoted span, nothing for nothing."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    raw = F.concat(F.lit("<think>x\ny</think> "), F.when(k == 0, F.concat(F.lit("答え：「"), "p_name", F.lit("」や『"), "p_type", F.lit("』"))).when(k == 1, F.concat(F.lit("出力: "), "p_name")).when(k == 2, F.lit("なし")).otherwise(F.concat("p_name", F.lit("\n結果 : "), "p_type")))
    return p.select("p_partkey", T.clean_answer(T.strip_thoughts(raw)).alias("answer"))


def facilities(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.get(F.array(*map(F.lit, ("医療法人社団 ", "社会医療法人財団 水の会 ", "特定医療法人", "株式会社 "))), (F.col("s_suppkey") % 4).cast("int")), F.when(F.col("s_suppkey") % 7 == 0, "a").otherwise(F.col("s_name"))).alias("name"))
    return s.select("s_suppkey", T.strip_corporation(F.col("name")).alias("bare"))


def standard_names(spark, sf_dir):
    r = _readings(spark, sf_dir)
    k = F.col("p_partkey")
    reading = F.concat(F.when(k % 3 == 0, "右").when(k % 3 == 1, "両").otherwise(""), F.translate("p_name", LATIN, JAPANESE), F.when(k % 2 == 0, "術後").otherwise(""))
    name = F.when(k % 5 == 0, "カ").when(k % 5 == 1, "").otherwise(F.translate("p_type", LATIN, JAPANESE))
    return r.select("p_partkey", M.standard_name(reading, name).alias("standard"))


CONFUSED = [("0", "o"), ("l", "1"), ("1", "i"), ("q", "g"), ("c", "e"), ("b", "h")]


def confusable_pairs(spark, sf_dir):
    """Names against themselves and others with confused glyphs, whose canonical forms raise the likeness."""
    p = table(spark, sf_dir, "part").select(F.translate("p_name", "olge", "01qc").alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.substring("p_name", 2, 40)).alias("b")).distinct()
    return p.select("a", "b", S.similarity(F.col("a"), F.col("b"), S.components_of(CONFUSED)).alias("score"))


def same_places(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = F.concat(F.lit("竜"), F.when(F.col("n_nationkey") % 2 == 0, "ヶ").otherwise("が"), "n_name")
    b = F.concat(F.lit("龍"), F.when(F.col("n_nationkey") % 3 == 0, "ケ").otherwise("崎"), "n_name")
    return n.select("n_nationkey", T.same_place(a, b).alias("same"))


def shown_levels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    level = T.shown_level(k % 11 == 0, k % 7 == 0, k % 5 == 0, F.round(F.abs("c_acctbal") / 10000, 3))
    lone = T.blank_lone(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")), F.lit(0.9))
    return c.select("c_custkey", level.alias("level"), lone.alias("l")).filter(T.passes(F.col("level"), "check")).select("c_custkey", "level", "l.value", "l.confidence", "l.note")


def labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    label = F.concat("p_type", F.lit("（"), "p_name", F.lit("）"))
    scrubbed = T.scrub_names(F.concat(F.lit("read c:/x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".PDF and "), "p_brand", F.lit(".jpeg then z.txt")))
    token = F.when(F.col("p_partkey") % 3 == 0, F.md5("p_name")).when(F.col("p_partkey") % 3 == 1, "abc").otherwise(F.upper(F.md5("p_name")))
    return p.select("p_partkey", T.short_label(label, F.col("p_type")).alias("short"), T.short_label(label, F.col("p_name")).alias("whole"), scrubbed.alias("scrubbed"), T.valid_token(token).alias("valid"))


def closeness(spark, sf_dir):
    """Whether a part's name and type are the same wording, and their sequence ratio. It has no SQL and is tested against Python's."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", F.round(T.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), T.close(F.col("a"), F.col("b")).alias("close"))


def strike_scores(spark, sf_dir):
    """Struck-out marks with lowered scores and their confidence."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("q"), F.max("l_discount").cast("double").alias("d"))
    li = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), (F.col("q") > 10).alias("checked"), F.lit(1).alias("bands"), (F.col("q") / 10).alias("all_bands"), (F.col("d") * 40).alias("len"), F.round(F.col("q") / 50, 4).alias("s"), F.lit(0.9).alias("c"))
    return W.resolve_strikes(li, "l_orderkey", "l_linenumber", "bands", "all_bands", "len", "checked", "s", "c").select("l_orderkey", "l_linenumber", "struck", "score", "confidence")


def proposals(spark, sf_dir):
    """Proposals of a model for parts' names, kept only where they stand for an offered term that fits the reading."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 7).alias("read"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lower("p_type")).otherwise("made up").alias("proposal"), F.array(F.lower("p_type"), F.col("p_name")).alias("offered"))
    return p.select("p_partkey", M.gated_proposal(F.col("read"), F.col("proposal"), F.col("offered")).alias("kept"))


def only_winners(spark, sf_dir):
    """Values of events whose type lost its user's vote are cleared."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("value").alias("shown"))
    return E.only_winner(e, "user_id", "event_type", "value", ["shown"]).select("event_id", "shown")


def directory_rows(spark, sf_dir):
    """Suppliers as rows of a sheet whose status stands in the row below; closed ones and rows without an address go."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    address = F.when(k % 6 == 0, "none").otherwise(F.concat(F.lit("〒123-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" 土浦市"), "s_name"))
    status = F.array(F.lit(""), F.when(k % 5 == 0, "廃止").when(k % 5 == 1, "休止").otherwise("x"))
    rows = s.select(F.col("s_nationkey").alias("sheet"), (k * 2).alias("r"), k.cast("string").alias("no"), F.concat(F.lit("c"), k.cast("string")).alias("code"), F.col("s_name").alias("name"), address.alias("address"), F.concat(F.lit(" "), k.cast("string")).alias("phone"), F.array().cast("array<string>").alias("status_cells"))
    below = s.select(F.col("s_nationkey").alias("sheet"), (k * 2 + 1).alias("r"), F.lit("").alias("no"), F.lit("").alias("code"), F.lit("").alias("name"), F.lit("").alias("address"), F.lit("").alias("phone"), status.alias("status_cells"))
    return O.directory_rows(rows.unionByName(below), ["sheet"], "r").select("sheet", "code", "name", "postal", "address", "phone", "status")


def reread_dates(spark, sf_dir):
    """Order dates with parts misread, filled from a second reading."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    y, m, d = F.year("o_orderdate") - 1988, F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    first = F.array(F.when(k % 3 > 0, y), F.when(k % 4 == 0, F.lit(13)).otherwise(m), F.when(k % 5 == 0, F.lit(77)).otherwise(d))
    second = F.array(y, F.when(k % 8 > 0, m), F.lit(99))
    r = D.reread(first, F.when(k % 7 > 0, 0.8).otherwise(0.0), second, F.when(k % 2 == 0, 0.6))
    return o.select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.parts")[0].alias("year"), F.col("r.parts")[1].alias("month"), F.col("r.parts")[2].alias("day"), "r.confidence")


def written_shapes(spark, sf_dir):
    """The lines of an order as lines of writing."""
    line = F.struct(F.col("l_quantity").cast("int").alias("columns"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_partkey") % 12 + 1).cast("int").alias("height"), (F.col("l_suppkey") % 50).cast("int").alias("first"), (F.col("l_partkey") % 400).cast("int").alias("last"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("l_orderkey", written_shape(F.col("lines"), F.lit(400)).alias("s")).select("l_orderkey", F.round("s.density", 3).alias("density"), "s.lines", "s.cut_left", "s.cut_right")


def category_counts(spark, sf_dir):
    return E.category_counts(table(spark, sf_dir, "part"), "p_type", [("small", "^SMALL"), ("metal", "STEEL|TIN|BRASS"), ("economy", "^ECONOMY")], "rest", "p_size")


def backfilled(spark, sf_dir):
    """Customers' phone and segment from their nation's best directory row, where these are empty or unsure."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    e = c.select("c_custkey", "c_nationkey", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), (k % 10 / 10.0).alias("segment_confidence"), F.col("c_name").alias("name"), F.when(k % 4 > 0, k % 9 / 9.0).alias("name_confidence"))
    best = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") / 24.0 + 0.3).alias("score"), F.col("n_name").alias("dir_segment"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("dir_name"))
    return M.backfill(e, best, ["c_nationkey"], ["segment", "name"], {"segment": 0.9, "name": 0.8}).select("c_custkey", "segment", F.round("segment_confidence", 4).alias("segment_confidence"), "name", F.round("name_confidence", 4).alias("name_confidence"))


def _entries(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("doc"), F.explode(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).otherwise(""))).alias("field", "value"))


_ENTRIES = "e AS (SELECT c_custkey AS doc, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END FROM customer)"


def _picked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("doc"), F.lit("segment").alias("field"), F.when(F.col("c_custkey") % 6 > 0, F.col("n_name")).alias("taken"))


def applied_rows(spark, sf_dir):
    return R.apply_row(_entries(spark, sf_dir), _picked(spark, sf_dir))[0]


def applied_events(spark, sf_dir):
    return R.apply_row(_entries(spark, sf_dir), _picked(spark, sf_dir))[1]


def lexicon_fields(spark, sf_dir):
    """Terms of each field by the lexicon that the field uses."""
    fields = spark.sql("SELECT * FROM VALUES ('metal'), ('shape'), ('none') AS t(field)")
    uses = spark.sql("SELECT * FROM VALUES ('metal', 'types'), ('shape', 'names'), ('gone', 'types') AS t(field, lexicon)")
    p = table(spark, sf_dir, "part")
    terms = p.select(F.lit("types").alias("lexicon"), F.col("p_type").alias("term")).union(p.select(F.lit("names"), "p_name")).distinct()
    return R.for_field(fields, uses, terms).groupBy("field", "lexicon").agg(F.count(F.lit(1)).alias("terms"), F.min("term").alias("first"))


def label_anchors(spark, sf_dir):
    """Parts and suppliers that a label, taken from their numbers, joins one to one."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("left"), (F.col("p_partkey") * 7 % 1013).alias("label"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right"), (F.col("s_suppkey") * 5 % 997).alias("label"))
    return R.anchors(a, b, "label")


def filtered_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("code")).distinct()
    return R.filtered_terms(terms, "name", "code", "ring", 40)


def derived_records(spark, sf_dir):
    """Dates, codes and ages of customers' records."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("int")
    day = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    part = lambda name, iso: F.struct(F.lit(name).alias("field"), iso.alias("iso"), F.lit("平成").alias("era"), F.substring(iso, 1, 4).cast("int").alias("year"), F.substring(iso, 6, 2).try_cast("int").alias("month"), F.substring(iso, 9, 2).try_cast("int").alias("day"))
    entry = F.when(k % 3 == 0, "2020-07").otherwise(day(F.lit(2020), k % 12 + 1, k % 28 + 1))
    dates = c.select(F.col("c_custkey").alias("doc"), F.explode(F.array(part("birth_date", day(k % 80 + 1920, k % 12 + 1, F.lit(15))), part("entry_date", entry), part("last_exam_date", F.lit("2019-03-02")))).alias("p")).select("doc", "p.*")
    codes = c.select(F.col("c_custkey").alias("doc"), F.lit("diagnosis1").alias("field"), F.col("c_mktsegment").alias("code"), (k % 2 == 0).alias("flagged"))
    written = c.select(F.col("c_custkey").alias("doc"), (F.lit(100) - k % 80).cast("string").alias("age"))
    out = R.derived(dates, codes, written)
    return out.select("doc", F.col("dates")["entry_date"]["iso"].alias("entry"), F.col("dates")["birth_date"]["year"].alias("born"), F.col("codes")["diagnosis1"]["code"].alias("code"), "age_computed", "age_written", "age_matches")


def full_records(spark, sf_dir):
    """Whole records as JSON, read again."""
    e = _entries(spark, sf_dir).withColumn("answer", F.upper("value")).withColumn("level", F.when(F.col("value") == "", "low").otherwise("high"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("kind"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("nation"))
    drift = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("doc"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("extra"))
    j = Q.full_records(e, o, d, drift, ["level"])
    shape = "struct<values:map<string,string>,answers:map<string,string>,meta:map<string,struct<level:string>>,sources:array<struct<page:bigint,kind:string>>,derived:struct<nation:bigint>,form_drift:map<string,struct<extra:string>>>"
    r = j.select("doc", F.from_json("json", shape).alias("r"))
    return r.select("doc", F.col("r.values")["segment"].alias("segment"), F.col("r.answers")["name"].alias("answer"), F.col("r.meta")["segment"]["level"].alias("level"), F.size("r.sources").alias("pages"), F.col("r.derived.nation").alias("nation"), F.col("r.form_drift")["segment"]["extra"].alias("extra"))


def junk_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("truth", F.when(F.col("value") > 5, F.lit(" ")).otherwise(F.col("event_type"))).withColumn("read", F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "x").otherwise(F.col("event_type")))
    return R.junk_counts(e, "user_id", "truth", "read")


def best_engines(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 3).alias("n"), F.round(F.max("value") / 100, 4).alias("confidence"))
    parts = F.array(*(F.when(F.col("n") > i, F.lit(i)) for i in range(3)))
    return R.best_engine(e.withColumn("parts", parts), "user_id", "event_type", "parts", "confidence")


def cleared(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("v_text", F.when(F.col("doc") % 3 == 0, R.ANONYMISED).when(F.col("doc") % 3 == 1, R.MASKED).otherwise(F.col("value"))).drop("value")
    return R.clear_anonymised(e)


def joined_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lists = F.array(F.split("p_name", " "), F.array(F.lit(""), F.when(F.col("p_size") > 20, F.col("p_type"))))
    return p.select("p_partkey", F.array_join(O.joined_value(lists), "|").alias("joined"))


def regions(spark, sf_dir):
    """The region of a sheet from heading, sheet name, code, name or romanised name, the first that tells."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 6
    header, sheet = F.when(k == 0, "[ 東京都 ] x").otherwise("none"), F.when(k == 1, "大阪府").otherwise("s1")
    file = F.when(k == 2, "list_13.xlsx").when(k == 3, "東京の一覧").when(k == 4, "OSAKA-2").otherwise("x9")
    return s.select("s_suppkey", O.region_of(header, sheet, file, ["東京都", "大阪府"], {"13": "東京都"}, {"osaka": "大阪府"}, "北海道").alias("region"))


def option_places(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    options = F.array(F.lit("SMALL"), F.lit("econ omy"), F.lit("other"))
    label = F.when(F.col("p_partkey") % 5 == 0, "tiny").otherwise(F.split("p_type", " ")[0])
    return p.select("p_partkey", R.option_index(label, options, {"tiny": "SMALL"}, lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))).cast("int").alias("place"))


def companions(spark, sf_dir):
    """Text fields beside options, over one definition a brand."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("field")).agg(F.map_from_arrays(F.array(F.min("p_name"), F.lit("other")), F.array(F.min("p_type"), F.concat(F.lit("t"), F.count(F.lit(1)).cast("string")))).alias("option_texts"))
    return R.companion_fields(p)


def vocabulary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return N.vocabulary(p.select("p_name"), p.select(F.split("p_name", " ")[0]), table(spark, sf_dir, "nation").select("n_name"), pattern="^[a-z]+$|^[A-F]")


def header_dates(spark, sf_dir):
    """First of each customer's orders by status, as paths given more than once."""
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(".jpeg")).alias("path"), F.col("o_orderkey").alias("ordinal"))
    return Q.first_paths(o, "path", "ordinal").select("path", "ordinal", Q.kind_of(F.col("path")).alias("kind"))


def form_outline(spark, sf_dir):
    """Sections, groups and items of each brand as JSON, read again as counts and the first label."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.split("p_type", " ")[0].alias("section"), F.length("p_type").alias("section_no"), F.split("p_name", " ")[0].alias("group"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("field"), F.col("p_type").alias("label"), F.col("p_size").alias("value"))
    j = Q.form_json(p)
    r = j.select("doc", F.from_json("json", "array<struct<section_no:int,section:string,groups:array<struct<ordinal:bigint,group:string,items:array<struct<ordinal:bigint,field:string,label:string>>>>>>").alias("s"))
    groups = F.flatten(F.transform("s", lambda s: s["groups"]))
    return r.select("doc", F.size("s").alias("sections"), F.size(groups).alias("groups"), F.size(F.flatten(F.transform(groups, lambda g: g["items"]))).alias("items"), F.col("s")[0]["groups"][0]["items"][0]["label"].alias("first"))


def lexicon_json(spark, sf_dir):
    """Names of each brand as a lexicon file, read again."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lexicon"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("term"), F.col("p_type").alias("code"), (F.col("p_size") > 25).alias("flagged"))
    r = Q.lexicon_json(t).select("lexicon", F.from_json("json", "struct<label:string,entries:array<struct<name:string,icd10:string,tokutei:boolean>>>").alias("r"))
    return r.select("lexicon", F.size("r.entries").alias("terms"), F.col("r.entries")[0]["name"].alias("first"), F.size(F.filter("r.entries", lambda e: e["tokutei"])).alias("flagged"))


def overviews(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("lexicon"), F.col("p_name").alias("term")).distinct()
    return Q.overview(_entries(spark, sf_dir), p)


def failure_pages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.array(F.col("c_mktsegment"), F.lit("x")).alias("warnings"), (F.col("c_custkey") % 3 > 0).alias("was_read"), F.col("c_name").alias("markdown"))
    return Q.failure_markdown(c)


def saved_overrides(spark, sf_dir):
    """Overrides kept by nation: blank ones go, others are trimmed."""
    n = table(spark, sf_dir, "nation").select(F.create_map(F.col("n_name"), F.concat(F.lit(" "), F.when(F.col("n_nationkey") % 3 > 0, F.lower("n_name")).otherwise("")), F.lit("k"), F.col("n_nationkey").cast("string")).alias("m"))
    return Q.cleaned_overrides(n, "m")


QUERIES = {f"fix_{f.__name__}": f for f in (in_context, katakana_runs, hiragana, composed_forms, proofread, clean_readings, label_forms, trimmed_edges, joined_japanese, words_in_row, answers, facilities, standard_names, confusable_pairs, same_places, shown_levels, labels, closeness, strike_scores)}
QUERIES |= {f"adopt_{f.__name__}": f for f in (reread_dates, written_shapes, category_counts, proposals, only_winners, directory_rows, backfilled, applied_rows, applied_events, lexicon_fields, label_anchors, filtered_terms, derived_records, full_records, junk_counts, best_engines, cleared, joined_values, regions, option_places, companions, vocabulary, header_dates, form_outline, lexicon_json, overviews, failure_pages, saved_overrides)}

_CONTEXT, _LAST = _context_sql("r", "t")
_CONTEXT2, _LAST2 = _context_sql("n", "t")
_BARE = r"[\s　:：・.,、。()（）\[\]【】「」]+"
_UNIT = lambda c: f"regexp_replace(regexp_replace({c}, '([0-9])rnmHg', '\\1mmHg', 'g'), '([0-9])rng', '\\1mg', 'g')"
_JOIN = lambda c: f"regexp_replace({c}, '([{T.JAPANESE}])[ 　]+([{T.JAPANESE}])', '\\1\\2', 'g')"
_MADE = f"translate(p_name, '{LATIN}', '{JAPANESE}')"
_JP = "'" + LATIN + "', '" + JAPANESE + "'"

ORACLE_SQL = {
    "fix_in_context": f"WITH {_R}, {_CONTEXT} SELECT p_partkey, t AS fixed FROM {_LAST}",
    "fix_katakana_runs": f"WITH {_R} SELECT p_partkey, {_katakana_sql('t')} AS fixed FROM r",
    "fix_hiragana": f"WITH {_R} SELECT p_partkey, translate(t, '{T.KATAKANA_LETTERS}', '{T.HIRAGANA_LETTERS}') AS hiragana FROM r",
    "fix_composed_forms": rf"""SELECT doc_id, md5(lower(regexp_replace(nfc_normalize(text), '[\s　・･,、。.\-‐－―ー—_/\\()（）\[\]「」【】:：;；''"]+', '', 'g'))) AS form_md5 FROM documents""",
    "fix_proofread": f"""WITH {_R}, n AS (SELECT p_partkey, regexp_replace(t, '^ー+', '') || ' 120' || CASE WHEN p_size % 2 = 0 THEN 'rnmHg' ELSE 'rng' END AS t FROM r), {_CONTEXT2}, k AS (SELECT p_partkey, {_katakana_sql('t')} AS t FROM {_LAST2}), u AS (SELECT p_partkey, {_UNIT('t')} AS t FROM k)
        SELECT p_partkey, replace(replace(t, 'ロー', 'ロ長'), 'カカ', '力カ') AS fixed, true AS same FROM u""",
    "fix_clean_readings": f"""WITH {_R} SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE replace(replace(t, 'カ', '変'), 'ロ', '両') END AS clean, CASE WHEN p_size % 5 = 0 THEN '（ ―｜）' ELSE translate(t, 'カロ', '变两') END AS trimmed, p_size || '-2' AS digits FROM r""",
    "fix_label_forms": f"""WITH {_R} SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('□口' || replace(t, ' ', '：―・') || '（□）ロ', '{_BARE}', '', 'g'), '^[口ロ□■☐▢〇○●]+', ''), '[口ロ□■☐▢]+$', ''), '[ー—–‐\\-─―一]', 'ー', 'g') AS form FROM r""",
    "fix_trimmed_edges": f"WITH {_R} SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '（' || t || '）' WHEN 3 THEN '-' || p_size ELSE regexp_replace(t, '^ー+|ー+$', '') END AS trimmed FROM r",
    "fix_joined_japanese": f"WITH {_R} SELECT p_partkey, {_JOIN(_JOIN(chr(39).join(['t || ', '　', ' || t || ', ' a カ', ''])))} AS joined FROM r",
    "fix_words_in_row": f"""WITH {_R}, w AS (SELECT p_partkey, list_transform(regexp_split_to_array('□ ' || {_MADE} || '：□' || p_type || '☐の(' || t || ')□' || translate(lower(p_type), {_JP}), '[□■☐▢口]'), lambda x: regexp_replace(x, '[\\s　:：・.,、。()（）\\[\\]【】「」]+', '', 'g')) AS w FROM r)
        SELECT p_partkey, array_to_string(list_filter(w, lambda x: length(x) BETWEEN 2 AND 14 AND NOT regexp_matches(x, '[A-Za-z+*/=<>~^|#$%&@\\\\]') AND length(regexp_replace(x, '[^ぁ-んァ-ヶ一-龥ーＡ-Ｚａ-ｚ０-９]', '', 'g')) >= length(x) * 0.7), '|') AS words FROM w""",
    "fix_answers": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN length(p_type) > length(p_name) THEN p_type ELSE p_name END WHEN 1 THEN p_name WHEN 2 THEN '' ELSE p_name || chr(10) || p_type END AS answer FROM part",
    "fix_facilities": "WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'a' ELSE s_name END AS n FROM supplier) SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 AND n <> 'a' THEN n ELSE ['医療法人社団 ', '社会医療法人財団 水の会 ', '特定医療法人', '株式会社 '][s_suppkey % 4 + 1] || n END AS bare FROM n",
    "fix_standard_names": f"""WITH {_R}, x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '右' WHEN 1 THEN '両' ELSE '' END AS b, {_MADE} AS c, CASE WHEN p_partkey % 2 = 0 THEN '術後' ELSE '' END AS a, CASE p_partkey % 5 WHEN 0 THEN 'カ' WHEN 1 THEN '' ELSE translate(p_type, {_JP}) END AS n FROM r)
        SELECT p_partkey, CASE WHEN n = '' OR length(n) < length(c) * 0.75 THEN b || c || a ELSE b || n || a END AS standard FROM x""",
    "fix_confusable_pairs": f"""WITH p AS (SELECT DISTINCT translate(p_name, 'olge', '01qc') AS a, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE substr(p_name, 2, 40) END AS b FROM part), {SIM_SQL}, c AS (SELECT *, translate(a, 'oliqeh', '011gcb') AS x, translate(b, 'oliqeh', '011gcb') AS y FROM sim)
        SELECT a, b, CASE WHEN score >= 0.95 THEN score WHEN x = y THEN greatest(score, 0.9) WHEN least(length(x), length(y)) >= 6 AND abs(length(x) - length(y)) <= 1 AND levenshtein(x, y) <= 1 THEN greatest(score, 0.85) ELSE score END AS score FROM c""",
    "fix_same_places": "SELECT n_nationkey, n_nationkey % 3 = 0 AS same FROM nation",
    "fix_shown_levels": """WITH l AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN 'confirmed' WHEN c_custkey % 7 = 0 THEN 'anonymised' WHEN c_custkey % 5 = 0 THEN 'edited' WHEN round(abs(c_acctbal) / 10000, 3) >= 0.8 THEN 'high' WHEN round(abs(c_acctbal) / 10000, 3) >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM customer)
        SELECT c_custkey, level, CASE WHEN c_nationkey < 10 THEN '' ELSE ' ' || c_nationkey END AS value, CASE WHEN c_nationkey < 10 THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN c_nationkey < 10 THEN 'one character only' ELSE '' END AS note FROM l WHERE level IN ('low', 'medium')""",
    "fix_labels": """SELECT p_partkey, p_name AS short, p_type || '（' || p_name || '）' AS whole, 'read c:/x/（ファイル名） and （ファイル名） then z.txt' AS scrubbed, p_partkey % 3 = 0 AS valid FROM part""",
    "fix_strike_scores": """WITH RECURSIVE g AS (SELECT l_orderkey AS k, l_linenumber AS o, max(l_quantity)::DOUBLE AS q, max(l_quantity) > 10 AS c, max(l_quantity)::DOUBLE / 10 >= 2 AS can, max(l_discount)::DOUBLE * 40 AS len FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS i, count(*) FILTER (c) OVER (PARTITION BY k) AS total FROM g),
        f AS (SELECT k, o, i, q, can AND len >= CASE WHEN total > 1 THEN 1.8 ELSE 2.2 END AS struck, total - (can AND len >= CASE WHEN total > 1 THEN 1.8 ELSE 2.2 END)::INT AS rest FROM m WHERE i = 1
              UNION ALL SELECT m.k, m.o, m.i, m.q, m.can AND m.len >= CASE WHEN f.rest > 1 THEN 1.8 ELSE 2.2 END, f.rest - (m.can AND m.len >= CASE WHEN f.rest > 1 THEN 1.8 ELSE 2.2 END)::INT FROM f JOIN m ON m.k = f.k AND m.i = f.i + 1),
        s AS (SELECT *, round(q / 50, 4) AS s, least(round(q / 50, 4), 0.45) AS low FROM f)
        SELECT k AS l_orderkey, o::BIGINT AS l_linenumber, struck, CASE WHEN struck THEN low ELSE s END AS score, CASE WHEN struck THEN round(least(1.0, 0.45 + abs(low - 0.5) * 1.1), 3) ELSE 0.9 END::DOUBLE AS confidence FROM s""",
    "adopt_reread_dates": """WITH o AS (SELECT o_orderkey, o_orderkey AS k, year(o_orderdate) - 1988 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
        p AS (SELECT *, CASE WHEN y BETWEEN 1 AND 99 THEN y END AS a, CASE WHEN k % 4 > 0 OR k % 8 > 0 THEN m END AS b, CASE WHEN k % 5 > 0 THEN d END AS c, (k % 3 = 0 AND y BETWEEN 1 AND 99) OR (k % 4 = 0 AND k % 8 > 0) AS filled, CASE WHEN k % 7 > 0 THEN 0.8 ELSE 0 END AS f, CASE WHEN k % 2 = 0 THEN 0.6 ELSE 0 END AS g FROM o),
        q AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, CASE WHEN filled THEN least(CASE WHEN f > 0 THEN f ELSE 1.0 END, CASE WHEN g > 0 THEN g ELSE 0.5 END) ELSE f END AS base FROM p)
        SELECT o_orderkey, a::INT AS year, b::INT AS month, c::INT AS day, CASE WHEN n > 0 THEN round(least(0.95, CASE WHEN base > 0 THEN base ELSE 0.5 END::DOUBLE * (0.55 + 0.15 * n)), 6) ELSE 0 END::DOUBLE AS confidence FROM q""",
    "adopt_written_shapes": """SELECT l_orderkey, round(coalesce(sum((l_quantity::INT)::DOUBLE / (l_partkey % 12 + 1)) FILTER (l_quantity::INT > 0 AND l_partkey % 12 + 1 >= 6), 0), 3) AS density, count(*)::INT AS lines, bool_or(l_suppkey % 50 <= 2) AS cut_left, bool_or(l_partkey % 400 >= 397) AS cut_right FROM lineitem GROUP BY 1""",
    "adopt_category_counts": "SELECT CASE WHEN regexp_matches(p_type, '^SMALL') THEN 'small' WHEN regexp_matches(p_type, 'STEEL|TIN|BRASS') THEN 'metal' WHEN regexp_matches(p_type, '^ECONOMY') THEN 'economy' ELSE 'rest' END AS category, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1",
    "adopt_proposals": f"""WITH q AS (SELECT p_partkey, p_name, lower(p_type) AS ty, substr(p_name, 1, 7) AS read, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) ELSE 'made up' END AS pr FROM part), p AS (SELECT ty AS a, pr AS b FROM q UNION SELECT p_name, pr FROM q), {SIM_SQL},
        k AS (SELECT q.*, CASE WHEN s1.score >= 0.9 THEN ty WHEN s2.score >= 0.9 THEN p_name END AS k FROM q JOIN sim s1 ON s1.a = ty AND s1.b = pr JOIN sim s2 ON s2.a = p_name AND s2.b = pr),
        o AS (SELECT *, list_distinct(string_split(read, '')) AS x, list_distinct(string_split(k, '')) AS y FROM k)
        SELECT p_partkey, CASE WHEN len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE >= 0.34 THEN k END AS kept FROM o""",
    "adopt_only_winners": """WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k FROM s)
        SELECT event_id, CASE WHEN e.event_type = r.event_type THEN value END AS shown FROM events e JOIN r ON r.user_id = e.user_id AND k = 1""",
    "adopt_directory_rows": """SELECT s_nationkey AS sheet, 'c' || s_suppkey AS code, s_name AS name, '123-' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS postal, '土浦市' || s_name AS address, s_suppkey::VARCHAR AS phone, CASE WHEN s_suppkey % 5 = 1 THEN '休止' ELSE '現存' END AS status FROM supplier WHERE s_suppkey % 6 > 0 AND s_suppkey % 5 > 0""",
    "adopt_backfilled": """WITH e AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS s, c_custkey % 10 / 10.0::DOUBLE AS sc, c_name AS n, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 9 / 9.0::DOUBLE END AS nc FROM customer),
        j AS (SELECT e.*, n_name, n_nationkey / 24.0::DOUBLE + 0.3 >= 0.85 AS t FROM e JOIN nation ON n_nationkey = c_nationkey), w AS (SELECT *, t AND (s = '' OR sc < 0.5) AS ws, t AND n_nationkey_even AND coalesce(nc, 0) < 0.5 AS wn FROM (SELECT *, c_nationkey % 2 = 0 AS n_nationkey_even FROM j))
        SELECT c_custkey, CASE WHEN ws THEN n_name ELSE s END AS segment, round(CASE WHEN ws THEN greatest(sc, 0.9) ELSE sc END, 4) AS segment_confidence, CASE WHEN wn THEN n_name ELSE n END AS name, round(CASE WHEN wn THEN greatest(coalesce(nc, 0), 0.8) ELSE nc END, 4) AS name_confidence FROM w""",
    "adopt_applied_rows": f"""WITH {_ENTRIES}, p AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 6 > 0 THEN n_name END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT e.doc, field, CASE WHEN field = 'segment' AND t IS NOT NULL THEN t ELSE value END AS value, field = 'segment' AND t IS NOT NULL AND t <> value AS edited FROM e JOIN p USING (doc)""",
    "adopt_applied_events": f"""WITH {_ENTRIES}, p AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 6 > 0 THEN n_name END AS t FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT e.doc, field, value AS before, t AS after FROM e JOIN p USING (doc) WHERE field = 'segment' AND t IS NOT NULL AND t <> value""",
    "adopt_lexicon_fields": "SELECT 'metal' AS field, 'types' AS lexicon, count(DISTINCT p_type) AS terms, min(p_type) AS first FROM part UNION ALL SELECT 'shape', 'names', count(DISTINCT p_name), min(p_name) FROM part",
    "adopt_label_anchors": """WITH a AS (SELECT p_partkey AS l, p_partkey * 7 % 1013 AS label, count(*) OVER (PARTITION BY p_partkey * 7 % 1013) AS n FROM part), b AS (SELECT s_suppkey AS r, s_suppkey * 5 % 997 AS label, count(*) OVER (PARTITION BY s_suppkey * 5 % 997) AS n FROM supplier)
        SELECT label, l AS "left", r AS "right" FROM a JOIN b USING (label) WHERE a.n = 1 AND b.n = 1""",
    "adopt_filtered_terms": "SELECT DISTINCT p_name AS name, p_brand AS code FROM part WHERE contains(p_name, 'ring') OR contains(p_brand, 'ring') ORDER BY name, code LIMIT 40",
    "adopt_derived_records": """WITH c AS (SELECT c_custkey AS doc, c_mktsegment, c_custkey % 80 + 1920 AS y, c_custkey % 12 + 1 AS m, CASE WHEN c_custkey % 3 = 0 THEN '2020-07' ELSE printf('%04d-%02d-%02d', 2020, c_custkey % 12 + 1, c_custkey % 28 + 1) END AS entry, c_custkey AS k FROM customer),
        a AS (SELECT *, CASE WHEN k % 3 = 0 THEN 2019 - y - (302 < m * 100 + 15)::INT ELSE 2020 - y - ((k % 12 + 1) * 100 + k % 28 + 1 < m * 100 + 15)::INT END AS age FROM c)
        SELECT doc, entry, y::INT AS born, c_mktsegment AS code, age::INT AS age_computed, (100 - k % 80)::INT AS age_written, abs(age - (100 - k % 80)) <= 1 AS age_matches FROM a""",
    "adopt_full_records": """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS doc, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END AS segment, upper(c_name) AS answer, CASE WHEN c_custkey % 4 > 0 THEN 'high' ELSE 'low' END AS level, coalesce(n, 0)::INT AS pages, c_nationkey AS nation, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS extra FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "adopt_junk_counts": "SELECT user_id, count(*) FILTER (value > 5 AND event_id % 3 = 0) AS blank_right, count(*) FILTER (value > 5 AND event_id % 3 = 2) AS junk, count(*) FILTER (value > 5) AS blanks FROM events GROUP BY 1",
    "adopt_best_engines": """WITH e AS (SELECT user_id, event_type, least(count(*) FILTER (value > 3), 3) AS n, round(max(value) / 100, 4) AS c FROM events GROUP BY 1, 2) SELECT user_id, event_type, n::INT AS n_parts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c DESC, event_type) AS r FROM e) WHERE r = 1""",
    "adopt_cleared": f"WITH {_ENTRIES} SELECT doc, field, CASE WHEN doc % 3 < 2 THEN '' ELSE value END AS v_text FROM e",
    "adopt_joined_values": "SELECT p_partkey, replace(p_name, ' ', '|') || CASE WHEN p_size > 20 THEN '|' || p_type ELSE '' END AS joined FROM part",
    "adopt_regions": "SELECT s_suppkey, ['東京都', '大阪府', '東京都', '東京都', '大阪府', '北海道'][s_suppkey % 6 + 1] AS region FROM supplier",
    "adopt_option_places": "WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'small' ELSE lower(string_split(p_type, ' ')[1]) END AS l FROM part) SELECT p_partkey, CASE l WHEN 'small' THEN 0 WHEN 'economy' THEN 1 WHEN 'other' THEN 2 END AS place FROM l",
    "adopt_companions": "SELECT min(p_type) AS text_field, p_brand AS field, min(p_name) AS option FROM part GROUP BY p_brand UNION ALL SELECT 't' || count(*), p_brand, 'other' FROM part GROUP BY p_brand",
    "adopt_vocabulary": "WITH w AS (SELECT p_name AS word FROM part UNION SELECT string_split(p_name, ' ')[1] FROM part UNION SELECT n_name FROM nation) SELECT word FROM w WHERE regexp_matches(word, '^[a-z]+$|^[A-F]')",
    "adopt_header_dates": """WITH o AS (SELECT o_orderpriority || '/' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.jpeg' END AS path, o_orderkey FROM orders) SELECT path, min(o_orderkey) AS ordinal, CASE WHEN path LIKE '%.PDF' THEN 'pdf' ELSE 'image' END AS kind FROM o GROUP BY 1""",
    "adopt_form_outline": """WITH p AS (SELECT p_brand AS doc, string_split(p_type, ' ')[1] AS s, length(p_type) AS n, string_split(p_name, ' ')[1] AS g, p_partkey AS o, p_type AS l FROM part), f AS (SELECT *, min(o) OVER (PARTITION BY doc, s, n) AS so FROM p)
        SELECT doc, count(DISTINCT (s, n))::INT AS sections, count(DISTINCT (s, n, g))::INT AS groups, count(*)::INT AS items, arg_min(l, struct_pack(n := n, s := s, o := o)) AS first FROM f GROUP BY 1""",
    "adopt_lexicon_json": "SELECT p_brand AS lexicon, count(*)::INT AS terms, arg_min(p_name, p_partkey) AS first, count(*) FILTER (p_size > 25)::INT AS flagged FROM part GROUP BY 1",
    "adopt_overviews": "SELECT (SELECT count(*) FROM customer) AS documents, 2 AS fields, count(DISTINCT p_brand) AS lexicons, count(DISTINCT (p_brand, p_name)) AS terms FROM part",
    "adopt_failure_pages": "SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '# 読み取れませんでした' || chr(10) || chr(10) || '- ' || c_mktsegment || chr(10) || '- x' END AS markdown FROM customer",
    "adopt_saved_overrides": "SELECT n_name AS key, lower(n_name) AS word FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'k', n_nationkey::VARCHAR FROM nation",
}
