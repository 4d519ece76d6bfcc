"""Queries of the text functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.functions import text as T
from quillmend.sources.tables import table

# Latin stand-ins for the word and glyph tables.
WORDS = {"teh": "the", "thea": "the a", "onof": "on of", "tion": "TION", "TIONs": "TION s", "and": "&"}
GLYPHS = {"0": "o", "1": "l", "5": "s", "|": "l"}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))


def normalise(spark, sf_dir):
    c = F.col("t")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.match_form(c, {}, compose=False)).alias("form_md5"), F.md5(T.map_glyphs(c, GLYPHS)).alias("glyphs_md5"), F.length(T.match_form(c, {}, compose=False)).alias("form_len"))


def strip_noise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_noise(F.col("t"))).alias("clean_md5"), F.size(T.noise_found(F.col("t"))).cast("int").alias("dropped"))


def replace_words(spark, sf_dir):
    pairs = T.pair_array(WORDS)
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.replace_words(F.col("t"), pairs)).alias("fixed_md5"), F.size(T.words_replaced(F.col("t"), pairs)).cast("int").alias("applied"))


def fix_units(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "m1 at 5rng").when(F.col("p_partkey") % 3 == 1, " kq m1").otherwise("rnrnHg")).alias("raw"))
    return parts.select("p_partkey", "raw", T.fix_units(F.col("raw")).alias("fixed"))


def script_score(spark, sf_dir):
    score = T.script_score(F.col("t"), "a-z", r"[^a-zA-Z0-9\s.,;:()/%+\-]")
    return _docs(spark, sf_dir).select("doc_id", score.alias("score"), T.confidence_level(score).alias("level"))


def charset_filters(spark, sf_dir):
    c = F.col("t")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.phone(c)).alias("phone_md5"), T.postal(c).alias("postal"), F.md5(T.keep_charset(c, "decimal")).alias("decimal_md5"))


def restore_point(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("raw"))
    return o.select("o_orderkey", "raw", T.restore_point(F.col("raw"), 20.0, 99.5).alias("fixed"))


def char_accuracy(spark, sf_dir):
    """Every line against a copy with confused glyphs.

    Distances cost far more than moving the texts, so documents are dealt out first, by the key that they are grouped by.
    """
    lines = _docs(spark, sf_dir).repartition("doc_id").select("doc_id", F.explode(F.split("t", "\n")).alias("truth"))
    read = lines.withColumn("read", F.translate("truth", "eot.", "c0t"))
    acc = read.withColumn("acc", F.round(T.char_accuracy(F.col("truth"), F.col("read")), 4))
    return acc.groupBy("doc_id").agg(F.round(F.sum("acc"), 4).alias("accuracy_sum"), F.count_if(F.col("truth") == F.col("read")).alias("exact"), F.count_if(F.col("acc") >= 0.8).alias("rough"), F.count(F.lit(1)).alias("n"))


def bounded_edit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("before"), F.concat(F.translate("p_name", "aeg", "eoq"), F.when(F.col("p_partkey") % 5 == 0, F.lit(" 7")).otherwise(F.lit(""))).alias("after"))
    return p.select("p_partkey", T.bounded_edit(F.col("before"), F.col("after")).alias("accepted"), F.round(T.char_overlap(F.col("before"), F.col("after")), 4).alias("overlap"))


def escapes(spark, sf_dir):
    c = F.col("t")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.csv_field(c)).alias("csv_md5"), F.md5(T.markdown_cell(c)).alias("md_md5"), T.masked_shape(c).alias("shape"))


def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


def notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = F.when(F.col("o_totalprice") > 300000, "large").otherwise("")
    both = T.add_note(T.add_note(first, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, "large").otherwise("odd"))
    return o.select("o_orderkey", both.alias("notes"))


def predicates(spark, sf_dir):
    """Display level, needs-check and short readings over customers."""
    c = table(spark, sf_dir, "customer").withColumn("confidence", F.round(F.abs("c_acctbal") / 10000, 3))
    level = F.when(F.col("c_custkey") % 11 == 0, "confirmed").when(F.col("c_custkey") % 7 == 0, "anonymised").when(F.col("c_custkey") % 5 == 0, "edited").otherwise(T.confidence_level(F.col("confidence")))
    blank = F.length(F.regexp_replace(F.col("c_nationkey").cast("string"), r"\s", "")) == 1
    return c.select("c_custkey", level.alias("shown"), level.isin("low", "medium").alias("needs_check"), F.when(blank, "").otherwise(F.col("c_nationkey").cast("string")).alias("value"), F.when(blank, F.least("confidence", F.lit(0.30))).otherwise(F.col("confidence")).alias("confidence"))


QUERIES = {f"text_{f.__name__}": f for f in (normalise, strip_noise, replace_words, fix_units, script_score, charset_filters, restore_point, char_accuracy, bounded_edit, escapes, strip_tags, notes, predicates)}

_D = "d AS (SELECT doc_id, text AS t FROM documents)"
_FIX = "replace(replace(replace(replace(replace(replace(t, 'teh', 'the'), 'thea', 'the a'), 'onof', 'on of'), 'tion', 'TION'), 'TIONs', 'TION s'), 'and', '&')"
_STEPS = ["t"]
for _w, _r in WORDS.items():
    _STEPS.append(f"replace({_STEPS[-1]}, '{_w}', '{_r}')")
_APPLIED = " + ".join(f"contains({s}, '{w}')::INT" for s, w in zip(_STEPS, WORDS))
_NOISE = r"""[|!"''`^~*#$&@={}<>\\]"""

ORACLE_SQL = {
    "text_normalise": rf"""WITH {_D}, f AS (SELECT doc_id, lower(regexp_replace(t, '[\s,.\-_/\\()\[\]:;''"]+', '', 'g')) AS form, translate(t, '015|', 'olsl') AS g FROM d)
        SELECT doc_id, md5(form) AS form_md5, md5(g) AS glyphs_md5, length(form) AS form_len FROM f""",
    "text_strip_noise": rf"""WITH {_D}, k AS (SELECT doc_id, t, regexp_replace(t, '([0-9])%', '\1' || chr(1), 'g') AS u FROM d),
        c AS (SELECT doc_id, length(u) - length(regexp_replace(u, '{_NOISE}|%', '', 'g')) AS dropped, trim(replace(regexp_replace(regexp_replace(u, '{_NOISE}|%', '', 'g'), ' {{2,}}', ' ', 'g'), chr(1), '%'), ' ') AS s FROM k)
        SELECT doc_id, md5(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '^[\s.,:;\-_]+', '')) AS clean_md5, dropped::INT AS dropped FROM c""",
    "text_replace_words": f"WITH {_D} SELECT doc_id, md5({_STEPS[-1]}) AS fixed_md5, {_APPLIED} AS applied FROM d",
    "text_fix_units": """SELECT p_partkey, p_size || CASE p_partkey % 3 WHEN 0 THEN 'm1 at 5rng' WHEN 1 THEN ' kq m1' ELSE 'rnrnHg' END AS raw,
        p_size || CASE p_partkey % 3 WHEN 0 THEN 'mL at 5mg' WHEN 1 THEN ' kg m1' ELSE 'mmHg' END AS fixed FROM part""",
    "text_script_score": rf"""WITH {_D}, n AS (SELECT doc_id, trim(t, ' ') AS t FROM d), s AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^a-zA-Z0-9\s.,;:()/%+\-]', '', 'g')) AS v, length(regexp_replace(t, '[^a-z]', '', 'g')) AS o, length(regexp_replace(t, '[^0-9]', '', 'g')) AS g FROM n),
        r AS (SELECT doc_id, CASE WHEN n = 0 THEN 1.0 WHEN g >= n * 0.6 THEN round(v / n, 3) ELSE round(least(1.0, v / n * 0.6 + least(o / n * 2, 1.0) * 0.4), 3) END AS score FROM s)
        SELECT doc_id, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM r""",
    "text_charset_filters": rf"""WITH {_D}, x AS (SELECT doc_id, t, regexp_replace(t, '[^0-9]', '', 'g') AS g, regexp_replace(t, '[^0-9.\n]', '', 'g') AS k FROM d)
        SELECT doc_id, md5(array_to_string(regexp_extract_all(t, '[0-9]+'), '-')) AS phone_md5, CASE WHEN length(g) >= 7 THEN substr(g, 1, 3) || '-' || substr(g, 4, 4) ELSE g END AS postal, md5(trim(regexp_replace(k, '\s+', ' ', 'g'), ' ')) AS decimal_md5 FROM x""",
    "text_restore_point": """WITH r AS (SELECT o_orderkey, o_custkey::VARCHAR AS raw FROM orders), m AS (SELECT *, regexp_replace(raw, '^(\\d+)(\\d)$', '\\1.\\2') AS moved FROM r)
        SELECT o_orderkey, raw, CASE WHEN length(raw) >= 2 AND NOT raw::DOUBLE BETWEEN 20 AND 99.5 AND moved::DOUBLE BETWEEN 20 AND 99.5 THEN moved ELSE raw END AS fixed FROM m""".replace("\\\\", "\\"),
    "text_char_accuracy": rf"""WITH {_D}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS truth FROM d), s AS (SELECT doc_id, truth, translate(truth, 'eot.', 'c0t') AS read FROM l),
        n AS (SELECT *, regexp_replace(truth, '\s+', '', 'g') AS a, regexp_replace(read, '\s+', '', 'g') AS b FROM s),
        c AS (SELECT *, round(CASE WHEN a = '' THEN CASE WHEN b = '' THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - levenshtein(a, b) / length(a)::DOUBLE) END, 4) AS acc FROM n)
        SELECT doc_id, round(sum(acc), 4) AS accuracy_sum, count(*) FILTER (truth = read) AS exact, count(*) FILTER (acc >= 0.8) AS rough, count(*) AS n FROM c GROUP BY 1""",
    "text_bounded_edit": """WITH p AS (SELECT p_partkey, p_name AS a, translate(p_name, 'aeg', 'eoq') || CASE WHEN p_partkey % 5 = 0 THEN ' 7' ELSE '' END AS b FROM part),
        x AS (SELECT *, list_distinct(string_split(a, '')) AS ca, list_distinct(string_split(b, '')) AS cb FROM p)
        SELECT p_partkey, abs(length(b) - length(a)) <= greatest(2, length(a) * 0.25) AND levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE <= 0.25 AND regexp_extract_all(a, '[0-9]+') = regexp_extract_all(b, '[0-9]+')
          AND len(list_filter(regexp_extract_all(b, '[A-Za-z]+'), lambda w: NOT list_contains(regexp_extract_all(a, '[A-Za-z]+'), w))) = 0 AS accepted,
          round(len(list_intersect(ca, cb)) / len(ca)::DOUBLE, 4) AS overlap FROM x""",
    "text_escapes": f"""WITH {_D} SELECT doc_id, md5(CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END) AS csv_md5, md5(regexp_replace(replace(t, '|', '\\|'), '\\r?\\n', '<br>', 'g')) AS md_md5, '（' || length(t) || '文字）' AS shape FROM d""",
    "text_strip_tags": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS text_md5 FROM pages""",
    "text_notes": """WITH n AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' ELSE '' END, o_orderstatus], lambda x: x <> '') AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'large' ELSE 'odd' END AS b FROM orders)
        SELECT o_orderkey, array_to_string(CASE WHEN list_contains(a, b) THEN a ELSE list_append(a, b) END, '／') AS notes FROM n""",
    "text_predicates": """WITH c AS (SELECT *, round(abs(c_acctbal) / 10000, 3) AS conf FROM customer), l AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'confirmed' WHEN c_custkey % 7 = 0 THEN 'anonymised' WHEN c_custkey % 5 = 0 THEN 'edited' WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.5 THEN 'medium' ELSE 'low' END AS shown FROM c)
        SELECT c_custkey, shown, shown IN ('low', 'medium') AS needs_check, CASE WHEN c_nationkey < 10 THEN '' ELSE c_nationkey::VARCHAR END AS value, CASE WHEN c_nationkey < 10 THEN least(conf, 0.3) ELSE conf END AS confidence FROM l""",
}
