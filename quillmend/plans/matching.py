"""Queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.functions import similarity as S
from quillmend.functions import text as T
from quillmend.operators import matching as M
from quillmend.sources.tables import table

# The likeness of two ASCII forms a and b, for pairs in a relation p(a, b).
SIM_SQL = """
 b2 AS (SELECT a, b, CASE WHEN length(a) >= 2 THEN list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) ELSE [a] END AS ga,
        CASE WHEN length(b) >= 2 THEN list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) ELSE [b] END AS gb FROM p),
 s0 AS (SELECT a, b, 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) AS d,
        CASE WHEN contains(a, b) THEN 0.55 + 0.35 * length(b) / length(a) ELSE 0.0 END AS h,
        CASE WHEN length(b) > length(a) THEN greatest(0.0, 1.0 - levenshtein(a, b) / length(b)::DOUBLE)
             ELSE greatest(0.0, list_max(list_transform(range(1, length(a) - length(b) + 2), lambda i: greatest(
                1.0 - levenshtein(substr(a, i, length(b)), b) / length(b)::DOUBLE,
                1.0 - levenshtein(substr(a, i, least(length(b) + 2, length(a) - i + 1)), b) / greatest(least(length(b) + 2, length(a) - i + 1), length(b))::DOUBLE)))) END AS w FROM b2),
 sim AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(greatest(d, h, w), 4) END AS score FROM s0)
"""


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    return words.withColumn("form", T.match_form(F.col("word"), compose=False))


def type_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("term")).distinct().withColumn("form", T.match_form(F.col("term"), compose=False))


def flagship_standardise_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a part's name against the lexicon of types: adopted value, confidence and level."""
    words = part_words(spark, sf_dir).withColumn("confidence", F.lit(0.6))
    hits = M.top_terms(words, "form", type_lexicon(spark, sf_dir), k=3)
    out = M.decide(words, "word", "form", "confidence", hits)
    return out.select("p_partkey", "pos", "word", "adopted", "adopted_confidence", T.confidence_level(F.col("adopted_confidence")).alias("level"))


def lexicon_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_terms(part_words(spark, sf_dir), "form", type_lexicon(spark, sf_dir), k=3).select("form", "rank", "term", "score")


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its own type."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("score"), F.round(S.dice(F.col("a"), F.col("b")), 4).alias("dice"), S.is_shortening(F.col("a"), F.col("b")).alias("shortening"))


def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = M.top_terms(part_words(spark, sf_dir), "form", type_lexicon(spark, sf_dir), k=1)
    codes = type_lexicon(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), F.length("term").cast("string")))
    return M.nearest_code(hits, "form", codes)


def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("ordinal"))
    queries = spark.sql("SELECT explode(array('re', 'small', 'g', 'o', 'hot rin', 'smal bolt')) AS query")
    return M.suggest(names.withColumn("form", F.col("term")), "term", "form", "ordinal", queries, "query", k=5)


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are no near copy of a line repeated in many of them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    repeated = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 5").select("line")
    return M.drop_boilerplate(lines, "line", repeated, "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines_kept"))


def infer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("ord"), F.lower(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus")).alias("form"))
    regions = spark.sql("SELECT * FROM VALUES ('high', 'high-', 1), ('urgent', 'urgent', 2), ('low', 'low', 3), ('medium', 'mediums', 4) AS t(region, rform, at)")
    return M.infer_region(texts, "o_orderkey", "ord", "form", regions, "region", "rform", "at")


def unique_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "part").select("p_name", "p_type")
    return M.unique_parent(parents.select("p_name").distinct(), "p_name", parents, "p_name", "p_type")


def nearest_by_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = M.top_terms(part_words(spark, sf_dir), "form", type_lexicon(spark, sf_dir), k=2)
    return M.nearest_by_margin(hits, "form", 0.35, 0.02)


def directory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names with a digit misread, against the suppliers of the same nation."""
    directory = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), F.col("s_name").alias("name"))
    readings = directory.select("region", F.regexp_replace("name", "#0", "#O").alias("text"))
    return M.match_directory(readings, "text", "region", directory, "name", lambda c: T.match_form(c, compose=False), k=3, least=0.55)


def pick_from_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return M.pick_from_directory(names.withColumn("form", F.col("name")), "name", "form", "hot rin").select("name", "kind", "rank", "score")


_WORDS = "w AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos, unnest(string_split(p_name, ' ')) AS word FROM part), l AS (SELECT DISTINCT p_type AS term, lower(p_type) AS form FROM part), p AS (SELECT DISTINCT word AS a, form AS b FROM w, l)"
_RANKED = f"{_WORDS}, {SIM_SQL}, r AS (SELECT a, b, l.term, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, length(b) DESC, l.term) AS rank FROM sim JOIN l ON l.form = b WHERE score >= 0.34)"
_SHORT = "regexp_replace(concat(substr(a, 1, instr(a, b) - 1), substr(a, instr(a, b) + length(b))), '[ .,:;!?()/|-]+', '', 'g') <> ''"

QUERIES = {
    "flagship_standardise_parts": flagship_standardise_parts,
    "match_lexicon_top_k": lexicon_top_k,
    "match_similarity_pairs": similarity_pairs,
    "match_nearest_code": nearest_code,
    "match_suggest": suggest_names,
    "match_boilerplate_lines": boilerplate_lines,
    "match_infer_region": infer_region,
    "match_unique_parent": unique_parent,
    "match_nearest_by_margin": nearest_by_margin,
    "match_directory": directory_match,
    "match_directory_picker": pick_from_directory,
}

ORACLE_SQL = {
    "flagship_standardise_parts": f"""WITH {_RANKED},
        best AS (SELECT * FROM r WHERE rank = 1), ex AS (SELECT a, min_by(term, rank) AS exact FROM r WHERE rank <= 3 AND a = b GROUP BY a),
        j AS (SELECT w.*, exact, best.term AS bt, score, contains(best.a, best.b) AND {_SHORT.replace('(a', '(best.a').replace(', b', ', best.b').replace('length(b)', 'length(best.b)').replace(' a,', ' best.a,')} AS short FROM w LEFT JOIN best ON best.a = word LEFT JOIN ex ON ex.a = word),
        o AS (SELECT p_partkey, pos, word, CASE WHEN exact IS NOT NULL THEN exact WHEN bt IS NULL OR short OR score < 0.72 THEN word ELSE bt END AS adopted,
              round(CASE WHEN exact IS NOT NULL THEN 0.8 WHEN bt IS NULL THEN 0.42 WHEN short OR score < 0.72 THEN 0.45 ELSE least(0.95, 0.3 + score * 0.5) END, 3) AS adopted_confidence FROM j)
        SELECT *, CASE WHEN adopted_confidence >= 0.8 THEN 'high' WHEN adopted_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM o""",
    "match_lexicon_top_k": f"WITH {_RANKED} SELECT a AS form, rank, term, score FROM r WHERE rank <= 3",
    "match_similarity_pairs": f"""WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part), {SIM_SQL}
        SELECT a, b, score, round(d, 4) AS dice, contains(a, b) AND {_SHORT} AS shortening FROM sim JOIN s0 USING (a, b)""",
    "match_nearest_code": f"WITH {_RANKED} SELECT a AS form, term, 'C' || length(term) AS code, score, a = b AS exact FROM r WHERE rank = 1 AND score >= 0.6",
    "match_suggest": f"""WITH n AS (SELECT p_name AS term, min(p_partkey) AS ordinal FROM part GROUP BY 1), q AS (SELECT unnest(['re', 'small', 'g', 'o', 'hot rin', 'smal bolt']) AS query), p AS (SELECT query AS a, term AS b FROM n, q), {SIM_SQL},
        h AS (SELECT query, term, ordinal, score, CASE WHEN starts_with(term, query) THEN 0 WHEN contains(term, query) THEN 1 ELSE 2 END AS kind FROM sim JOIN n ON term = b JOIN q ON query = a)
        SELECT query, rank, kind, term AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY kind, CASE WHEN kind < 2 THEN 0 ELSE -score END, ordinal) AS rank FROM h WHERE kind < 2 OR score >= 0.45) WHERE rank <= 5""",
    "match_boilerplate_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT * FROM l WHERE line <> ''),
        rep AS (SELECT line FROM s GROUP BY line HAVING count(DISTINCT doc_id) >= 5),
        p AS (SELECT DISTINCT s.line AS a, rep.line AS b FROM (SELECT DISTINCT line FROM s) s, rep WHERE least(length(s.line), length(rep.line)) / greatest(length(s.line), length(rep.line))::DOUBLE >= 0.7), {SIM_SQL},
        gone AS (SELECT DISTINCT a FROM sim WHERE score >= 0.8)
        SELECT doc_id, count(*) AS lines_kept FROM s WHERE line NOT IN (SELECT a FROM gone) GROUP BY doc_id""",
    "match_directory": f"""WITH d AS (SELECT s_nationkey AS region, s_name AS name, regexp_replace(s_name, '#0', '#O') AS text FROM supplier), x AS (SELECT l.region, l.text, r.name, lower(l.text) AS a, lower(r.name) AS b FROM d l JOIN d r ON l.region = r.region),
        p AS (SELECT DISTINCT a, b FROM x), {SIM_SQL}, r AS (SELECT text, region, name, round(score, 3) AS score FROM x JOIN sim USING (a, b) WHERE score >= 0.55)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text, region ORDER BY score DESC, length(name), name) AS rank FROM r) WHERE rank <= 3""",
    "match_directory_picker": f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), held AS (SELECT name, 0 AS kind, 1.0::DOUBLE AS score FROM n WHERE contains(name, 'hot rin') ORDER BY name LIMIT 40), p AS (SELECT 'hot rin' AS a, name AS b FROM n WHERE NOT contains(name, 'hot rin')), {SIM_SQL},
        near AS (SELECT b AS name, 1 AS kind, score FROM sim WHERE score >= 0.5 AND (SELECT count(*) FROM held) < 8 ORDER BY score DESC, b LIMIT 20)
        SELECT name, kind, row_number() OVER (ORDER BY kind, score DESC, name) AS rank, score FROM (SELECT * FROM held UNION ALL SELECT * FROM near)""",
    "match_infer_region": """WITH t AS (SELECT o_orderkey, lower(o_orderpriority || ' ' || o_orderstatus) AS form FROM orders),
        r AS (SELECT * FROM (VALUES ('high', 'high-', 1), ('urgent', 'urgent', 2), ('low', 'low', 3), ('medium', 'mediums', 4)) AS v(region, rform, ord)),
        b AS (SELECT region, ord, 0 AS pass, rform AS f FROM r UNION ALL SELECT region, ord, 1, substr(rform, 1, length(rform) - 1) FROM r)
        SELECT o_orderkey, arg_min(region, pass * 10 + ord) AS region FROM t JOIN b ON contains(form, f) GROUP BY 1""",
    "match_unique_parent": "WITH n AS (SELECT p_name, min(p_type) AS p, count(DISTINCT p_type) AS c FROM part GROUP BY 1) SELECT p_name, CASE WHEN c = 1 THEN p END AS parent FROM n",
    "match_nearest_by_margin": f"WITH {_RANKED}, m AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY a ORDER BY rank), -1) AS ahead FROM r WHERE rank <= 2) SELECT a AS form, term, score FROM m WHERE rank = 1 AND score >= 0.35 AND ahead >= 0.02",
}
