"""Queries of spatial joins and numeric kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmend.functions import kernels as K
from quillmend.operators import spatial as S
from quillmend.sources.tables import table


def _boxes(spark, sf_dir, name="part"):
    """Boxes on pages (brands), from part keys."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), k.alias("box"), (k * 37 % 500).cast("double").alias("x0"), (k * 61 % 700).cast("double").alias("y0"), (k * 37 % 500 + 20 + F.col("p_size")).cast("double").alias("x1"), (k * 61 % 700 + 12).cast("double").alias("y1"))


_B = "b AS (SELECT p_brand AS page, p_partkey AS box, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 61 % 700)::DOUBLE AS y0, (p_partkey * 37 % 500 + 20 + p_size)::DOUBLE AS x1, (p_partkey * 61 % 700 + 12)::DOUBLE AS y1 FROM part)"


def interval_overlap(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    left = b.filter("box % 2 = 0").select("page", "box", "x0", "x1")
    right = b.filter("box % 2 = 1").select("page", F.col("box").alias("other"), F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    return S.overlap_totals(left, right, ["page"], ("x0", "x1"), ("r0", "r1")).withColumn("shared", F.round("shared", 2))


def best_overlap(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    t = b.filter("box % 2 = 0").select("page", F.col("box").alias("token"), F.col("x0").alias("tx0"), F.col("x1").alias("tx1"))
    l = b.filter("box % 2 = 1").select("page", F.col("box").alias("label"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"))
    return S.best_overlap(t, l, ["page"], "token", "label", 50.0)


def containment(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    rects = b.select("page", F.col("box").alias("rect"), F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), (F.col("x0") + 150).alias("rx1"), (F.col("y0") + 120).alias("ry1"))
    return S.texts_in(b, rects, ["page"], "box", "rect")


def zip_if_equal(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("band", F.floor(F.col("y0") / 70))
    left = b.filter("box % 2 = 0").select("page", "band", "box", "x0")
    right = b.filter("box % 2 = 1").select("page", "band", F.col("box").alias("line"), F.col("x0").alias("lx0"))
    return S.zip_if_equal(left, right, ["page", "band"], ["x0", "box"], ["lx0", "line"]).select("box", "line", "position")


def question_rows(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    boxes = b.filter("box % 2 = 0").select("page", (F.col("box") % 4).alias("field"), F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    lines = b.filter("box % 2 = 1").select("page", "x0", "y0", "x1", "y1", F.col("box").cast("string").alias("text"))
    return S.row_lines(lines, boxes, ["page"], "field")


def nearest(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    p = b.filter("box % 2 = 0").select("page", F.col("box").alias("point"), F.col("x0").alias("px"), F.col("y0").alias("py"))
    q = b.filter("box % 2 = 1").select("page", F.col("box").alias("target"), F.col("x0").alias("qx"), F.col("y0").alias("qy"))
    return S.nearest(p, q, ["page"], "point", "target", 110.0, 80.0)


def unknown_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    p = b.select("page", "box", F.col("x0").alias("px"), F.col("y0").alias("py"))
    q = b.filter("box % 2 = 1").select("page", F.col("x0").alias("qx"), F.col("y0").alias("qy"))
    return S.unknown_boxes(p.filter("box % 2 = 0"), q, ["page"], 30.0).select("page", "box")


def same_row(spark, sf_dir):
    f = _boxes(spark, sf_dir).select("page", F.col("box").alias("field"), "y0")
    return S.row_mates(f, ["page"], "field", "y0")


def suppress(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("score", (F.col("box") * 13 % 101) / 100.0).withColumn("x1", F.col("x0") + 160).withColumn("y1", F.col("y0") + 160)
    return S.suppress(b, ["page"], "score", "box", 0.3)


def thin_out(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("page", "box", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return S.thin_out(b, ["page"], "box", 40.0)


def label_rects(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("row", F.floor(F.col("y0") / 100))
    return S.label_rects(b, ["page"], "row", "box")


def snap_to_rules(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    rules = b.filter("box % 2 = 1").select("page", F.col("x0").alias("rule"))
    return S.snap_to_rules(b.filter("box % 2 = 0").select("page", "box", F.col("x0").alias("l"), F.col("x1").alias("r")), rules, ["page"], "box")


def row_signature(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    rows = b.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("row")).select("page", "row", (F.col("row") * 100.0).alias("top"), (F.col("row") * 100.0 + 100).alias("bottom"))
    return S.row_signature(rows, b.select("page", F.col("y0").alias("y")), ["page"], "row")


def anchored_rect(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("name", F.concat(F.lit("b"), (F.col("box") % 3).cast("string")))
    rules = spark.sql("SELECT * FROM VALUES ('f1', 'after', 'b0', null), ('f2', 'between', 'b0', 'b1'), ('f3', 'span', 'b2', null) AS t(field, rule, first, second)")
    return S.anchored_rect(rules, b.groupBy("page", "name").agg(F.min("x0").alias("x0"), F.min("x1").alias("x1")), ["page"], 4.0)


def restore_missing(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("page", "box", F.when(F.col("box") % 2 == 0, F.col("x0")).alias("measured"), F.when(F.col("box") % 3 == 0, F.col("y0")).alias("by_rule"), F.col("x1").alias("provisional"))
    return S.restored(b, b.filter("box % 5 > 0").withColumn("provisional", F.lit(-1.0)), ["page", "box"], ["measured", "by_rule", "provisional"]).select("page", "box", "rect")


def proportional_slots(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    s = b.select("page", "box", (F.col("x0") + 2).alias("s0"), (F.col("x0") + 9).alias("s1"))
    return S.proportional(s, b.select("page", "box", F.col("x0").alias("a0"), F.col("x1").alias("a1")), b.select("page", "box", F.col("y0").alias("b0"), (F.col("y0") + 50).alias("b1")), ["page", "box"]).select("box", "t0", "t1")


def mark_scores(spark, sf_dir):
    d = lambda n, m: (F.col("l_partkey") * n % m) / float(m)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (d(7, 101) * 0.4).alias("fill"), (d(11, 97) * 0.08).alias("ink"), (d(13, 89) * 0.4).alias("ring"), d(17, 83).alias("bias"), (d(19, 79) * 0.06).alias("out"), (d(23, 73) * 0.04).alias("edge"), (F.col("l_partkey") % 2 == 0).alias("cmp"))
    c = F.col
    s = K.mark_score(c("fill"), c("ink"), c("ring"), c("bias"), c("out"), c("edge"), c("cmp"))
    out = li.select("l_partkey", F.round(s, 4).alias("score"), "fill").distinct()
    return out.select("l_partkey", "score", K.score_confidence(F.col("score")).alias("confidence"), K.fill_confidence(F.col("fill")).alias("legacy"))


def page_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", K.page_match(F.col("p_size") * 3, F.col("p_partkey") % 200 + 1, 6).alias("score"))


def segments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", K.pick_segment(K.segment_means(F.col("v"), 5), 5).alias("p")).select("vec_id", "p.segment", "p.excess", "p.margin")


def ink_checks(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 200 / 10.0).alias("density"), F.length("p_name").alias("read"), F.when(c("p_partkey") % 4 == 0, "digits").otherwise("").alias("charset"), (c("p_partkey") % 5 == 0).alias("cl"), (c("p_partkey") % 7 == 0).alias("cr"))
    return p.select("p_partkey", K.ink_check(c("density"), c("read"), c("charset"), c("cl"), c("cr")).alias("k")).select("p_partkey", "k.penalty", "k.notes")


def ctc(spark, sf_dir):
    """Embeddings read as rows of four class scores."""
    e = table(spark, sf_dir, "embeddings")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: x.cast("double")))
    return e.select("vec_id", K.ctc_decode(steps).alias("d")).select("vec_id", F.array_join(F.col("d.classes").cast("array<string>"), "").alias("classes"), "d.mean")


def elementwise(spark, sf_dir):
    return K.elementwise(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 0.9, 0.0)


def mode_filter(spark, sf_dir):
    return K.mode_filter(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity"), "l_returnflag", "l_quantity", 5.0).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def monotone_medians(spark, sf_dir):
    return K.monotone_medians(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 5.0).select("l_returnflag", "bin", F.round("median", 4).alias("median"), F.round("monotone", 4).alias("monotone"))


def local_line(spark, sf_dir):
    return K.local_line(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_tax")


QUERIES = {f"space_{f.__name__}": f for f in (interval_overlap, best_overlap, containment, zip_if_equal, question_rows, nearest, unknown_boxes, same_row, suppress, thin_out, label_rects, snap_to_rules, row_signature, anchored_rect, restore_missing, proportional_slots)}
QUERIES |= {f"kernel_{f.__name__}": f for f in (mark_scores, page_matches, segments, ink_checks, ctc, elementwise, mode_filter, monotone_medians, local_line)}

_U = lambda v, a, b: f"greatest(0.0, least(1.0, ({v} - {a}) / ({b} - {a})))"
ORACLE_SQL = {
    "space_interval_overlap": f"""WITH {_B} SELECT l.page, count(*) AS pairs, round(sum(least(l.x1, r.x1) - greatest(l.x0, r.x0)), 2) AS shared FROM b l JOIN b r ON l.page = r.page AND l.x0 < r.x1 AND r.x0 < l.x1 WHERE l.box % 2 = 0 AND r.box % 2 = 1 GROUP BY 1""",
    "space_best_overlap": f"""WITH {_B}, p AS (SELECT t.page, t.box AS token, l.box AS label, least(t.x1, l.x1) - greatest(t.x0, l.x0) + CASE WHEN (t.x0 + t.x1) / 2 BETWEEN l.x0 AND l.x1 THEN 1000 ELSE 0 END AS c FROM b t JOIN b l ON t.page = l.page AND t.x0 < l.x1 AND l.x0 < t.x1 WHERE t.box % 2 = 0 AND l.box % 2 = 1)
        SELECT page, token, label FROM (SELECT *, row_number() OVER (PARTITION BY page, token ORDER BY c DESC, label) AS k FROM p) WHERE k = 1""",
    "space_containment": f"""WITH {_B}, r AS (SELECT page, box AS rect, x0 AS rx0, y0 AS ry0, x0 + 150 AS rx1, y0 + 120 AS ry1 FROM b)
        SELECT r.page, rect, string_agg(box::VARCHAR, ' ' ORDER BY y0, x0, box::VARCHAR) AS text FROM b JOIN r ON b.page = r.page AND greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= (x1 - x0) * (y1 - y0) * 0.55 GROUP BY 1, 2""",
    "space_zip_if_equal": f"""WITH {_B}, l AS (SELECT page, floor(y0 / 70) AS band, box, row_number() OVER (PARTITION BY page, floor(y0 / 70) ORDER BY x0, box) AS i, count(*) OVER (PARTITION BY page, floor(y0 / 70)) AS n FROM b WHERE box % 2 = 0), r AS (SELECT page, floor(y0 / 70) AS band, box AS line, row_number() OVER (PARTITION BY page, floor(y0 / 70) ORDER BY x0, box) AS i, count(*) OVER (PARTITION BY page, floor(y0 / 70)) AS n FROM b WHERE box % 2 = 1)
        SELECT box, line, i::INT AS position FROM l JOIN r USING (page, band, i, n)""",
    "space_question_rows": f"""WITH {_B}, h AS (SELECT DISTINCT l.page, q.box % 4 AS field, l.y0, l.x0, l.box::VARCHAR AS t FROM b l JOIN b q ON l.page = q.page WHERE q.box % 2 = 0 AND l.box % 2 = 1 AND (q.y0 + q.y1) / 2 BETWEEN l.y0 - 6 AND l.y1 + 6 AND l.x1 >= q.x0 - 10 AND l.x0 <= q.x1 + 10)
        SELECT page, field, string_agg(t, ' ' ORDER BY y0, x0, t) AS text FROM h GROUP BY 1, 2""",
    "space_nearest": f"""WITH {_B}, p AS (SELECT p.page, p.box AS point, q.box AS target, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0)) AS d FROM b p JOIN b q ON p.page = q.page WHERE p.box % 2 = 0 AND q.box % 2 = 1 AND abs(p.x0 - q.x0) <= 110 AND abs(p.y0 - q.y0) <= 80)
        SELECT page, point, target, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, point ORDER BY round(d, 9), target) AS k FROM p) WHERE k = 1""",
    "space_unknown_boxes": f"WITH {_B} SELECT page, box FROM b p WHERE box % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b q WHERE q.page = p.page AND q.box % 2 = 1 AND abs(p.x0 - q.x0) < 30 AND abs(p.y0 - q.y0) < 30)",
    "space_same_row": f"WITH {_B} SELECT a.page, a.box AS field, count(*) AS others FROM b a JOIN b c ON a.page = c.page AND abs(a.y0 - c.y0) <= 18 GROUP BY 1, 2",
    "space_suppress": f"""WITH RECURSIVE {_B}, o AS (SELECT page, box, x0, y0, x0 + 160 AS x1, y0 + 160 AS y1, row_number() OVER (PARTITION BY page ORDER BY (box * 13 % 101) / 100.0 DESC, box) AS i FROM b),
        k AS (SELECT page, 0::BIGINT AS i, []::STRUCT(b BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT page FROM o) UNION ALL SELECT o.page, o.i, CASE WHEN len(list_filter(kept, lambda v: greatest(0, 160 - abs(v.x - x0)) * greatest(0, 160 - abs(v.y - y0)) / (51200 - greatest(0, 160 - abs(v.x - x0)) * greatest(0, 160 - abs(v.y - y0))) >= 0.3)) > 0 THEN kept ELSE list_append(kept, {{'b': box, 'x': x0, 'y': y0}}) END FROM k JOIN o ON o.page = k.page AND o.i = k.i + 1),
        l AS (SELECT page, arg_max(kept, i) AS kept FROM k GROUP BY 1) SELECT page, u.b AS box FROM (SELECT page, unnest(kept) AS u FROM l)""",
    "space_thin_out": f"""WITH RECURSIVE {_B}, o AS (SELECT page, box, x0, y0, row_number() OVER (PARTITION BY page ORDER BY box) AS i FROM b),
        k AS (SELECT page, 0::BIGINT AS i, []::STRUCT(b BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM (SELECT DISTINCT page FROM o) UNION ALL SELECT o.page, o.i, CASE WHEN len(list_filter(kept, lambda v: abs(v.x - x0) < 40 AND abs(v.y - y0) < 40)) > 0 THEN kept ELSE list_append(kept, {{'b': box, 'x': x0, 'y': y0}}) END FROM k JOIN o ON o.page = k.page AND o.i = k.i + 1),
        l AS (SELECT page, arg_max(kept, i) AS kept FROM k GROUP BY 1) SELECT page, u.b AS box FROM (SELECT page, unnest(kept) AS u FROM l)""",
    "space_label_rects": f"""WITH {_B} SELECT page, box, x1 AS left, round(greatest(least(x1 + (x1 - x0) * 9, coalesce(lead(x0) OVER (PARTITION BY page, floor(y0 / 100) ORDER BY x0, box) - (x1 - x0) * 0.6, 1e12)), x1), 4) AS right FROM b""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'),
    "space_snap_to_rules": f"""WITH {_B} SELECT q.page, q.box, coalesce((SELECT max(x0) FROM b r WHERE r.page = q.page AND r.box % 2 = 1 AND r.x0 <= q.x0), q.x0) AS "left", coalesce((SELECT min(x0) FROM b r WHERE r.page = q.page AND r.box % 2 = 1 AND r.x0 >= q.x1), q.x1) AS "right" FROM b q WHERE q.box % 2 = 0""",
    "space_row_signature": f"WITH {_B}, r AS (SELECT page, unnest(range(7))::INT AS row FROM (SELECT DISTINCT page FROM b)) SELECT r.page, row, count(*) FILTER (y0 >= row * 100 AND y0 < row * 100 + 100) AS boxes FROM r JOIN b USING (page) GROUP BY 1, 2",
    "space_anchored_rect": f"""WITH {_B}, n AS (SELECT page, 'b' || (box % 3) AS name, min(x0) AS x0, min(x1) AS x1 FROM b GROUP BY 1, 2), r AS (SELECT * FROM (VALUES ('f1', 'after', 'b0', NULL), ('f2', 'between', 'b0', 'b1'), ('f3', 'span', 'b2', NULL)) AS t(field, rule, first, second))
        SELECT a.page, field, CASE WHEN rule = 'span' THEN 0.0 ELSE a.x1 + 4 END AS "left", CASE WHEN rule = 'between' THEN c.x0 - 4 WHEN rule = 'after' THEN a.x1 + 4 + 10 * (a.x1 - a.x0) ELSE a.x0 - 4 END AS "right" FROM r JOIN n a ON a.name = first LEFT JOIN n c ON c.name = second AND c.page = a.page""",
    "space_restore_missing": f"WITH {_B} SELECT page, box, CASE WHEN box % 2 = 0 THEN x0 WHEN box % 3 = 0 THEN y0 WHEN box % 5 > 0 THEN -1.0 ELSE x1 END AS rect FROM b",
    "space_proportional_slots": f"WITH {_B} SELECT box, round(y0 + 2 * 50 / (x1 - x0), 4) AS t0, round(y0 + 9 * 50 / (x1 - x0), 4) AS t1 FROM b",
    "kernel_mark_scores": f"""WITH k AS (SELECT DISTINCT l_partkey, (l_partkey * 7 % 101) / 101.0::DOUBLE * 0.4 AS fill, (l_partkey * 11 % 97) / 97.0::DOUBLE * 0.08 AS ink, (l_partkey * 13 % 89) / 89.0::DOUBLE * 0.4 AS ring, (l_partkey * 17 % 83) / 83.0::DOUBLE AS bias, (l_partkey * 19 % 79) / 79.0::DOUBLE * 0.06 AS o, (l_partkey * 23 % 73) / 73.0::DOUBLE * 0.04 AS e FROM lineitem),
        s AS (SELECT l_partkey, fill, round(CASE WHEN l_partkey % 2 = 0 THEN greatest({_U('fill', 0.10, 0.28)}, {_U('ink', 0.02, 0.06)}, CASE WHEN bias <= 0.5 THEN {_U('ring', 0.10, 0.30)} ELSE 0.0 END, least({_U('o', 0.015, 0.045)}, {_U('e', 0.010, 0.030)})) ELSE {_U('fill', 0.10, 0.28)} END, 4) AS score FROM k)
        SELECT l_partkey, score, round(least(1.0, 0.45 + abs(score - 0.5) * 1.1), 3) AS confidence, round(CASE WHEN fill <= 0.1 THEN least(1.0, 0.55 + (0.1 - fill) / 0.1 * 0.45) WHEN fill >= 0.28 THEN least(1.0, 0.55 + (fill - 0.28) / 0.35 * 0.45) ELSE 0.15 + abs(fill - 0.19) / 0.09 * 0.35 END, 3) AS legacy FROM s""",
    "kernel_page_matches": "SELECT p_partkey, CASE WHEN p_size * 3 >= 25 AND p_size * 3 / (p_partkey % 200 + 1)::DOUBLE >= 0.3 THEN round(0.6 * (p_size * 3 / (p_partkey % 200 + 1)::DOUBLE) + 0.4 * least(p_size * 3 / 120.0::DOUBLE, 1.0), 6) END AS score FROM part",
    "kernel_segments": """WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v, len(embedding) AS n FROM embeddings), m AS (SELECT vec_id, [list_sum(v[(n * i // 5 + 1):(n * (i + 1) // 5)]) / (n * (i + 1) // 5 - n * i // 5) for i in [0, 1, 2, 3, 4]] AS m FROM v), s AS (SELECT vec_id, m, list_sort(m) AS s FROM m)
        SELECT vec_id, (list_position(m, s[5]) - 1)::INT AS segment, round(s[5] - s[3], 4) AS excess, round(s[5] - s[4], 4) AS margin FROM s""",
    "kernel_ink_checks": """WITH p AS (SELECT p_partkey, p_partkey * 7 % 200 / 10.0::DOUBLE AS d, length(p_name) AS r, p_partkey % 4 = 0 AS c FROM part), q AS (SELECT *, floor(d / 1.7 + 0.5) AS lo, floor(d / 0.35 + 0.5) AS hi FROM p),
        f AS (SELECT *, d < 0.25 AND r >= 1 AS e, NOT (d < 0.25 AND r >= 1) AND NOT c AND lo >= 3 AND r < lo * 0.8 AS s, NOT (d < 0.25 AND r >= 1) AND NOT c AND NOT (lo >= 3 AND r < lo * 0.8) AND r > hi + 2 AS l FROM q)
        SELECT p_partkey, round(CASE WHEN e THEN 0.35 ELSE 1 END * CASE WHEN s OR l THEN 0.8 ELSE 1 END * CASE WHEN p_partkey % 5 = 0 THEN 0.9 ELSE 1 END * CASE WHEN p_partkey % 7 = 0 THEN 0.9 ELSE 1 END, 4)::DOUBLE AS penalty, concat_ws('; ', CASE WHEN e THEN 'no ink' END, CASE WHEN s THEN 'too short' END, CASE WHEN l THEN 'too long' END, CASE WHEN p_partkey % 5 = 0 THEN 'cut left' END, CASE WHEN p_partkey % 7 = 0 THEN 'cut right' END) AS notes FROM f""",
    "kernel_ctc": """WITH s AS (SELECT vec_id, i, embedding[i * 4 + 1:i * 4 + 4] AS s FROM embeddings, range(8) t(i)), b AS (SELECT vec_id, i, list_position(s, list_max(s)) - 1 AS c, list_max(s)::DOUBLE AS m FROM s), l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM b)
        SELECT vec_id, coalesce(string_agg(c::VARCHAR, '' ORDER BY i) FILTER (c <> 0 AND (p IS NULL OR p <> c)), '') AS classes, round(sum(m) / 8, 4) AS mean FROM l GROUP BY 1""",
    "kernel_elementwise": """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, pos::INT AS pos, round(quantile_cont(v, 0.9), 4) AS percentile, round(avg((v > 0)::INT), 4) AS share, count(*) AS n FROM e GROUP BY 1, 2""",
    "kernel_mode_filter": """WITH b AS (SELECT l_returnflag, floor(l_quantity / 5) AS bin, count(*) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, arg_min(bin, -c * 1000 + bin) * 5 AS mode FROM b GROUP BY 1)
        SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem JOIN m USING (l_returnflag) WHERE abs(l_quantity - mode) <= abs(mode) * 0.15 GROUP BY 1""",
    "kernel_monotone_medians": """WITH m AS (SELECT l_returnflag, floor(l_quantity / 5)::BIGINT AS bin, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, bin, round(median, 4) AS median, round(max(median) OVER (PARTITION BY l_returnflag ORDER BY bin), 4) AS monotone FROM m""",
    "kernel_local_line": "SELECT l_returnflag, round(regr_slope(l_tax, l_quantity), 6) AS slope, round(regr_intercept(l_tax, l_quantity), 6) AS intercept FROM lineitem GROUP BY 1",
}
