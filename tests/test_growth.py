"""Work and results of operators where a key has many rows that meet: no more rows than its input calls for, and what brute force gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmend.operators import spatial as S


def most_rows(frame):
    """The rows of the largest step of a query that was run."""
    frame.collect()
    most, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        if name.startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return most


def sides(n, seed, step=0.25):
    """Boxes (page, number, x0, y0, x1, y1) on two pages, at places of a grid."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 1200) * step, rng.randrange(0, 900) * step
        out.append(("ab"[i % 2], i, x, y, x + rng.randrange(0, 160) * step, y + rng.randrange(1, 60) * step))
    return out


BOX = "page string, box long, x0 double, y0 double, x1 double, y1 double"


def test_texts_of_rectangles_equal_those_of_pairs(spark):
    lines = spark.createDataFrame(sides(400, 5), BOX)
    rects = spark.createDataFrame(sides(200, 6), BOX).selectExpr("page", "box AS rect", "x0 AS rx0", "y0 AS ry0", "x0 + 150 AS rx1", "y0 + 120 AS ry1")
    rects = rects.unionByName(rects.withColumn("rect", F.col("rect") + 1000))
    pairs, whole = S.text_of(S.lines_in(lines, rects, ["page"], "box", "rect"), ["page"], "rect", "box"), S.texts_in(lines, rects, ["page"], "box", "rect")
    assert whole.columns == pairs.columns
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, pairs.collect()))


def test_texts_of_equal_rectangles_are_worked_out_once(spark, tmp_path):
    from quillmend.plans import spatial as P

    k = F.col("id")
    spark.range(4000).select((k * 3500).alias("p_partkey"), F.lit("one").alias("p_brand"), F.lit(5).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    assert most_rows(P.containment(spark, str(tmp_path))) <= 16_000


def test_best_labels_equal_brute_force(spark):
    a, b = sides(300, 3), sides(300, 4)
    want = {}
    for p, t, t0, _, t1, _ in a:
        found = [(-(min(t1, l1) - max(t0, l0) + (1000 if l0 <= (t0 + t1) / 2 <= l1 else 0)), n) for q, n, l0, _, l1, _ in b if p == q and t0 < l1 and l0 < t1]
        if found:
            want[t] = min(found)[1]
    tokens, labels = spark.createDataFrame(a, BOX).selectExpr("page", "box AS token", "x0 AS tx0", "x1 AS tx1"), spark.createDataFrame(b, BOX).selectExpr("page", "box AS label", "x0 AS lx0", "x1 AS lx1")
    assert {r["token"]: r["label"] for r in S.best_overlap(tokens, labels, ["page"], "token", "label", 50.0).collect()} == want


def test_best_labels_make_no_pairs(spark):
    k = F.col("id")
    rows = spark.range(4000).select(F.lit("one").alias("page"), k.alias("token"), (k * 37 % 500 / 7).alias("tx0"), (k * 37 % 500 / 7 + 20 + k % 50).alias("tx1"))
    labels = rows.withColumnsRenamed({"token": "label", "tx0": "lx0", "tx1": "lx1"})
    assert most_rows(S.best_overlap(rows, labels, ["page"], "token", "label", 50.0)) <= 16_000


def test_overlaps_are_counted_without_pairs(spark):
    a, b = sides(300, 1), sides(300, 2)
    want = {}
    for p, _, x0, _, x1, _ in a:
        for q, _, r0, _, r1, _ in b:
            if p == q and x0 < r1 and r0 < x1:
                n, s = want.get(p, (0, 0.0))
                want[p] = n + 1, s + min(x1, r1) - max(x0, r0)
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX).withColumnsRenamed({"x0": "r0", "x1": "r1"})
    got = S.overlap_totals(left, right, ["page"], ("x0", "x1"), ("r0", "r1"))
    assert {r["page"]: (r["pairs"], r["shared"]) for r in got.collect()} == want


def test_interval_overlap_query_makes_no_pairs(spark, tmp_path):
    from quillmend.plans import spatial as P

    k = F.col("id")
    spark.range(4000).select(k.alias("p_partkey"), F.lit("one").alias("p_brand"), (k % 50 + 1).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    assert most_rows(P.interval_overlap(spark, str(tmp_path))) <= 16_000


def test_nearest_of_places_that_repeat(spark):
    a, b = sides(300, 7, 10.0), sides(300, 8, 10.0)
    a, b = a + a[:1], b + [(p, n + 1000, *rest) for p, n, *rest in b]
    want = {}
    for p, i, x, y, _, _ in a:
        found = [(round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 9), n) for q, n, u, v, _, _ in b if p == q and abs(x - u) <= 110 and abs(y - v) <= 80]
        if found:
            want[i] = min(found)
    points, targets = spark.createDataFrame(a, BOX).selectExpr("page", "box AS point", "x0 AS px", "y0 AS py"), spark.createDataFrame(b, BOX).selectExpr("page", "box AS target", "x0 AS qx", "y0 AS qy")
    got = S.nearest(points, targets, ["page"], "point", "target", 110.0, 80.0)
    assert {r["point"]: (r["distance"], r["target"]) for r in got.collect()} == {k: (pytest.approx(d, abs=1e-4), n) for k, (d, n) in want.items()}


def test_places_that_repeat_meet_once(spark):
    k = F.col("id")
    points = spark.range(4000).select(F.lit("one").alias("page"), k.alias("point"), (k % 40).cast("double").alias("px"), (k % 40).cast("double").alias("py"))
    targets = points.withColumnsRenamed({"point": "target", "px": "qx", "py": "qy"})
    assert most_rows(S.nearest(points, targets, ["page"], "point", "target", 110.0, 80.0)) <= 16_000


def test_row_mates_equal_pairs(spark):
    fields = spark.createDataFrame(sides(400, 9, 0.1), BOX).selectExpr("page", "box AS field", "y0")
    pairs = S.same_row(fields, ["page"], "field", "y0").groupBy("page", "field").agg(F.count(F.lit(1)).alias("others"))
    counted = S.row_mates(fields, ["page"], "field", "y0")
    assert counted.columns == pairs.columns and counted.dtypes == pairs.dtypes
    assert Counter(map(tuple, counted.collect())) == Counter(map(tuple, pairs.collect()))


def test_row_mates_query_makes_no_pairs(spark, tmp_path):
    from quillmend.plans import spatial as P

    k = F.col("id")
    spark.range(4000).select(k.alias("p_partkey"), F.lit("one").alias("p_brand"), F.lit(5).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    assert most_rows(P.same_row(spark, str(tmp_path))) <= 16_000


def test_lines_of_fields_equal_brute_force(spark):
    a, b = sides(200, 10), sides(60, 11)
    want = {}
    for p, n, x0, y0, x1, y1 in a:
        for q, m, u0, v0, u1, v1 in b:
            if p == q and y0 - 6 <= (v0 + v1) / 2 <= y1 + 6 and x1 >= u0 - 10 and x0 <= u1 + 10:
                want.setdefault((p, m % 3), set()).add((y0, x0, str(n)))
    lines = spark.createDataFrame(a, BOX).withColumn("text", F.col("box").cast("string")).drop("box")
    boxes = spark.createDataFrame(b, BOX).selectExpr("page", "box % 3 AS field", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1")
    assert {(r["page"], r["field"]): r["text"] for r in S.row_lines(lines, boxes, ["page"], "field").collect()} == {k: " ".join(t for _, _, t in sorted(v)) for k, v in want.items()}


def test_boxes_of_a_field_meet_lines_once(spark):
    k = F.col("id")
    boxes = spark.range(4000).select(F.lit("one").alias("page"), (k % 2).alias("field"), (k % 100).cast("double").alias("bx0"), (k % 5 * 7.0).alias("by0"), (k % 100 + 12.0).alias("bx1"), (k % 5 * 7.0 + 4).alias("by1"))
    lines = spark.range(1000).select(F.lit("one").alias("page"), F.lit(3.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(8.0).alias("y1"), k.cast("string").alias("text"))
    assert most_rows(S.row_lines(lines, boxes, ["page"], "field")) <= 16_000


def test_known_places_that_repeat_are_spread_once(spark):
    k = F.col("id")
    found = spark.range(1000).select(F.lit("one").alias("page"), k.alias("box"), (k % 50).cast("double").alias("px"), (k % 7).cast("double").alias("py"))
    known = spark.range(4000).select(F.lit("one").alias("page"), (k % 20).cast("double").alias("qx"), F.lit(0.0).alias("qy"))
    left = S.unknown_boxes(found, known, ["page"], 30.0)
    assert most_rows(left) <= 4000
    assert {r["box"] for r in left.collect()} == {i for i in range(1000) if i % 50 == 49}


def test_alignment_keeps_a_small_part_of_the_totals():
    import tracemalloc

    from quillmend.operators import forms

    rng = random.Random(12)
    a, b = ([(rng.randrange(5), i / 1500) for i in range(1500)] for _ in "ab")
    tracemalloc.start()
    pairs = forms.aligned(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1500 * 1500 * 8 / 4  # the whole table of totals has four times as much
    assert all(p < q for c in (0, 1) for p, q in zip([p[c] for p in pairs], [p[c] for p in pairs][1:]))


def test_alignment_of_long_and_short_sequences_has_the_best_total():
    import numpy as np

    from quillmend.operators import forms

    rng = random.Random(13)
    for n, m in ((700, 60), (60, 700), (400, 380)):
        a, b = ([(rng.randrange(5), rng.random()) for _ in range(k)] for k in (n, m))
        gains = forms.pairing_gains(*(np.array(s, float) for s in (a, b)))
        best = [-forms.SKIP * j for j in range(m + 1)]
        for i in range(n):
            row = [best[0] - forms.SKIP]
            for j in range(m):
                row.append(max(best[j] + gains[i, j], best[j + 1] - forms.SKIP, row[j] - forms.SKIP))
            best = row
        pairs = forms.aligned(a, b)
        assert sum(gains[i, j] for i, j in pairs) - forms.SKIP * (n + m - 2 * len(pairs)) == pytest.approx(best[-1], abs=1e-6)


def test_aligned_keys_are_dealt_out(spark):
    from quillmend.operators import forms

    rows = spark.range(6).selectExpr("id AS k", "array(struct(1D AS n, 0D AS m)) AS a", "array(struct(1D AS n, 0D AS m)) AS b").coalesce(1)
    assert forms.align_sequences(rows, "k", "a", "b").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def edits_between(a, b, anywhere=False):
    """Edits from a to b, or to its nearest stretch."""
    row = [0 if anywhere else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return min(row) if anywhere else row[-1]


def test_bounds_of_directory_names_hold(spark):
    from quillmend.functions import similarity
    from quillmend.operators import matching as M

    rng = random.Random(14)
    word = lambda most: "".join(rng.choice("abc#0") for _ in range(rng.randrange(1, most)))
    forms = [word(14) for _ in range(60)] + [word(14) * 9 for _ in range(4)] + ["ab#0" * 16]
    readings = [word(14) for _ in range(30)] + ["ab#0" * 16, forms[62]]
    groups = similarity.components_of([("a", "0")])
    for group in (None, groups):
        near = M.DirectoryForms(forms, list(range(len(forms))), group)
        pairs = []
        for r in readings:
            some, least, most = near.bounds(r)
            pairs += [(r, f, float(lo), float(hi)) for f, lo, hi in zip(near.forms[some], least, most)]
        rows = spark.createDataFrame(pairs, "a string, b string, lo double, hi double")
        wrong = rows.withColumn("s", similarity.similarity(F.col("a"), F.col("b"), group)).filter("s < lo - 0.00011 or s > hi + 0.00011").collect()
        assert not wrong and len(pairs) > 500
    near = M.DirectoryForms(forms, list(range(len(forms))))
    for r in readings[:8]:
        for anywhere in (False, True):
            got = near.edits(r, slice(0, None), anywhere, near.masks).tolist()
            assert got == [0 if len(f) > 64 else edits_between(f, r, anywhere) for f in near.forms]


def test_directory_meets_few_names(spark):
    from quillmend.functions import similarity
    from quillmend.operators import matching as M

    names = spark.range(600).select(F.lit(1).alias("region"), F.format_string("name of house %06d", F.col("id") * 7919 % 999983).alias("name"))
    reads = names.select("region", F.regexp_replace("name", "of", "oi").alias("t"))
    found = M.match_directory(reads, "t", "region", names, "name", lambda c: F.lower(c), k=3)
    assert most_rows(found) <= 600 * 20
    # The best of all pairs, in the order of score, length and name.
    score = F.round(similarity.similarity(F.lower("t"), F.lower("name")), 3)
    pairs = reads.limit(40).crossJoin(names.select("name")).withColumn("score", score).collect()
    want = {t: [(n, s) for s, n in sorted((-r["score"], r["name"]) for r in pairs if r["t"] == t)[:3]] for t in {r["t"] for r in pairs}}
    got = {}
    for r in found.orderBy("t", "rank").collect():
        got.setdefault(r["t"], []).append((r["name"], -r["score"]))
    assert {t: got[t] for t in want} == want


def python_rows(frame):
    """The most rows that any step of a query got from Python."""
    frame.collect()
    most, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        metric = node.metrics().get("pythonNumRowsReceived")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        name, children = node.nodeName(), node.children()
        left += [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else []
        left += [children.apply(i) for i in range(children.size())]
    return most


def parts(spark, path, n, names):
    k = F.col("id")
    name = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    spark.range(n).select(k.alias("p_partkey"), name.alias("p_name"), F.lit("SMALL").alias("p_type"), (k % 2 + 1).cast("int").alias("p_size")).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_a_reading_that_repeats_is_repaired_once(spark, tmp_path):
    from quillmend.plans import repairs

    found = repairs.proofread(spark, parts(spark, tmp_path, 2000, ["red rod", "hot ring", None]))
    assert 0 < python_rows(found) <= 10
    rows = found.collect()
    assert len(rows) == 2000 and {r["p_partkey"] for r in rows} == set(range(2000))
    assert all((r["fixed"] is None) == (r["p_partkey"] % 3 == 2) for r in rows)


def test_an_answer_that_repeats_is_expanded_once(spark, tmp_path):
    from quillmend.plans import forms

    found = forms.option_expansion(spark, parts(spark, tmp_path, 2000, ["small ring", "red bolt", "old plate", None]))
    assert 0 < python_rows(found) <= 10
    assert Counter(r["options"] for r in found.collect()) == {"1": 500, "3,4": 500, None: 1000}


def test_script_scores_equal_those_of_patterns(spark):
    from quillmend.functions import text as T

    def by_patterns(text, script, implausible):
        t = F.trim(text)
        n = F.length(t)
        valid, own = F.length(F.regexp_replace(t, f"{implausible}+", "")) / n, F.length(F.regexp_replace(t, f"[^{script}]+", "")) / n
        mixed = F.least(F.lit(1.0), valid * 0.6 + F.least(own * 2, F.lit(1.0)) * 0.4)
        digits = F.length(F.regexp_replace(t, r"[^0-9０-９]+", ""))
        return F.when(text.isNull(), None).when(n == 0, 1.0).otherwise(F.round(F.when(digits >= n * 0.6, valid).otherwise(mixed), 3))

    rng = random.Random(15)
    signs = "ab zZ09５%\t\n\x0b\x85\xa0\u3000。漢字カひé𠀋😀|~[]^-_&"
    texts = ["", "  ", "12 34", "😀", None, *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for script, implausible in (("a-z", r"[^a-zA-Z0-9\s.,;:()/%+\-]"), (T.JAPANESE, T.PLAUSIBLE)):
        assert rows.filter(~T.script_score(F.col("t"), script, implausible).eqNullSafe(by_patterns(F.col("t"), script, implausible))).count() == 0


def test_script_scores_need_no_pattern_over_whole_texts(spark, sf_dir):
    from quillmend.plans import text

    assert "regexp_replace" not in text.script_score(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_not_shuffled(spark, tmp_path):
    from quillmend.plans import aggregates

    k = F.col("id")
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("a"), k.cast("string"), F.lit("c")), F.lit("d e"))
    spark.range(500).select(k.alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    found = aggregates.token_lines(spark, str(tmp_path))
    rows = found.collect()
    assert len(rows) == 500 and {r["lines"] for r in rows} == {2}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange ") == 1


def test_boxes_at_one_place_are_read_in_order_of_their_keys(spark):
    from quillmend.operators import windows

    rows = spark.range(40).select(F.lit("p").alias("page"), (39 - F.col("id")).alias("box"), F.lit(5.0).alias("top"), F.lit(7.0).alias("left"), F.lit(2.0).alias("h")).repartition(5)
    got = windows.reading_order(rows, "page", "top", "left", "h", "box").collect()
    assert {r["box"]: r["position"] for r in got} == {i: i + 1 for i in range(40)}


def test_no_phrases_at_all():
    from quillmend.operators import matching as M

    near = M.NearPhrases([], 0.8, 0.7)
    assert not [i for line in ("", "a", "abcdefgh") for i in near.candidates(line).tolist()]


def test_phrases_of_near_copies_are_found_and_few_others_held_against_lines(monkeypatch):
    from quillmend.operators import matching as M

    rng = random.Random(16)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "to", "of ", "it", "is ", "or", "es", " "]
    made = lambda n: "".join(rng.choice(parts) for _ in range(n))
    phrases = [made(rng.randrange(8, 150)) for _ in range(600)] + ["th", "é", "th😀er"]
    changed = lambda p, share: "".join(rng.choice(["", "e", "ex", "漢"]) if rng.random() < share else c for c in p)
    lines = [changed(p, share) for p in rng.sample(phrases, 30) for share in (0.05, 0.2)] + [made(80) for _ in range(20)]
    near, held, true = M.NearPhrases(phrases, 0.8, 0.7), [], M.near_stretch
    wanted = []
    for line in lines:
        fits = [i for i, p in enumerate(phrases) if min(len(p), len(line)) >= 0.7 * max(len(p), len(line), 1)]
        grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
        shares = lambda p: 2 * len(grams(p) & grams(line)) >= near.alike * (len(grams(p)) + len(grams(line)))
        close = lambda p: true(M.character_masks(p), len(p), line, (1 - near.alike) * (len(p) + 2))
        wanted.append({i for i in fits if shares(phrases[i]) or close(phrases[i])})
    monkeypatch.setattr(M, "near_stretch", lambda *a: held.append(1) or true(*a))
    assert [set(near.candidates(line).tolist()) for line in lines] == wanted and sum(map(len, wanted)) > 30
    assert len(held) <= sum(map(len, wanted)) + 4 * len(lines)
