"""Aggregates over readings, votes and truth tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def weighted_vote(rows: DataFrame, key: str, choice: str, weight: str) -> DataFrame:
    """Per key the choice with the largest total weight, the first by name on ties: key, winner, score."""
    sums = rows.groupBy(key, choice).agg(F.round(F.sum(weight), 4).alias("score"))
    return sums.groupBy(key).agg(F.min_by(F.struct(choice, "score"), F.struct((-F.col("score")).alias("s"), F.col(choice))).alias("w")).select(key, F.col(f"w.{choice}").alias("winner"), F.col("w.score").alias("score"))


def only_winner(rows: DataFrame, key: str, choice: str, weight: str, cleared: list[str]) -> DataFrame:
    """Rows with some columns nulled where their choice lost its key's vote."""
    won = weighted_vote(rows, key, choice, weight).select(key, "winner")
    joined = rows.join(won, key, "left")
    return joined.select(*(F.when(F.col(choice) == F.col("winner"), F.col(c)).alias(c) if c in cleared else F.col(c) for c in rows.columns))


def level_counts(rows: DataFrame, key: str, level: str) -> DataFrame:
    rank = F.when(F.col(level) == "low", 0).when(F.col(level) == "medium", 1).otherwise(2)
    counts = [F.count_if(F.col(level) == v).alias(v) for v in ("high", "medium", "low")]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *counts, F.min_by(level, rank).alias("worst"))


def confusion(rows: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, recall and precision by group."""
    t, p = truth, predicted
    c = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    x = F.col
    return c.select("*", rate(x("tp") + x("tn"), x("tp") + x("fp") + x("fn") + x("tn")).alias("accuracy"), rate(x("tp"), x("tp") + x("fn")).alias("recall"), rate(x("tp"), x("tp") + x("fp")).alias("precision"))


def outcomes(rows: DataFrame, by: list[str], truth: Column, read: Column) -> DataFrame:
    """How often a part was correct, missing, wrong, extra or rightly blank."""
    kind = F.when(truth.isNull() & read.isNull(), "blank").when(truth.isNull(), "extra").when(read.isNull(), "missing").when(truth == read, "correct").otherwise("wrong")
    marked = rows.withColumn("__kind", kind)
    return marked.groupBy(*by).agg(*(F.count_if(F.col("__kind") == k).alias(k) for k in ("correct", "missing", "wrong", "extra", "blank")))


def agreement(rows: DataFrame, by: list[str], truth: str, first: str, second: str) -> DataFrame:
    """How two readings agree and which of them is right; null counts as empty."""
    a, b, t = F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(second), F.lit("")), F.col(truth)
    same, apart = (a == b) & (a != ""), (a != b) & (a != "") & (b != "")
    named = {"agree": same, "agree_right": same & (a == t), "differ": apart, "differ_first_right": apart & (a == t), "differ_second_right": apart & (b == t), "one_empty": (a == "") != (b == "")}
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in named.items()))


def engine_gap(rows: DataFrame, field: str, engine: str, score: str, baseline: str, others: list[str]) -> DataFrame:
    """Mean score of the baseline and of the best other engine by field."""
    m = rows.groupBy(field).agg(*(F.round(F.avg(F.when(F.col(engine) == e, F.col(score))), 6).alias(f"__{e}") for e in [baseline, *others]))
    best = F.greatest(*(F.col(f"__{e}") for e in others)) if len(others) > 1 else F.col(f"__{others[0]}")
    return m.select(field, F.col(f"__{baseline}").alias("baseline"), best.alias("best"), F.round(best - F.col(f"__{baseline}"), 6).alias("gap"))


def uplift(rows: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return rows.groupBy(*by).agg(F.round(F.avg(b), 4).alias("before"), F.round(F.avg(a), 4).alias("after"), F.count_if(a > b).alias("better"), F.count_if(a < b).alias("worse"), F.count_if(a == b).alias("same"))


def buckets(rows: DataFrame, kind: str, axis: str, value: Column) -> DataFrame:
    """Counts, sums and means at once by kind, by kind and axis, and by axis."""
    sets = [[F.col(kind)], [F.col(kind), F.col(axis)], [F.col(axis)]]
    grouped = rows.withColumn("__v", value).groupingSets(sets, F.col(kind), F.col(axis))
    return grouped.agg(F.grouping_id().alias("bucket"), F.count("__v").alias("n"), F.round(F.sum("__v"), 4).cast("double").alias("total"), F.round(F.avg("__v"), 4).alias("ratio")).select(F.col(kind).alias("kind"), F.col(axis).alias("axis"), "bucket", "n", "total", "ratio")


def edit_summary(events: DataFrame, action: str, field: str, amount: str, edit: str = "click", error: str = "error", top: int = 8) -> DataFrame:
    """One row: actions, edits, errors, the amount edited, and the fields edited most."""
    edits = F.col(action) == edit
    most = events.filter(edits).groupBy(field).count().orderBy(F.desc("count"), field).limit(top)
    listed = most.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(field).alias("f")))), lambda s: F.concat(s["f"].cast("string"), F.lit(":"), (-s["n"]).cast("string"))), ",").alias("most_edited"))
    totals = events.agg(F.count(F.lit(1)).alias("actions"), F.count_if(edits).alias("edits"), F.count_if(F.col(action) == error).alias("errors"), F.round(F.sum(F.when(edits, F.col(amount))), 2).alias("amount"))
    return totals.join(F.broadcast(listed))


def prefix_class(value: Column, prefixes: list[tuple[str, str]], rest: str) -> Column:
    """The class of the first prefix listed that a value starts with."""
    return F.coalesce(*(F.when(F.startswith(value, F.lit(p)), c) for p, c in prefixes), F.lit(rest))


def prefix_rollup(rows: DataFrame, path: str, prefixes: list[tuple[str, str]], rest: str, amount: str, item: str) -> DataFrame:
    return rows.groupBy(prefix_class(F.col(path), prefixes, rest).alias("area")).agg(F.round(F.sum(amount), 2).alias("amount"), F.count_distinct(item).alias("files"))


def routes(steps: DataFrame, field: str, ordinal: str, step: str, shown: int = 6) -> DataFrame:
    """Fields grouped by the order in which steps were first taken: route, n, and the first fields with how many more there are."""
    first = steps.groupBy(field, step).agg(F.min(ordinal).alias("at"))
    route = first.groupBy(field).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", step))), lambda s: s[step]), " → ").alias("route"))
    ranked = route.withColumn("r", F.row_number().over(W.partitionBy("route").orderBy(field)))
    shown_ = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", F.col(field).alias("f"))))), lambda s: s["f"].cast("string"))
    out = ranked.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.array_join(shown_, ",").alias("fields"))
    return out.withColumn("fields", F.concat("fields", F.when(F.col("n") > shown, F.concat(F.lit(" +"), (F.col("n") - shown).cast("string"))).otherwise("")))


def stratified(rows: DataFrame, stratum: str, key: str, per: int) -> DataFrame:
    """The first rows by key of every stratum."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(key))).filter(F.col("__r") <= per).drop("__r")


def nth_key(rows: DataFrame, key: str, n: int, at_once: int = 10_000, cuts: int = 256) -> object:
    """The n-th smallest key, counted from 1 with repeats. Keys must not be null.

    Sampled cuts split the keys that are still possible, one count of them per
    interval tells which interval holds the n-th, and so on until few are left.
    """
    left = rows.select(key)
    while (total := left.count()) > at_once:
        sample = sorted(r[0] for r in left.orderBy(F.xxhash64(key), key).select(key).limit(4 * cuts).distinct().collect())
        bounds = sample[:: max(1, len(sample) // cuts)]
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key)))
        exact = F.array_contains(F.array(*map(F.lit, bounds)), F.col(key))
        slots = left.select(F.struct(place.alias("p"), (~exact).cast("int").alias("between")).alias("slot"), key)
        before = 0
        for slot, count, low, high in sorted(slots.groupBy("slot").agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect(), key=lambda r: tuple(r[0])):
            if before + count >= n:
                break
            before += count
        if low == high:
            return low
        left, n = left.filter(F.col(key).between(F.lit(low), F.lit(high))), n - before
        if count == total:
            break
    return left.orderBy(key).offset(n - 1).limit(1).first()[0]


def train_test(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Mark the first share of the sorted keys, at least one, as training. The last of them is found by ``nth_key``, so no task sorts the table."""
    n = max(1, int(rows.count() * share))
    if rows.isEmpty():
        return rows.withColumn("train", F.lit(True))
    return rows.withColumn("train", F.col(key) <= F.lit(nth_key(rows, key, n)))


def multi_choice(readings: DataFrame, key: str, option: str, word: str, checked: str, confidence: str) -> DataFrame:
    """The checked options of each field in order, and the least confidence."""
    picked = F.array_sort(F.collect_list(F.when(F.col(checked), F.struct(F.col(option).alias("o"), F.col(word).alias("w")))))
    return readings.groupBy(key).agg(F.transform(picked, lambda s: s["w"]).alias("picked"), F.min(confidence).alias("confidence"))


def first_best(rows: DataFrame, key: str, score: str, ordinal: str, value: str) -> DataFrame:
    """The value with the best score, the earlier on ties."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(F.col(score), (-F.col(ordinal)).alias("o"))).alias("picked"), F.max(score).alias("best"))


def rebuild_lines(tokens: DataFrame, key: list[str], line: str, ordinal: str, token: str, confidence: str) -> DataFrame:
    """Texts from tokens: tokens of a line in order, lines in order, and the mean of the lines' mean confidence.

    Means are quotients of decimal sums, so they don't depend on the order in which rows meet.
    """
    sure = F.when(F.col(confidence) >= 0, F.col(confidence).cast("decimal(18,9)"))
    mean = (F.sum(sure).cast("double") / F.count(sure)).cast("decimal(18,9)")
    lines = tokens.groupBy(*key, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, token))), lambda s: s[token]), " ").alias("__t"), mean.alias("__c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "__t"))), lambda s: s["__t"]), "\n")
    return lines.groupBy(*key).agg(text.alias("text"), F.count(F.lit(1)).alias("lines"), (F.sum("__c").cast("double") / F.count("__c")).alias("confidence"))



def pairs_of_changes(changes: DataFrame, wrong: str, right: str, support: int) -> DataFrame:
    """Per wrong form the target seen most, if seen often enough and more often than any other: wrong, right, n."""
    n = changes.groupBy(wrong, right).count()
    w = W.partitionBy(wrong).orderBy(F.desc("count"), right)
    ranked = n.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("count").over(w))
    return ranked.filter((F.col("r") == 1) & (F.col("count") >= support) & (F.col("count") > F.coalesce("next", F.lit(0)))).select(wrong, right, F.col("count").alias("n"))


def category_counts(rows: DataFrame, name: str, rules: list[tuple[str, str]], other: str, size: str | None = None) -> DataFrame:
    """How many rows fall in each category, by the first rule whose pattern their name matches: category, n, and the total size if given."""
    category = F.coalesce(*(F.when(F.col(name).rlike(pattern), label) for label, pattern in rules), F.lit(other))
    total = [F.sum(size).alias("size")] if size else []
    return rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"), *total)
