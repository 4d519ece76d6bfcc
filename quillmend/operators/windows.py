"""Ranking, gaps and islands, and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmend.functions.kernels import score_confidence


def single_choice(readings: DataFrame, key: str, option: str, score: str, checked: str, confidence: str) -> DataFrame:
    """The strongest option of each field if it is checked; confidence falls with the margin over the second: key, picked, confidence."""
    w = W.partitionBy(key).orderBy(F.desc(score), option)
    ranked = readings.withColumn("__r", F.row_number().over(w)).withColumn("__second", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    margin = F.round(F.least(F.lit(1.0), 0.35 + (F.col(score) - F.col("__second")) * 0.65), 3)
    sure = F.when(F.col(checked), F.least(F.col(confidence), margin)).otherwise(F.col(confidence))
    return ranked.filter("__r = 1").select(key, F.when(F.col(checked), F.col(option)).alias("picked"), sure.alias("confidence"))


# A struck-out mark's highest score, and the lengths from which a stroke counts beside another mark and alone.
STRUCK_SCORE, STRIKE_BESIDE, STRIKE_ALONE = 0.45, 1.8, 2.2


def resolve_strikes(readings: DataFrame, key: str, ordinal: str, bands: str, all_bands: str, length: str, checked: str, score: str | None = None, confidence: str | None = None) -> DataFrame:
    """Uncheck marks that were struck out, in order: an earlier one that falls no longer counts as another mark.

    Gives struck and still_checked; with ``score`` and ``confidence`` also these, a struck mark's score
    lowered and its confidence made from it. A fold over each field's ordered marks: at most as many as the form has boxes.
    """
    item = F.struct(F.col(ordinal).alias("o"), F.col(checked).alias("c"), (F.col(checked) & (F.col(bands) >= 1) & (F.col(all_bands) >= 2)).alias("can"), F.col(length).cast("double").alias("len"))
    grouped = readings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__m"))
    start = F.struct(F.size(F.filter("__m", lambda m: m["c"])).alias("on"), F.array().cast("array<struct<o:bigint,struck:boolean,still:boolean>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        need = F.when(acc["on"] > 1, STRIKE_BESIDE).otherwise(STRIKE_ALONE)
        gone = m["can"] & (m["len"] >= need)
        row = F.struct(m["o"].cast("bigint").alias("o"), gone.alias("struck"), (m["c"] & ~gone).alias("still"))
        return F.struct((acc["on"] - gone.cast("int")).alias("on"), F.array_append(acc["out"], row).alias("out"))

    folded = grouped.select(key, F.explode(F.aggregate("__m", start, step, lambda a: a["out"])).alias("r"))
    out = folded.select(key, F.col("r.o").alias(ordinal), F.col("r.struck").alias("struck"), F.col("r.still").alias("still_checked"))
    if score is None or confidence is None:
        return out
    low = F.round(F.least(F.col(score), F.lit(STRUCK_SCORE)), 4)
    lowered = F.when(F.col("struck"), low).otherwise(F.col(score))
    sure = F.when(F.col("struck"), score_confidence(low)).otherwise(F.col(confidence))
    return out.join(readings.select(key, F.col(ordinal).cast("bigint").alias(ordinal), score, confidence), [key, ordinal]).select(*out.columns, lowered.alias("score"), sure.alias("confidence"))


def circled(readings: DataFrame, key: str, option: str, halo: str, checked: str, excess: float = 0.06) -> DataFrame:
    """The option of a field without marks whose surroundings stand out from the upper median and from the runner-up: key, option, confidence."""
    item = F.struct((-F.col(halo)).alias("h"), F.col(option).alias("o"))
    g = readings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"), F.bool_or(checked).alias("any"))
    n = F.size("m")
    # Upper median of the ascending order, read from the descending one.
    base = -F.get("m", n - 1 - F.floor(n / 2).cast("int"))["h"]
    best, second = -F.col("m")[0]["h"], -F.get("m", F.lit(1))["h"]
    over = F.least(best - base - excess, best - second - excess / 2)
    sure = F.round(F.least(F.lit(0.85), 0.40 + (best - F.greatest(base, second)) / 0.12 * 0.45), 3)
    return g.filter((n >= 2) & ~F.col("any")).filter(over >= -1e-12).select(key, F.col("m")[0]["o"].alias(option), sure.alias("confidence"))


def best_page(pages: DataFrame, key: list[str], ordinal: str, score: str) -> DataFrame:
    """Mark the page of each index that stays: the highest score, the earlier on ties."""
    w = W.partitionBy(*key).orderBy(F.desc(score), ordinal)
    return pages.withColumn("kept", F.row_number().over(w) == 1)


def islands(rows: DataFrame, key: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Number the runs between breaks: ``breaks`` sees the previous row through lag over the same order."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(1))).withColumn("island", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def merged_coordinates(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Runs of sorted values no further apart than the tolerance, as their mean: key, island, centre, n."""
    w = W.partitionBy(key).orderBy(value)
    far = F.col(value) - F.lag(value).over(w) > tolerance
    return islands(rows, [key], [value], far).groupBy(key, "island").agg(F.round(F.avg(value), 6).alias("centre"), F.count(F.lit(1)).alias("n"))


def intervals(rows: DataFrame, key: str, value: str, thinnest: float) -> DataFrame:
    """Neighbouring values as intervals that are thick enough."""
    nxt = F.lead(value).over(W.partitionBy(key).orderBy(value))
    return rows.withColumn("high", nxt).filter(F.col("high") - F.col(value) >= thinnest).select(key, F.col(value).alias("low"), "high")


def runs_above(rows: DataFrame, key: str, ordinal: str, value: str, least: float, shortest: int = 1, gap: int = 1) -> DataFrame:
    """Runs of rows at or above a level, rows at most ``gap`` apart, of a least length: key, run, first, last, n."""
    on = rows.filter(F.col(value) >= least)
    far = F.col(ordinal) - F.lag(ordinal).over(W.partitionBy(key).orderBy(ordinal)) > gap
    runs = islands(on, [key], [ordinal], far).groupBy(key, F.col("island").alias("run")).agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= shortest)


def anchored_rows(rows: DataFrame, key: str, y: str, height: str, item: str, share: float = 0.6) -> DataFrame:
    """Row numbers of boxes by distance from the row's first box, as a fold in order of y: key, item, row. A key holds one page's boxes."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(item).cast("bigint").alias("i"), F.col(height).cast("double").alias("h")))).alias("b"))
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<i:bigint,row:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        new = acc["at"].isNull() | (b["y"] - acc["at"] > b["h"] * share)
        row = acc["row"] + new.cast("int")
        return F.struct(row.alias("row"), F.when(new, b["y"]).otherwise(acc["at"]).alias("at"), F.array_append(acc["out"], F.struct(b["i"].alias("i"), row.alias("row"))).alias("out"))

    return g.select(key, F.explode(F.aggregate("b", start, step, lambda a: a["out"])).alias("r")).select(key, F.col("r.i").alias(item), F.col("r.row").alias("row"))


def latest_snapshot(rows: DataFrame, key: str, as_of: str) -> DataFrame:
    """All rows of each key's latest date."""
    return rows.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy(F.desc(as_of)))).filter("__r = 1").drop("__r")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def split_pairs(rows: DataFrame, key: str, ordinal: str, alone: Column) -> DataFrame:
    """Group numbers: a lone row is its own group, the others go in twos between lone rows."""
    w = W.partitionBy(key).orderBy(ordinal)
    marked = rows.withColumn("__a", alone).withColumn("__s", F.sum(F.col("__a").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = F.row_number().over(W.partitionBy(key, "__s", "__a").orderBy(ordinal))
    new = marked.withColumn("__n", (F.col("__a") | (at % 2 == 1)).cast("int"))
    return new.withColumn("group", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__a", "__s", "__n")


def split_records(rows: DataFrame, key: str, ordinal: str, page: str) -> DataFrame:
    """Record numbers of a page stream: page 1, or a page already in the current record, begins the next. A fold over each key's pages."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).cast("bigint").alias("o"), F.col(page).cast("bigint").alias("p")))).alias("b"))
    start = F.struct(F.lit(0).alias("record"), F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<struct<o:bigint,record:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        new = (acc["record"] == 0) | (b["p"] == 1) | F.array_contains(acc["seen"], b["p"])
        record = acc["record"] + new.cast("int")
        seen = F.when(new, F.array(b["p"])).otherwise(F.array_append(acc["seen"], b["p"]))
        return F.struct(record.alias("record"), seen.alias("seen"), F.array_append(acc["out"], F.struct(b["o"].alias("o"), record.alias("record"))).alias("out"))

    return g.select(key, F.explode(F.aggregate("b", start, step, lambda a: a["out"])).alias("r")).select(key, F.col("r.o").alias(ordinal), F.col("r.record").alias("record"))


def reading_order(rows: DataFrame, key: str, top: str, left: str, height: str, item: str | None = None) -> DataFrame:
    """Position of boxes in reading order: rows of 0.7 median heights, then left to right; boxes at one place by item, if given."""
    median = rows.groupBy(key).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {height})").alias("__med"))
    line = F.round(F.col(top) / (F.col("__med") * 0.7))
    return rows.join(median, key).withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(line, left, top, *([item] if item else [])))).drop("__med")


def next_to_check(rows: DataFrame, key: str, ordinal: str, needs: Column) -> DataFrame:
    """For each row, the next one that needs a check, around the end."""
    ahead = W.partitionBy(key).orderBy(ordinal).rowsBetween(1, W.unboundedFollowing)
    some = W.partitionBy(key).orderBy(ordinal).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pick = F.when(needs, F.col(ordinal))
    return rows.withColumn("next", F.coalesce(F.first(pick, True).over(ahead), F.first(pick, True).over(some)))


def texts_after_marks(chars: DataFrame, key: str, ordinal: str, char: str, mark: str, x: str, gap: float, longest: int) -> DataFrame:
    """Text after each mark up to the next mark or a wide gap: key, island, text."""
    w = W.partitionBy(key).orderBy(ordinal)
    marked = islands(chars.withColumn("__gap", F.col(x) - F.lag(x).over(w)), [key], [ordinal], F.col(char) == mark)
    run = W.partitionBy(key, "island").orderBy(ordinal).rowsBetween(W.unboundedPreceding, 0)
    open_ = marked.withColumn("__shut", F.max(F.when((F.col("__gap") > gap) & (F.col(char) != mark), 1).otherwise(0)).over(run)).withColumn("__n", F.row_number().over(W.partitionBy(key, "island").orderBy(ordinal)))
    kept = open_.filter((F.col("__shut") == 0) & (F.col(char) != mark) & (F.col("__n") <= longest + 1))
    return kept.groupBy(key, "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, char))), lambda s: s[char]), "").alias("text"))


def debounce(edits: DataFrame, key: list[str], time: str, before: str, after: str, gap_seconds: float) -> DataFrame:
    """Edits of one field less than a gap apart as one: the first before-value, the last after-value, unless they are equal."""
    w = W.partitionBy(*key).orderBy(time, before)
    far = F.col(time).cast("timestamp").cast("double") - F.lag(F.col(time).cast("timestamp").cast("double")).over(w) >= gap_seconds
    burst = islands(edits, key, [time, before], far).groupBy(*key, "island").agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.min_by(before, F.struct(time, before)).alias("before"), F.max_by(after, F.struct(time, before)).alias("after"), F.count(F.lit(1)).alias("edits"))
    return burst.filter(~F.col("before").eqNullSafe(F.col("after"))).drop("island")


def retain(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The latest rows of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def first_seen(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The first value that arrived for each key."""
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def slots_between(marks: DataFrame, on: list[str], left: str, right: str, pad: float = 0.12, narrowest: float = 20.0) -> DataFrame:
    """Slots between printed marks: from the end of the mark before (0 at the first) to this mark's start, padded, if wide enough: on, low, high."""
    begin = F.coalesce(F.lag(right).over(W.partitionBy(*on).orderBy(left)), F.lit(0.0))
    wide = marks.withColumn("__l", begin).withColumn("__w", F.col(left) - F.col("__l")).filter(F.col("__w") >= narrowest)
    return wide.select(*on, F.round(F.col("__l") + F.col("__w") * pad, 2).alias("low"), F.round(F.col(left) - F.col("__w") * pad, 2).alias("high"))


def fields_in_order(places: DataFrame, definition: DataFrame, form: str, field: str = "field", ordinal: str = "ordinal") -> DataFrame:
    """Position of each field of a form: by its first place (page, y, x), fields without one last in the definition's order: form, field, position.

    ``places`` has a row for each of a field's boxes or texts with columns page, y and x.
    """
    first = places.groupBy(form, field).agg(F.min(F.struct("page", "y", "x")).alias("__p"))
    known = places.select(form).distinct().join(definition.select(field, ordinal)).join(first, [form, field], "left")
    order = W.partitionBy(form).orderBy(F.col("__p").asc_nulls_last(), ordinal)
    return known.select(form, field, F.row_number().over(order).alias("position"))
