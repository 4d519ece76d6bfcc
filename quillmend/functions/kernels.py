"""Numeric kernels on columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def unit(v: Column, low: float, high: float) -> Column:
    """Linear from 0 at low to 1 at high."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))) if high > low else F.lit(0.0)


# Where marks begin and are certain, by way of writing.
FILL, INK, RING, OUT, EDGE, RING_BIAS = (0.10, 0.28), (0.02, 0.06), (0.10, 0.30), (0.015, 0.045), (0.010, 0.030), 0.50


def mark_score(fill: Column, ink: Column, ring: Column, bias: Column, out: Column, edge: Column, compared: Column) -> Column:
    """The strongest of the ways to mark a box; all but the fill need a comparison with the blank form."""
    ringed = F.when(bias <= RING_BIAS, unit(ring, *RING)).otherwise(0.0)
    best = F.greatest(unit(fill, *FILL), unit(ink, *INK), ringed, F.least(unit(out, *OUT), unit(edge, *EDGE)))
    return F.when(compared, best).otherwise(unit(fill, *FILL))


def score_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.45 + F.abs(score - 0.5) * 1.10), 3)


def fill_confidence(fill: Column) -> Column:
    """Piecewise confidence of a fill ratio alone: low in the grey zone, rising outside."""
    low, high = FILL
    mid, half = (low + high) / 2, (high - low) / 2
    return F.round(F.when(fill <= low, F.least(F.lit(1.0), 0.55 + (low - fill) / low * 0.45)).when(fill >= high, F.least(F.lit(1.0), 0.55 + (fill - high) / 0.35 * 0.45)).otherwise(0.15 + F.abs(fill - mid) / half * 0.35), 3)


def page_match(inliers: Column, matches: Column, digits: int = 4) -> Column:
    """Score of a page match, null below 25 inliers or a share of 0.30."""
    share = F.coalesce(F.try_divide(inliers, matches), F.lit(0.0))
    return F.when((inliers >= 25) & (share >= 0.30), F.round(0.6 * share + 0.4 * F.least(inliers / 120.0, F.lit(1.0)), digits))


def segment_means(values: Column, n: int) -> Column:
    """Means of n equal stretches of an array."""
    size = F.size(values)
    edge = lambda i: F.floor(size * i / n).cast("int")
    one = lambda i: F.slice(values, edge(i) + 1, F.greatest(edge(i + 1) - edge(i), F.lit(1)))
    return F.array(*(F.aggregate(one(i), F.lit(0.0), lambda a, x: a + x) / F.size(one(i)) for i in range(n)))


def pick_segment(means: Column, n: int) -> Column:
    """The strongest of n segments, its excess over the median and its margin over the second."""
    ordered = F.array_sort(means)
    top, second = F.get(ordered, F.lit(n - 1)), F.get(ordered, F.lit(n - 2))
    median = F.get(ordered, F.lit(n // 2)) if n % 2 else (F.get(ordered, F.lit(n // 2)) + F.get(ordered, F.lit(n // 2 - 1))) / 2
    return F.struct((F.array_position(means, top) - 1).cast("int").alias("segment"), F.round(top - median, 4).alias("excess"), F.round(top - second, 4).alias("margin"))


# Columns of ink a line's height that one character has at least and at most, and the lowest line that counts.
INK_MIN, INK_MAX, LOWEST_LINE = 0.35, 1.70, 6


def written_shape(lines: Column, width: Column, margin: int = 2) -> Column:
    """What is written in a field, from its lines (structs columns, height, first, last): density, fewest and most characters, lines, and whether ink touches an edge.

    The density is the sum of inked columns over the height of each line that is high enough; columns and not the
    width count, so gaps add nothing.
    """
    high = F.filter(lines, lambda l: (l["columns"] > 0) & (l["height"] >= LOWEST_LINE))
    density = F.aggregate(high, F.lit(0.0), lambda a, l: a + l["columns"] / l["height"])
    left = F.exists(lines, lambda l: l["first"] <= margin)
    right = F.exists(lines, lambda l: l["last"] >= width - 1 - margin)
    return F.struct(F.round(density, 6).alias("density"), half_up(density / INK_MAX).cast("int").alias("min_chars"), half_up(density / INK_MIN).cast("int").alias("max_chars"), F.size(lines).alias("lines"), left.alias("cut_left"), right.alias("cut_right"))


def ink_check(density: Column, read: Column, charset: Column, cut_left: Column, cut_right: Column) -> Column:
    """Penalty and notes of a reading against the ink seen."""
    low, high = half_up(density / INK_MAX), half_up(density / INK_MIN)
    empty = (density < 0.25) & (read >= 1)
    few = ~empty & (charset == "") & (low >= 3) & (read < low * 0.8)
    many = ~empty & ~few & (charset == "") & (read > high + 2)
    rules = [(empty, 0.35, "no ink"), (few, 0.8, "too short"), (many, 0.8, "too long"), (cut_left, 0.9, "cut left"), (cut_right, 0.9, "cut right")]
    penalty = F.lit(1.0)
    for when, factor, _ in rules:
        penalty = penalty * F.when(when, factor).otherwise(1.0)
    notes = F.filter(F.array(*(F.when(w, n) for w, _, n in rules)), lambda x: x.isNotNull())
    return F.struct(F.round(penalty, 4).alias("penalty"), F.array_join(notes, "; ").alias("notes"))


def ctc_decode(steps: Column, blank: int = 0) -> Column:
    """Greedy decoding of an array of score arrays: the best class per step, repeats collapsed, blanks dropped."""
    best = F.transform(steps, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    changed = F.filter(F.transform(best, lambda c, i: F.when((i == 0) | (c != F.get(best, i - 1)), c)), lambda c: c.isNotNull() & (c != blank))
    mean = F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.array_max(s)) / F.size(steps)
    return F.struct(changed.alias("classes"), F.round(mean, 4).alias("mean"))


def elementwise(rows: DataFrame, key: list[str], values: str, p: float, above: float) -> DataFrame:
    """Percentile, mean of an indicator and count by position over a stack of arrays."""
    at = rows.select(*key, F.posexplode(values).alias("pos", "v"))
    return at.groupBy(*key, "pos").agg(F.round(F.expr(f"percentile(cast(v as double), {p})"), 4).alias("percentile"), F.round(F.avg((F.col("v") > above).cast("double")), 4).alias("share"), F.count(F.lit(1)).alias("n"))


def mode_filter(rows: DataFrame, key: str, value: str, width: float = 1.0, within: float = 0.15) -> DataFrame:
    """Rows within a share of the fullest bin's lower edge, the first bin on ties."""
    bins = rows.groupBy(key, F.floor(F.col(value) / width).alias("bin")).count()
    mode = bins.groupBy(key).agg((F.min_by("bin", F.struct((-F.col("count")).alias("c"), "bin")) * width).alias("mode"))
    return rows.join(mode, key).filter(F.abs(F.col(value) - F.col("mode")) <= F.abs(F.col("mode")) * within)


def monotone_medians(rows: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """Median of y by bins of x, made non-decreasing by a running maximum."""
    from pyspark.sql import Window as W

    m = rows.groupBy(key, F.floor(F.col(x) / width).alias("bin")).agg(F.expr(f"percentile(cast({y} as double), 0.5)").alias("median"))
    return m.withColumn("monotone", F.max("median").over(W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))


def local_line(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of each key."""
    return rows.groupBy(key).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))
