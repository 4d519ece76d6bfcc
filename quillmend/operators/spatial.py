"""Range, containment, overlap and nearest joins of boxes on pages.

Boxes are columns x0, y0, x1, y1. All joins are within a page key; where one
side of a page is large, ``bucketed`` adds a grid so that the join has an
equality on cells as well.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def bucketed(rows: DataFrame, low: str, high: str, width: float, name: str = "cell") -> DataFrame:
    """One row per cell of the given width that an interval touches."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:
    """Pairs of overlapping intervals, each once: an equality join on cells, kept in the cell where the overlap begins."""
    a, b = bucketed(left, *l, width), bucketed(right, *r, width)
    begins = F.greatest(F.floor(F.col(l[0]) / width), F.floor(F.col(r[0]) / width))
    return a.join(b, [*on, "cell"]).filter((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("cell") == begins)).drop("cell")


def overlap_totals(left: DataFrame, right: DataFrame, on: list[str], l: tuple[str, str], r: tuple[str, str]) -> DataFrame:
    """How many pairs of a left and a right interval overlap in each key, and the length they share in all: on, pairs, shared.

    A sweep over the distinct ends, without any pair: one counts where the later of the two begins,
    and from one end to the next each open left interval shares the way with each open right one.
    """
    c, kinds = F.col, [f"{k}_{s}" for s in "lr" for k in ("begin", "end", "point")]

    def ends(side: DataFrame, low: str, high: str, name: str) -> DataFrame:
        long = (c(low) < c(high)).cast("bigint")
        at_low, at_high = {f"begin_{name}": long, f"point_{name}": 1 - long}, {f"end_{name}": long}
        steps = F.array(*(F.struct(c(at).alias("at"), *(here.get(k, F.lit(0).cast("bigint")).alias(k) for k in kinds)) for at, here in ((low, at_low), (high, at_high))))
        return side.filter(c(low) <= c(high)).select(*on, F.inline(steps))

    places = ends(left, *l, "l").unionByName(ends(right, *r, "r")).dropna(subset=on).groupBy(*on, "at").agg(*(F.sum(k).alias(k) for k in kinds))
    w = W.partitionBy(*on).orderBy("at")
    open_ = {f"open_{s}": F.sum(c(f"begin_{s}") - c(f"end_{s}")).over(w.rowsBetween(W.unboundedPreceding, 0)) for s in "lr"}
    swept = places.withColumns(open_ | {"way": F.lead("at").over(w) - c("at")})
    begun = {s: c(f"begin_{s}") + c(f"point_{s}") for s in "lr"}
    before = {s: c(f"open_{s}") - c(f"begin_{s}") for s in "lr"}
    pairs = begun["l"] * before["r"] + before["l"] * begun["r"] + c("begin_l") * c("begin_r")
    shared = F.coalesce(F.sum(c("open_l") * c("open_r") * c("way")), F.lit(0.0))
    return swept.groupBy(*on).agg(F.sum(pairs).alias("pairs"), shared.alias("shared")).filter("pairs > 0")


def cell_of(x: str, y: str, width: float, height: float) -> list[Column]:
    """A point's cell of a grid."""
    return [F.floor(F.col(x) / width).alias("cx"), F.floor(F.col(y) / height).alias("cy")]


def with_neighbours(points: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """A row per cell around each point: points closer than a cell's size on both axes share one of them."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    cx, cy = cell_of(x, y, width, height)
    return points.withColumn("__d", F.explode(steps)).withColumn("cx", cx + F.col("__d.i")).withColumn("cy", cy + F.col("__d.j")).drop("__d")


def undominated(low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of the intervals that lie in none of a smaller label, by their low ends.

    One that does covers no more of anything than the one around it. Kept: the ends of intervals so far that lie in no other.
    """
    lows: list[float] = []
    highs: list[float] = []
    out = []
    for at in np.lexsort((-high, low, label)).tolist():
        a, b = low[at], high[at]
        k = bisect_right(lows, a)
        if k and highs[k - 1] >= b:
            continue
        first, last = bisect_left(lows, a), bisect_right(highs, b)
        lows[first:max(first, last)], highs[first:max(first, last)] = [a], [b]
        out.append(at)
    kept = np.array(out, dtype=np.int64)
    return kept[np.argsort(low[kept], kind="stable")]


def widest(t0: np.ndarray, t1: np.ndarray, l0: np.ndarray, l1: np.ndarray, label: np.ndarray, centre_bonus: float, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token that meets a label: its place, the largest cover, and the smallest label that has it."""
    kept = undominated(l0, l1, label)
    l0, l1, label = l0[kept], l1[kept], label[kept]
    reach, order = np.maximum.accumulate(l1), np.lexsort((t1, t0))
    found = [(order[:0], t0[:0], label[:0])]
    while len(order):
        first = int(np.searchsorted(reach, t0[order[0]], "right"))
        some, order = np.split(order, [max(1, at_once // max(1, len(l0) - first))])
        near = slice(first, max(first, int(np.searchsorted(l0, t1[some].max()))))
        a, b, low, high = t0[some, None], t1[some, None], l0[near], l1[near]
        middle = (a + b) / 2
        cover = np.maximum(0.0, np.minimum(b, high) - np.maximum(a, low)) + np.where((middle >= low) & (middle <= high), centre_bonus, 0.0)
        cover[(a >= high) | (low >= b)] = -np.inf
        best = cover.max(axis=1, initial=-np.inf)
        met = best > -np.inf
        if met.any():
            found.append((some[met], best[met], np.where(cover[met] == best[met, None], label[near], label[near].max()).min(axis=1)))
    return tuple(map(np.concatenate, zip(*found)))


def best_overlap(tokens: DataFrame, labels: DataFrame, on: list[str], token: str, label: str, width: float, centre_bonus: float = 1000.0) -> DataFrame:
    """For each token the label with the largest horizontal overlap, one holding the token's centre first: token, label. Columns tx0, tx1 and lx0, lx1.

    Distinct tokens meet the labels of a cell of the given width; of these only those count that lie in none of a smaller number.
    """
    kinds = dict(labels.dtypes) | dict(tokens.dtypes)
    shapes = bucketed(tokens.select(*on, "tx0", "tx1").distinct(), "tx0", "tx1", width)
    own = bucketed(labels.groupBy(*on, "lx0", "lx1").agg(F.min(label).alias(label)), "lx0", "lx1", width)
    names = [*on, "tx0", "tx1"]

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        at, cover, won = widest(*(here[c].to_numpy() for c in ("tx0", "tx1")), *(there[c].to_numpy() for c in ("lx0", "lx1", label)), centre_bonus)
        return pa.Table.from_arrays([*here.select(names).take(pa.array(at)).columns, pa.array(cover, pa.float64()), pa.array(won, there.schema.field(label).type)], [*names, "__c", "__l"])

    met = shapes.groupBy(*on, "cell").cogroup(own.groupBy(*on, "cell")).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", __c double, __l {kinds[label]}")
    first = F.struct(F.col("__c").alias("c"), (-F.col("__l")).alias("o"))
    found = met.groupBy(*names).agg(F.max_by(F.struct("__c", "__l"), first).alias("m")).select(*names, "m.*")
    return tokens.join(found, names).groupBy(*on, token).agg(F.max_by("__l", first).alias(label))


def lines_in(lines: DataFrame, rects: DataFrame, on: list[str], line: str, rect: str, share: float = 0.55, height: float = 64.0) -> DataFrame:
    """Lines that lie in a rectangle by at least a share of their own area. Columns x0..y1 and rx0..ry1. They meet in bands of the given height."""
    c = F.col
    inside = overlap(c("x0"), c("x1"), c("rx0"), c("rx1")) * overlap(c("y0"), c("y1"), c("ry0"), c("ry1"))
    area = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    met = interval_join(lines.select(*on, line, "x0", "y0", "x1", "y1"), rects.select(*on, rect, "rx0", "ry0", "rx1", "ry1"), on, ("y0", "y1"), ("ry0", "ry1"), height)
    return met.filter(inside >= area * share).select(*on, line, rect, "x0", "y0")


def text_of(hits: DataFrame, on: list[str], rect: str, line: str, separator: str = " ") -> DataFrame:
    """Lines of each rectangle, joined from top to bottom and left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", F.col(line).cast("string").alias("t"))))
    return hits.groupBy(*on, rect).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias("text"))


def texts_in(lines: DataFrame, rects: DataFrame, on: list[str], line: str, rect: str, share: float = 0.55, height: float = 64.0, separator: str = " ") -> DataFrame:
    """The text of each rectangle: its lines by ``lines_in`` in the order of ``text_of``, worked out once for equal rectangles, without a row for each line of each.

    A band's lines are put in order once. A line belongs to the band in which its overlap with a rectangle
    begins, so the texts of a rectangle's bands, from the top, are its text.
    """
    kinds, shape = dict(rects.dtypes), ["rx0", "ry0", "rx1", "ry1"]
    names = [*on, *shape, "cell"]
    shapes = bucketed(rects.select(*on, *shape).distinct(), "ry0", "ry1", height)
    banded = bucketed(lines.select(*on, F.col(line).cast("string").alias("t"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).dropna(), "y0", "y1", height)

    def run(here: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by([(c, "ascending") for c in ("y0", "x0", "t")])
        x0, y0, x1, y1 = (there[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        text, least, begins = np.array(there["t"].to_pylist(), object), (x1 - x0) * (y1 - y0) * share, np.floor(y0 / height)
        places, out = [], []
        for i, (a0, b0, a1, b1, cell) in enumerate(zip(*(here[c].to_numpy() for c in [*shape, "cell"]))):
            near = slice(0, int(np.searchsorted(y0, b1)))
            inside = np.maximum(0.0, np.minimum(x1[near], a1) - np.maximum(x0[near], a0)) * np.maximum(0.0, np.minimum(y1[near], b1) - np.maximum(y0[near], b0))
            held = text[near][(inside >= least[near]) & (y1[near] > b0) & (np.maximum(begins[near], np.floor(b0 / height)) == cell)]
            if len(held):
                places.append(i), out.append(separator.join(held))
        return pa.Table.from_arrays([*here.select(names).take(pa.array(places, pa.int64())).columns, pa.array(out, pa.string())], [*names, "text"])

    met = shapes.groupBy(*on, "cell").cogroup(banded.groupBy(*on, "cell")).applyInArrow(run, ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in names) + ", text string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda s: s["text"]), separator).alias("text")
    return rects.join(met.groupBy(*on, *shape).agg(whole), [*on, *shape]).select(*on, rect, "text")


def zip_if_equal(left: DataFrame, right: DataFrame, on: list[str], l_order: list[str], r_order: list[str]) -> DataFrame:
    """Pair the rows of two sides in order, only for keys where their numbers agree."""
    a = left.withColumn("__i", F.row_number().over(W.partitionBy(*on).orderBy(*l_order))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*on)))
    b = right.withColumn("__i", F.row_number().over(W.partitionBy(*on).orderBy(*r_order))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*on)))
    return a.join(b, [*on, "__i", "__n"]).drop("__n").withColumnRenamed("__i", "position")


def reaches(boxes: DataFrame, on: list[str]) -> DataFrame:
    """The stretches that the boxes of a key cover together, one row for each: on, bx0, bx1."""
    w = W.partitionBy(*on).orderBy("bx0")
    furthest = boxes.dropna(subset=[*on, "bx0", "bx1"]).groupBy(*on, "bx0").agg(F.max("bx1").alias("bx1"))
    apart = F.col("bx0") > F.max("bx1").over(w.rowsBetween(W.unboundedPreceding, -1))
    begun = furthest.withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return begun.groupBy(*on, "__run").agg(F.min("bx0").alias("bx0"), F.max("bx1").alias("bx1")).drop("__run")


def row_lines(lines: DataFrame, boxes: DataFrame, on: list[str], field: str, pad_y: float = 6, pad_x: float = 10, height: float = 64.0) -> DataFrame:
    """Distinct lines that touch any box of a field, joined in order: on, field, text. Boxes bx0..by1, lines x0..y1 and text.

    They meet in bands of the given height. Boxes of a field and of one middle that touch each other count as one, as whatever touches that touches one of them.
    """
    c = F.col
    middle = (c("by0") + c("by1")) / 2
    banded = lines.withColumn("__band", F.explode(F.sequence(F.floor((c("y0") - pad_y) / height), F.floor((c("y1") + pad_y) / height))))
    hit = c("__middle").between(c("y0") - pad_y, c("y1") + pad_y) & (c("x1") >= c("bx0") - pad_x) & (c("x0") <= c("bx1") + pad_x)
    met = banded.join(reaches(boxes.withColumn("__middle", middle), [*on, field, "__middle"]).withColumn("__band", F.floor(c("__middle") / height)), [*on, "__band"]).filter(hit).select(*on, field, "y0", "x0", "text").distinct()
    return met.groupBy(*on, field).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s["text"]), " ").alias("text"))


def nearest(points: DataFrame, targets: DataFrame, on: list[str], point: str, target: str, max_dx: float, max_dy: float) -> DataFrame:
    """The nearest target of each point within limits on both axes: point, target, distance. Columns px, py and qx, qy. Distinct places meet in cells of the limits' size."""
    dx, dy = F.abs(F.col("px") - F.col("qx")), F.abs(F.col("py") - F.col("qy"))
    places = [*on, "px", "py"]
    around = with_neighbours(points.select(*places).distinct(), "px", "py", max_dx, max_dy)
    first = targets.groupBy(*on, "qx", "qy").agg(F.min(target).alias(target))
    near = around.join(first.select("*", *cell_of("qx", "qy", max_dx, max_dy)), [*on, "cx", "cy"]).filter((dx <= max_dx) & (dy <= max_dy)).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    best = F.min_by(F.struct(target, "distance"), F.struct(F.round("distance", 9).alias("d"), target)).alias("n")
    found = near.groupBy(*places).agg(best).select(*places, "n.*")
    return points.join(found, places).groupBy(*on, point).agg(best).select(*on, point, F.col(f"n.{target}").alias(target), F.round("n.distance", 4).alias("distance"))


def unknown_boxes(found: DataFrame, known: DataFrame, on: list[str], close: float = 8) -> DataFrame:
    """Found boxes with no known box of the same key closer than so much on both axes. Columns px, py and qx, qy."""
    around = with_neighbours(known.select(*(F.col(c).alias(f"__{c}") for c in on), "qx", "qy").distinct(), "qx", "qy", close, close).withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
    cells = found.select("*", *cell_of("px", "py", close, close))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on] + [F.col("cx") == F.col("__cx"), F.col("cy") == F.col("__cy")]
    return cells.join(around, [*same, F.abs(F.col("px") - F.col("qx")) < close, F.abs(F.col("py") - F.col("qy")) < close], "left_anti").drop("cx", "cy")


def same_row(fields: DataFrame, on: list[str], field: str, y: str, pad: float = 18) -> DataFrame:
    """Pairs of fields of a page whose centres are close, by an equality join on bands: on, field, other."""
    band = F.floor(F.col(y) / pad)
    left = fields.select(*on, F.col(field), F.col(y).alias("__y"), F.explode(F.array(band - 1, band, band + 1)).alias("__band"))
    right = fields.select(*on, F.col(field).alias("other"), F.col(y).alias("__y2"), band.alias("__band"))
    return left.join(right, [*on, "__band"]).filter(F.abs(F.col("__y") - F.col("__y2")) <= pad).select(*on, field, "other")


def weight_within(at: np.ndarray, weight: np.ndarray, pad: float) -> np.ndarray:
    """The weight of all places no further than so much from each. Places are distinct and ascend."""
    first, last = np.searchsorted(at, at - pad), np.searchsorted(at, at + pad, "right") - 1
    for edge, out in ((first, -1), (last, 1)):  # where a bound was rounded, the difference itself decides
        while (far := np.abs(at - at[edge]) > pad).any():
            edge[far] -= out
        while (near := (edge + out >= 0) & (edge + out < len(at)) & (np.abs(at - at[np.clip(edge + out, 0, len(at) - 1)]) <= pad)).any():
            edge[near] += out
    sums = np.append(0, np.cumsum(weight))
    return sums[last + 1] - sums[first]


def row_mates(fields: DataFrame, on: list[str], field: str, y: str, pad: float = 18) -> DataFrame:
    """How many fields of its page have a centre close to each field's, itself included: on, field, others. A page's distinct centres are one group."""
    kinds, names = dict(fields.dtypes), [*on, y]
    centres = fields.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))

    def run(page: pa.Table) -> pa.Table:
        page = page.sort_by(y)
        return page.select(names).append_column("__n", pa.array(weight_within(page[y].to_numpy(), page["__n"].to_numpy(), pad)))

    around = centres.groupBy(*on).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __n bigint")
    return fields.join(around, names).groupBy(*on, field).agg(F.sum("__n").alias("others"))


def anchored_rect(fields: DataFrame, boxes: DataFrame, on: list[str], gap: float) -> DataFrame:
    """Rectangles by rule: right of a box (after), between two boxes, or across the page (span).

    ``fields``: field, rule, first, second; ``boxes``: name, x0, x1. Result: on, field, left, right.
    """
    b1 = boxes.select(*on, F.col("name").alias("first"), F.col("x0").alias("f0"), F.col("x1").alias("f1"))
    b2 = boxes.select(*on, F.col("name").alias("second"), F.col("x0").alias("s0"))
    joined = b1.join(F.broadcast(fields), "first").join(b2, [*on, "second"], "left")
    left = F.when(F.col("rule") == "span", 0.0).otherwise(F.col("f1") + gap)
    right = F.when(F.col("rule") == "between", F.col("s0") - gap).when(F.col("rule") == "after", F.col("f1") + gap + 10 * (F.col("f1") - F.col("f0"))).otherwise(F.col("f0") - gap)
    return joined.select(*on, "field", left.alias("left"), right.alias("right"))


def restored(master: DataFrame, present: DataFrame, key: list[str], sources: list[str]) -> DataFrame:
    """Present rows and, for keys that are missing, the master's; ``rect`` is the first of the sources that is known."""
    missing = master.join(present.select(*key), key, "left_anti")
    return present.unionByName(missing).withColumn("rect", F.coalesce(*sources))


def proportional(slots: DataFrame, frm: DataFrame, to: DataFrame, on: list[str]) -> DataFrame:
    """Slots of one rectangle at the same shares of another. Columns s0, s1; a0, a1; b0, b1."""
    c = F.col
    scale = (c("b1") - c("b0")) / (c("a1") - c("a0"))
    return slots.join(frm, on).join(to, on).select(*slots.columns, F.round(c("b0") + (c("s0") - c("a0")) * scale, 4).alias("t0"), F.round(c("b0") + (c("s1") - c("a0")) * scale, 4).alias("t1"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x0, y0, x1, y1."""
    both = overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def suppress(boxes: DataFrame, key: list[str], score: str, box: str, most: float = 0.55, smallest: float = 24.0) -> DataFrame:
    """Greedy non-maximum suppression, best first: a box stays if it overlaps no kept one too much. A fold over each page's boxes."""
    c = F.col
    fit = boxes.filter((c("x1") - c("x0")) * (c("y1") - c("y0")) >= smallest)
    item = F.struct((-c(score)).alias("s"), c(box).cast("bigint").alias("b"), *(c(n).cast("double").alias(n) for n in ("x0", "y0", "x1", "y1")))
    kind = "array<struct<s:double,b:bigint,x0:double,y0:double,x1:double,y1:double>>"
    g = fit.groupBy(*key).agg(F.array_sort(F.collect_list(item)).cast(kind).alias("__b"))
    kept = F.aggregate("__b", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k, x) >= most), acc).otherwise(F.array_append(acc, x)))
    return g.select(*key, F.explode(kept).alias("k")).select(*key, F.col("k.b").alias(box))


def thin_out(points: DataFrame, key: list[str], point: str, close: float = 8.0) -> DataFrame:
    """Points in order, without those closer than so much on both axes to one kept before. Columns px, py."""
    kind = "array<struct<p:bigint,x:double,y:double>>"
    g = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(point).cast("bigint").alias("p"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y")))).cast(kind).alias("__p"))
    kept = F.aggregate("__p", F.array().cast(kind), lambda acc, p: F.when(F.exists(acc, lambda k: (F.abs(k["x"] - p["x"]) < close) & (F.abs(k["y"] - p["y"]) < close)), acc).otherwise(F.array_append(acc, p)))
    return g.select(*key, F.explode(kept).alias("k")).select(*key, F.col("k.p").alias(point))


def label_rects(boxes: DataFrame, on: list[str], row: str, box: str, gap: float = 0.6, longest: float = 9.0) -> DataFrame:
    """The label's place right of each box: up to the next box of the row or so many widths. Columns x0, x1."""
    w = F.col("x1") - F.col("x0")
    nxt = F.lead("x0").over(W.partitionBy(*on, row).orderBy("x0", box))
    right = F.least(F.col("x1") + w * longest, F.coalesce(nxt - w * gap, F.lit(1e12)))
    return boxes.select(*on, box, F.col("x1").alias("left"), F.round(F.greatest(right, F.col("x1")), 4).alias("right"))


def snap_to_rules(rects: DataFrame, rules: DataFrame, on: list[str], rect: str) -> DataFrame:
    """The nearest rule at or left of a rectangle's left edge and right of its right edge. Columns l, r and rule."""
    g = rules.groupBy(*on).agg(F.array_sort(F.collect_set("rule")).alias("__r"))
    low = F.array_max(F.filter("__r", lambda v: v <= F.col("l")))
    high = F.array_min(F.filter("__r", lambda v: v >= F.col("r")))
    return rects.join(g, on, "left").select(*on, rect, F.coalesce(low, "l").alias("left"), F.coalesce(high, "r").alias("right"))


def row_signature(rows: DataFrame, boxes: DataFrame, on: list[str], row: str) -> DataFrame:
    """How many boxes have their middle between each row's bounds. Columns top, bottom and y."""
    hits = rows.join(boxes.select(*on, "y"), on, "left")
    return hits.groupBy(*on, row).agg(F.count_if((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))).alias("boxes"))
