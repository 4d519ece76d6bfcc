"""The smaller rules of form processing: routing, gates, option expansion, alignment, slots, directories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmend.functions import text as T
from quillmend.functions.dates import let

NARROW = ("digits", "decimal", "phone", "postal", "date_digits", "kana")


def wants_proofreading(kind: Column, pii: Column, charset: Column, is_date: Column, empty: Column, confidence: Column, value: Column, least: float = 0.70, shortest: int = 4) -> Column:
    """Free text that was read well enough to be repaired."""
    return kind.isin("text", "textarea") & (pii == "") & (charset == "") & ~is_date & ~empty & (F.coalesce(confidence, F.lit(0.0)) >= least) & (F.length(F.trim(F.coalesce(value, F.lit("")))) >= shortest)


def worth_asking(raw: Column, empty: Column, candidates: Column, script: Column, confidence: Column) -> Column:
    """Entries that a suggestion may help: candidates (structs score, source) that did not settle it, and a readable text."""
    own = F.filter(candidates, lambda c: F.coalesce(c["source"], F.lit("")) != "llm")
    settled = F.coalesce(F.get(own, F.lit(0))["score"] >= 0.72, F.lit(False))
    return (F.coalesce(raw, F.lit("")) != "") & ~empty & (F.size(own) > 0) & ~settled & (F.coalesce(script, F.lit(1.0)) >= 0.5) & (F.coalesce(confidence, F.lit(0.0)) < 0.72)


def reader_for(kind: Column, charset: Column, is_date: Column) -> Column:
    """Which reader serves a field: lines for free text, characters for narrow character sets and dates."""
    return F.when(kind.isin("text", "textarea") & ~is_date & ~charset.isin(*NARROW), "lines").otherwise("characters")


def truthy(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "false", "0", "no", "off")


def chosen_format(value: Column, known: tuple[str, ...] = ("markdown", "json")) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*known), low).otherwise(known[0])


def failed(warnings: Column, form_id: Column, signs: tuple[str, ...] = ("様式を判別できませんでした", "読み取れるページがありません")) -> Column:
    """Whether a record was not read at all."""
    return F.exists(warnings, lambda w: F.coalesce(*(F.when(F.contains(w, F.lit(s)), True) for s in signs), F.lit(False))) | (F.coalesce(form_id, F.lit("")) == "")


def provisional(confidence: Column, is_provisional: Column) -> Column:
    return F.when(is_provisional, F.round(confidence * 0.5, 3)).otherwise(confidence)


def candidate_list(typed: Column, suggestions: Column, stored: Column, default: Column, raw: Column, k: int = 8) -> Column:
    """What to offer for an entry: suggestions for typed text, else stored candidates, else the default; the raw reading first if new, the typed text never."""
    q, r = F.trim(F.coalesce(typed, F.lit(""))), F.trim(F.coalesce(raw, F.lit("")))
    items = F.when(q != "", F.slice(suggestions, 1, k)).when(F.size(stored) > 0, F.slice(stored, 1, k)).otherwise(F.slice(default, 1, k))
    with_raw = let(items, lambda i: F.when((r != "") & (r != q) & ~F.array_contains(i, r), F.array_prepend(i, r)).otherwise(i))
    return F.filter(with_raw, lambda x: x != q)


def by_preference(names: Column, preferred: list[str]) -> Column:
    """Names in order of a preference list, unknown ones last by name."""
    order = F.array(*map(F.lit, preferred))
    keyed = F.transform(names, lambda n: F.struct(F.when(F.array_contains(order, n), F.array_position(order, n)).otherwise(F.lit(99)).alias("o"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def fresh(wanted: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Distinct wanted keys that the cache lacks."""
    return wanted.select(*key).distinct().join(cached.select(*key), key, "left_anti")


def joined_value(values: Column) -> Column:
    """Values of several fields as one list, blanks left out."""
    return F.filter(F.flatten(values), lambda v: v.isNotNull() & (v != ""))


def expanded_options(text: Column, options: Column) -> Column:
    """Places of the options that a free answer names, the longest consumed first.

    What is left over counts as the first option that it begins, that begins it, or that it is much like; null if there is none.
    """
    ordered = F.array_sort(F.transform(options, lambda o, i: F.struct((-F.length(o)).alias("n"), i.alias("i"), o.alias("o"))))
    start = F.struct(text.alias("rest"), F.array().cast("array<int>").alias("hit"))

    def step(acc: Column, c: Column) -> Column:
        at = F.instr(acc["rest"], c["o"])
        cut = F.concat(F.substring(acc["rest"], F.lit(1), at - 1), F.substring(acc["rest"], at + F.length(c["o"]), F.length(acc["rest"])))
        found = (at > 0) & (c["o"] != "")
        return F.struct(F.when(found, cut).otherwise(acc["rest"]).alias("rest"), F.when(found, F.array_append(acc["hit"], c["i"])).otherwise(acc["hit"]).alias("hit"))

    named = F.aggregate(ordered, start, step)
    rest = F.regexp_replace(named["rest"], r"[・,、／/\s]", "")
    placed = F.transform(options, lambda o, i: F.struct(o.alias("o"), i.alias("i")))
    fits = lambda c, ratio: (c["o"] != "") & (F.startswith(c["o"], rest) | F.startswith(rest, c["o"]) | (ratio >= T.SAME_OPTION))
    near = F.filter(F.zip_with(placed, T.best_ratios(options, F.array(rest)), lambda c, ratio: F.when(fits(c, ratio), c["i"])), lambda i: i.isNotNull())
    hits = F.when(rest == "", named["hit"]).when(F.size(near) > 0, F.array_union(named["hit"], F.array(F.get(near, F.lit(0)))))
    return F.when(F.size(hits) > 0, F.array_sort(hits))


def compared_form(text: Column, kind: Column, hiragana) -> Column:
    """What is compared for a field: digits only, a date without era and final mark, folded kana, or the text without blanks."""
    t = F.regexp_replace(text, r"[\s　]+", "")
    return F.when(kind == "digits", F.regexp_replace(t, r"\D", "")).when(kind == "date", F.regexp_replace(F.regexp_replace(t, "明治|大正|昭和|平成|令和", ""), "日+$", "")).when(kind == "kana", hiragana(t)).otherwise(t)


def split_address(text: Column) -> Column:
    """Postal code and address, in compatibility form."""
    pattern = r"^〒?\s*(\d{3})\s*[-‐－ー]?\s*(\d{4})\s*(.*)$"
    t = F.trim(F.replace(text, F.lit("　"), F.lit(" ")))
    hit = t.rlike(pattern)
    return F.struct(F.when(hit, F.concat(F.regexp_extract(t, pattern, 1), F.lit("-"), F.regexp_extract(t, pattern, 2))).otherwise("").alias("postal"), F.when(hit, F.trim(F.regexp_extract(t, pattern, 3))).otherwise(t).alias("address"))


def as_of_date(header: Column) -> Column:
    """The ISO date of a heading that states an era's year, month and day."""
    pattern = r"(令和|平成)\s*(\d+)\s*年\s*(\d+)\s*月\s*(\d+)\s*日現在"
    part = lambda i: F.regexp_extract(header, pattern, i).try_cast("int")
    base = F.when(F.regexp_extract(header, pattern, 1) == "令和", 2018).otherwise(1988)
    return F.when(header.rlike(pattern), F.format_string("%04d-%02d-%02d", base + part(2), part(3), part(4)))


def region_of(header: Column, sheet: Column, file: Column, names: list[str], codes: dict[str, str], romaji: dict[str, str], sole: str = "") -> Column:
    """The region of a sheet: its heading in brackets, its name, a code, a name or a romanised name in the file's, or the only one there is."""
    alternatives = "|".join(names)
    bracket = F.nullif(F.regexp_extract(header, rf"[\[［]\s*({alternatives})\s*[\]］]", 1), F.lit(""))
    titled = F.when(sheet.isin(*names), sheet)
    coded = F.coalesce(*(F.when(file.rlike(rf"(?:^|[^0-9]){c}(?:[^0-9]|$)"), n) for c, n in codes.items())) if codes else F.lit(None)
    named = F.coalesce(*(F.when(F.contains(file, F.lit(n.rstrip("都道府県"))), n) for n in names))
    roman = F.coalesce(*(F.when(F.contains(F.lower(file), F.lit(r)), n) for r, n in romaji.items())) if romaji else F.lit(None)
    return F.coalesce(bracket, titled, coded, named, roman, F.lit(sole))


def directory_rows(rows: DataFrame, key: list[str], ordinal: str, closed: str = "廃止", known: tuple[str, ...] = ("現存", "休止", "廃止")) -> DataFrame:
    """Entries of a sheet with columns no, code, name, address, phone and status_cells; the status stands in the row below, closed ones go."""
    below = F.lead("status_cells").over(W.partitionBy(*key).orderBy(ordinal))
    status = F.get(F.filter(F.slice(F.coalesce(below, F.array()), 1, 4), lambda c: c.isin(*known)), F.lit(0))
    fit = rows.withColumn("status", F.coalesce(status, F.lit(known[0]))).filter(F.col("no").rlike(r"^\d+$") & (F.coalesce(F.col("name"), F.lit("")) != "") & F.startswith("address", F.lit("〒")))
    return fit.filter(F.col("status") != closed).withColumn("place", split_address(F.col("address"))).select(*key, ordinal, "code", "name", F.col("place.postal").alias("postal"), F.col("place.address").alias("address"), F.trim("phone").alias("phone"), "status")


def region_partition(spark: SparkSession, path: str, region: str, wanted: list[str]) -> DataFrame:
    """Rows of some regions of a directory partitioned by region: other partitions are not listed."""
    return spark.read.parquet(path).filter(F.col(region).isin(wanted))


MARKS = {"年": "year", "月": "month", "日": "day"}


def assigned_parts(chars: Column, slots: Column) -> Column:
    """year, month and day of digits by position (structs c, x0): marks name the part before them, "元" is 1, more than two digits are no part.

    Before any mark, stretches go to the parts in order; after one, to the nearest slot (array of three centres), if slots are given.
    """
    kind = "struct<parts:array<int>,cur:string,x:double,idx:int,marks:boolean>"
    none = F.lit(None).cast("int")
    start = F.struct(F.array(none, none, none).alias("parts"), F.lit("").alias("cur"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("idx"), F.lit(False).alias("marks")).cast(kind)

    def put(parts: Column, at: Column, cur: Column) -> Column:
        ok = cur.rlike(r"^\d{1,2}$")
        return F.transform(parts, lambda p, i: F.when((i == at) & p.isNull() & ok, cur.try_cast("int")).otherwise(p))

    def slot(x: Column) -> Column:
        return F.when(F.size(slots) == 3, F.array_position(F.transform(slots, lambda s: F.abs(s - x)), F.array_min(F.transform(slots, lambda s: F.abs(s - x)))) - 1).otherwise(-1).cast("int")

    def break_(acc: Column) -> Column:
        in_order = ~acc["marks"] & (acc["idx"] < 3)
        at = F.when(in_order, acc["idx"]).otherwise(slot(acc["x"]))
        return F.struct(F.when(acc["cur"] != "", put(acc["parts"], at, acc["cur"])).otherwise(acc["parts"]).alias("parts"), F.lit("").alias("cur"), F.lit(None).cast("double").alias("x"), F.when((acc["cur"] != "") & in_order, acc["idx"] + 1).otherwise(acc["idx"]).alias("idx"), acc["marks"].alias("marks")).cast(kind)

    def step(acc: Column, ch: Column) -> Column:
        digit = ch["c"].rlike("^[0-9]$") | ((ch["c"] == "元") & (acc["cur"] == ""))
        value = F.when(ch["c"] == "元", "1").otherwise(ch["c"])
        grown = F.struct(acc["parts"].alias("parts"), F.concat(acc["cur"], value).alias("cur"), F.coalesce(acc["x"], ch["x0"]).alias("x"), acc["idx"].alias("idx"), acc["marks"].alias("marks")).cast(kind)
        at = F.when(ch["c"] == "年", 0).when(ch["c"] == "月", 1).when(ch["c"] == "日", 2)
        marked = F.struct(put(acc["parts"], at, acc["cur"]).alias("parts"), F.lit("").alias("cur"), F.lit(None).cast("double").alias("x"), (at + 1).alias("idx"), F.lit(True).alias("marks")).cast(kind)
        return F.when(digit, grown).when(at.isNotNull(), marked).otherwise(break_(acc))

    def finish(acc: Column) -> Column:
        at = F.when(~acc["marks"] & (acc["idx"] < 3), acc["idx"]).when(F.size(slots) == 3, slot(acc["x"])).when(acc["idx"] < 3, acc["idx"]).otherwise(-1)
        done = F.when(acc["cur"] != "", put(acc["parts"], at, acc["cur"])).otherwise(acc["parts"])
        return F.struct(done[0].alias("year"), done[1].alias("month"), done[2].alias("day"))

    return F.aggregate(chars, start, step, finish)


def value_text(words: Column, picked: Column, struck: Column) -> Column:
    """Picked words, or that there is none, and what was struck out."""
    join = lambda flags: F.array_join(F.transform(F.filter(F.arrays_zip(words.alias("w"), flags.alias("f")), lambda s: s["f"]), lambda s: s["w"]), "、")
    out = F.when(join(picked) == "", "（印なし）").otherwise(join(picked))
    return F.when(join(struck) == "", out).otherwise(F.concat(out, F.lit("　※二重線で消された印: "), join(struck)))


def read_tokens(lines: DataFrame, text: str) -> DataFrame:
    """Words of tab-separated reader output (twelve columns, confidence 11th, text 12th) with their place; headings and blanks go."""
    p = F.split(text, "\t")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    out = lines.select(*lines.columns, F.get(p, F.lit(2)).try_cast("int").alias("block"), F.get(p, F.lit(3)).try_cast("int").alias("par"), F.get(p, F.lit(4)).try_cast("int").alias("line"), F.trim(F.get(p, F.lit(11))).alias("token"), n(6).alias("x0"), (n(6) + n(8)).alias("x1"), n(10).alias("confidence"))
    return out.filter((F.coalesce("token", F.lit("")) != "") & F.col("x0").isNotNull())


def areas_of_commits(files: DataFrame, commit: str, path: str, prefixes: list[tuple[str, str]], rest: str = "other") -> DataFrame:
    """Distinct areas that each commit touches, in the order listed, and how many files."""
    area = F.coalesce(*(F.when(F.startswith(F.col(path), F.lit(p)), F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"))) for i, (p, a) in enumerate(prefixes)), F.struct(F.lit(len(prefixes)).alias("i"), F.lit(rest).alias("a")))
    return files.groupBy(commit).agg(F.array_join(F.transform(F.array_sort(F.collect_set(area)), lambda s: s["a"]), ",").alias("areas"), F.count(F.lit(1)).alias("files"))


# What pairing two rows of boxes gains or costs.
PAIR_SAME, PAIR_PER_BOX, PAIR_MOST_BOXES, PAIR_EMPTY, PAIR_OFF_BY_ONE, PAIR_UNLIKE, PAIR_DISTANCE, SKIP = 3.0, 0.5, 4, 0.8, 0.5, -2.0, 4.0, 0.6


def pairing_gains(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What pairing each (boxes, middle) of one side with each of the other gains."""
    n, m = a[:, 0][:, None], b[:, 0][None, :]
    filled = (n > 0) & (m > 0)
    alike = np.select([(n == m) & filled, n == m, filled & (np.abs(n - m) <= 1)], [PAIR_SAME + np.minimum(n, PAIR_MOST_BOXES) * PAIR_PER_BOX, PAIR_EMPTY, PAIR_OFF_BY_ONE], PAIR_UNLIKE)
    return alike - np.abs(a[:, 1][:, None] - b[:, 1][None, :]) * PAIR_DISTANCE


def total_rows(a: np.ndarray, b: np.ndarray, above: np.ndarray, skip: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gains of each of ``a`` with all of ``b``, and the row of totals below ``above`` and so on.

    A whole row is made at a time: a run of items left out on one side is a running
    maximum once each place is lifted by what skipping up to it costs.
    """
    lift = skip * np.arange(len(b) + 1)
    known: dict[float, np.ndarray] = {}
    level = np.column_stack([b[:, 0], np.zeros(len(b))])
    for boxes, middle in a:
        if boxes not in known:
            known = known if len(known) < 16 else {}
            known[boxes] = pairing_gains(np.array([[boxes, 0.0]]), level)[0]
        gains = np.abs(middle - b[:, 1])
        gains *= PAIR_DISTANCE
        np.subtract(known[boxes], gains, out=gains)
        row = above - skip
        np.maximum(row[1:], above[:-1] + gains, out=row[1:])
        row += lift
        np.maximum.accumulate(row, out=row)
        row -= lift
        yield gains, row
        above = row


def aligned(a: list[tuple[int, float]] | np.ndarray, b: list[tuple[int, float]] | np.ndarray, skip: float = SKIP) -> list[tuple[int, int]]:
    """Order-keeping pairs of two sequences of (boxes, relative middle) with the greatest total gain, less a cost for each item left out.

    Every so many rows of totals are kept. The way back makes the rows between two of them
    again, up to the column that it has come to, and keeps two bits of each place near it: whether
    a pair or an item left out leads there. So memory grows with the length to the power of 1.5.
    """
    if not len(a) or not len(b):
        return []
    a, b = np.array(a, float), np.array(b, float)
    every = max(1, int((32 * len(a)) ** 0.5))  # as many bytes for the rows kept as for the bits
    kept = [-(skip * np.arange(len(b) + 1))]
    for i, (_, row) in enumerate(total_rows(a, b, kept[0], skip), 1):
        if i % every == 0:
            kept.append(row)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        top = (i - 1) // every * every
        above, bits, least = kept[top // every][: j + 1], [], max(0, j - 4 * every)
        for gains, row in total_rows(a[top:i], b[:j], above, skip):
            paired = np.abs(row[least + 1 :] - above[least:-1] - gains[least:]) < 1e-9
            left_out = np.abs(row[least + 1 :] - above[least + 1 :] + skip) < 1e-9
            bits.append((np.packbits(paired), np.packbits(left_out)))
            above = row
        while i > top and j > least:
            at, bit = j - 1 - least >> 3, 128 >> (j - 1 - least & 7)
            if bits[i - 1 - top][0][at] & bit:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif bits[i - 1 - top][1][at] & bit:
                i -= 1
            else:
                j -= 1
    return pairs[::-1]


def align_sequences(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Aligned places of two arrays of structs (boxes, middle) a key: key, i, j. A sequence is one page's rows.

    The work of a key grows with the product of its lengths, so keys are dealt out, whatever few bytes they have.
    """
    kind, deal = dict(rows.dtypes)[key], 16 * rows.sparkSession.sparkContext.defaultParallelism

    def sequence(value: pa.ListScalar) -> np.ndarray:
        items = value.values
        return np.zeros((0, 2)) if items is None else np.column_stack([items.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, b in zip(*batch.columns):
                pairs = np.array(aligned(sequence(a), sequence(b)), np.int32).reshape(-1, 2)
                keys = pa.array([k.as_py()], batch.schema.field(0).type).take(pa.array(np.zeros(len(pairs), np.int32)))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.ascontiguousarray(pairs[:, s])) for s in (0, 1))], [key, "i", "j"])

    return rows.select(key, left, right).repartition(deal, key).mapInArrow(run, f"{key} {kind}, i int, j int")
