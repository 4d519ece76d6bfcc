"""Partial dates in years of eras, as Column functions."""

from __future__ import annotations

import operator
from functools import reduce

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# First years of the eras, and their short forms.
ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019}
ALIASES = {"明": "明治", "大": "大正", "昭": "昭和", "平": "平成", "令": "令和", "M": "明治", "T": "大正", "S": "昭和", "H": "平成", "R": "令和"}
ERA = "明治|大正|昭和|平成|令和|明|大|昭|平|令"


def _lookup(table: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def era_name(era: Column) -> Column:
    """The full name of an era or its short form, else empty."""
    return F.coalesce(F.element_at(_lookup(ALIASES | {e: e for e in ERAS}), F.trim(F.coalesce(era, F.lit("")))), F.lit(""))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: expressions that use a value many times would otherwise repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(text: Column) -> Column:
    """era, year, month and day of a tolerant date; parts that are missing or out of range are null.

    ``text`` is in compatibility form. Without any mark, the first numbers are taken in order.
    """
    return let(text, _parse)


def _parse(text: Column) -> Column:
    era = era_name(F.regexp_extract(text, f"({ERA})", 1))
    return let(F.regexp_replace(text, f"^.*?(?:{ERA})(.*)$", "$1"), lambda t: _parts(era, t))


def _parts(era: Column, t: Column) -> Column:
    marks = F.struct(F.regexp_extract(t, r"(元\s*年)", 1).alias("first"), F.regexp_extract(t, r"(\d+\D{0,2}年)", 1).alias("counted"))

    def from_year(m: Column) -> Column:
        is_first = (m["first"] != "") & ((m["counted"] == "") | (F.instr(t, m["first"]) <= F.instr(t, m["counted"])))
        year = F.when(is_first, 1).otherwise(_number(m["counted"], r"(\d+)"))
        rest = let(F.when(is_first, m["first"]).otherwise(m["counted"]), lambda k: F.when(k == "", t).otherwise(F.substring(t, F.instr(t, k) + F.length(k), F.length(t))))
        return F.struct(year.alias("year"), rest.alias("rest"))

    def from_rest(y: Column) -> Column:
        at = F.instr(y["rest"], F.lit("月"))
        day = F.when(at > 0, _number(F.substring(y["rest"], at + 1, F.length(y["rest"])), r"(\d+)")).otherwise(_number(t, r"(\d+)\D{0,2}日"))
        return F.struct(y["year"].alias("year"), _number(y["rest"], r"(\d+)\D{0,2}月").alias("month"), day.alias("day"), F.regexp_extract_all(t, F.lit(r"(\d{1,4})"), F.lit(1)).alias("numbers"))

    def checked(f: Column) -> Column:
        bare = f["year"].isNull() & f["month"].isNull() & f["day"].isNull()
        one = lambda n, i, high: let(F.when(bare, F.get(f["numbers"], F.lit(i)).try_cast("int")).otherwise(f[n]), lambda v: F.when(v.between(1, high), v)).alias(n)
        return F.struct(era.alias("era"), one("year", 0, 99), one("month", 1, 12), one("day", 2, 31))

    return let(let(let(marks, from_year), from_rest), checked)


def written(parts: Column) -> Column:
    """Year, month and day with their marks, leaving out what is missing."""
    return F.concat_ws("", *(F.concat(parts[n].cast("string"), F.lit(m)) for n, m in (("year", "年"), ("month", "月"), ("day", "日"))))


def gregorian(era: Column, year: Column, month: Column, day: Column) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd, as precise as the parts; null without era or year, or outside 1868 to 2200. No calendar check."""
    y = F.element_at(_lookup(ERAS), era_name(era)) + year - 1
    text = F.when(month.isNotNull() & day.isNotNull(), F.format_string("%04d-%02d-%02d", y, month, day)).when(month.isNotNull(), F.format_string("%04d-%02d", y, month)).otherwise(F.format_string("%04d", y))
    return F.when((year >= 1) & y.between(1868, 2200), text)


def enrich(text: Column, era: Column | None = None, fixed: bool = False) -> Column:
    """Parts, era, written form and Gregorian form; a given era fills in, or with ``fixed`` overrides, the one in the text."""
    given = era_name(era) if era is not None else F.lit("")

    def named(p: Column) -> Column:
        name = F.when((given != "") & (F.lit(fixed) | (p["era"] == "")), given).otherwise(p["era"])
        return let(name, lambda e: F.struct(e.alias("era"), p["year"].alias("year"), p["month"].alias("month"), p["day"].alias("day"), written(p).alias("text"), gregorian(e, p["year"], p["month"], p["day"]).alias("gregorian")))

    return let(parse(text), named)


def full_date(iso: Column) -> Column:
    """A date only from all ten characters of a real calendar day."""
    return F.when(F.length(iso) == 10, F.try_to_date(iso, "yyyy-MM-dd"))


def age(birth: Column, at: Column) -> Column:
    """Completed years between two full ISO dates; null outside 0 to 130."""
    b, a = full_date(birth), full_date(at)
    early = (F.month(a) * 100 + F.dayofmonth(a)) < (F.month(b) * 100 + F.dayofmonth(b))
    years = F.year(a) - F.year(b) - early.cast("int")
    return F.when(years.between(0, 130), years)


def age_agrees(birth: Column, at: Column, stated: Column) -> Column:
    """Whether a stated age is within a year of the computed one; null where either is missing."""
    return F.abs(age(birth, at) - stated) <= 1


def slot_confidence(parts: Column, confidences: Column, inked: Column) -> Column:
    """Mean confidence of the parts that were read, 0.85 where nothing is written, 0.2 where nothing was read; ink without a reading caps at 0.3."""
    found = F.filter(F.arrays_zip(parts.alias("p"), confidences.alias("c"), inked.alias("i")), lambda s: s["p"].isNotNull())
    missed = F.exists(F.arrays_zip(parts.alias("p"), inked.alias("i")), lambda s: s["p"].isNull() & s["i"])
    mean = F.aggregate(found, F.lit(0.0), lambda a, s: a + s["c"]) / F.size(found)
    base = F.when(F.size(found) > 0, mean).when(F.exists(inked, lambda i: i), 0.2).otherwise(0.85)
    return F.round(F.when(missed, F.least(base, F.lit(0.3))).otherwise(base), 3)


def merge_readings(first: Column, second: Column, low: int, high: int) -> Column:
    """The first plausible of two readings of one part."""
    return F.coalesce(F.when(first.between(low, high), first), F.when(second.between(low, high), second))


# How sure a date with so many parts is, and at most.
READ_BASE, READ_PER_PART, READ_MOST = 0.55, 0.15, 0.95
# What a year of an era, a month and a day can be.
PLAUSIBLE_PARTS = ((1, 99), (1, 12), (1, 31))


def reread(first: Column, confidence: Column, second: Column, again: Column, ranges: tuple[tuple[int, int], ...] = PLAUSIBLE_PARTS) -> Column:
    """Parts of a date from a reading and, where these are not plausible, from a second, narrower one; and the confidence.

    ``first`` and ``second`` are arrays of a part each, ``ranges`` their plausible values. The second reading's confidence
    (``again``, 0.5 if unknown) counts only if it filled something; each part that is there makes the date surer.
    """
    parts = [merge_readings(first[i], second[i], low, high) for i, (low, high) in enumerate(ranges)]
    filled = [~F.coalesce(first[i].between(low, high), F.lit(False)) & parts[i].isNotNull() for i, (low, high) in enumerate(ranges)]
    known = lambda c, unknown: F.when(F.coalesce(c, F.lit(0.0)) > 0, c).otherwise(unknown)
    base = F.when(reduce(operator.or_, filled), F.least(known(confidence, F.lit(1.0)), known(again, F.lit(0.5)))).otherwise(confidence)
    n = reduce(operator.add, (p.isNotNull().cast("int") for p in parts))
    sure = F.when(n > 0, F.least(F.lit(READ_MOST), known(base, F.lit(0.5)) * (READ_BASE + READ_PER_PART * n))).otherwise(0.0)
    return F.struct(F.array(*parts).alias("parts"), F.round(sure, 6).alias("confidence"))
