"""Normalising, repairing and judging noisy text, as Column functions.

Everything is a built-in expression except NFKC, edge trimming, runs of
look-alike katakana, sequence ratios and counts of characters by class, which have
none (or a slow one) and run as Arrow UDFs.
Null in, null out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

# Script ranges.
HIRAGANA, KATAKANA, KANJI = "ぁ-ゟ", "ァ-ヿ", "㐀-鿿豈-﫿"
JAPANESE = HIRAGANA + KATAKANA + KANJI

# Glyph variants met in readings, to the usual form. Pass a larger map where one is at hand.
VARIANTS = {
    "变": "変", "两": "両", "调": "調", "关": "関", "实": "実", "发": "発", "应": "応", "图": "図", "归": "帰", "气": "気",
    "检": "検", "验": "験", "续": "続", "经": "経", "给": "給", "级": "級", "缩": "縮", "练": "練", "职": "職", "认": "認",
    "护": "護", "访": "訪", "诊": "診", "语": "語", "读": "読", "说": "説", "谈": "談", "单": "単", "带": "帯", "剂": "剤",
    "济": "済", "录": "録", "险": "険", "难": "難", "头": "頭", "类": "類", "饮": "飲", "龄": "齢", "齿": "歯", "药": "薬",
    "养": "養", "营": "営", "术": "術", "创": "創", "伤": "傷", "疗": "療", "脏": "臓", "肾": "腎", "脑": "脳", "脉": "脈",
    "动": "動", "运": "運", "转": "転", "达": "達", "远": "遠", "进": "進", "过": "過", "边": "辺", "连": "連", "压": "圧",
    "现": "現", "视": "視", "观": "観", "长": "長", "门": "門", "问": "問", "间": "間", "闭": "閉", "开": "開", "对": "対",
    "钙": "カルシウム",
}
# Look-alikes of digits.
DIGIT_LOOKALIKES = {"О": "0", "Ｏ": "0", "ｌ": "1", "Ｉ": "1", "｜": "1", "－": "-", "―": "-", "‐": "-", "ー": "-"}
# Characters that matching ignores, and readings made of which are empty.
IGNORED = r"[\s　・･,、。.\-‐－―ー—_/\\()（）\[\]「」【】:：;；'\"]+"
ONLY_MARKS = r"^[()（）［］\[\]{}｛｝|｜/\\_—―‐\-・.,、。 　:：;；]+$"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


# Ratios of pairs that a batch of rows keeps, as values repeat.
RATIOS_KEPT = 1 << 14


@F.pandas_udf(ArrayType(DoubleType()))
def best_ratios(words: pd.Series, known: pd.Series) -> pd.Series:
    """For each of an array of words its highest sequence ratio with any of the known ones; 0 where either is empty."""

    @lru_cache(RATIOS_KEPT)
    def ratio(w: str, k: str) -> float:
        return SequenceMatcher(None, w, k).ratio()

    def one(these: Sequence[str], those: Sequence[str]) -> list[float]:
        return [max((ratio(w, k) for k in those if w and k), default=0.0) for w in these]

    return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(words, known)])


# Ratios from which two wordings count as the same, and a remainder as an option.
SAME_WORDING, SAME_OPTION = 0.72, 0.75


def close(a: Column, b: Column, least: float = SAME_WORDING) -> Column:
    """Whether two forms are the same wording: equal, one inside the other, or of a high sequence ratio. Empty ones are not."""
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), False).when(inside, True).otherwise(sequence_ratio(a, b) >= least)


# Characters that spell the same place.
PLACE_VARIANTS = {
    "竜": "龍", "ヶ": "ケ", "ガ": "ケ", "が": "ケ", "之": "ノ", "ノ": "ノ", "櫻": "桜", "澤": "沢", "瀧": "滝", "藝": "芸", "嶋": "島", "嶌": "島",
    "濱": "浜", "邊": "辺", "邉": "辺", "齋": "斎", "齊": "斉", "淺": "浅", "眞": "真", "德": "徳", "祿": "禄", "廣": "広", "區": "区", "縣": "県",
}


def same_place(a: Column, b: Column) -> Column:
    """Whether two place names differ only in variants of characters; null counts as empty."""
    left, right = (map_glyphs(F.coalesce(c, F.lit("")), PLACE_VARIANTS) for c in (a, b))
    return left == right


# The order in which a value's levels are shown, and the confidence that a lone character keeps at most.
NEEDS_CHECK, LONE_CHARACTER = ("low", "medium"), 0.30


def shown_level(confirmed: Column, anonymised: Column, edited: Column, confidence: Column) -> Column:
    """What a value is shown as: confirmed, anonymised, edited, or its level of confidence, the first that holds."""
    return F.when(confirmed, "confirmed").when(anonymised, "anonymised").when(edited, "edited").otherwise(confidence_level(confidence))


def needs_check(level: Column) -> Column:
    return level.isin(*NEEDS_CHECK)


def passes(level: Column, wanted: str) -> Column:
    """Whether a value passes the list's filter: all, those that need a check, or one level."""
    return F.lit(True) if wanted == "all" else needs_check(level) if wanted == "check" else level == wanted


def blank_lone(value: Column, confidence: Column) -> Column:
    """A free text of one character is blank, with little confidence and a note: value, confidence, note."""
    lone = F.length(F.regexp_replace(value, r"\s", "")) == 1
    return F.struct(F.when(lone, "").otherwise(value).alias("value"), F.when(lone, F.least(confidence, F.lit(LONE_CHARACTER))).otherwise(confidence).alias("confidence"), F.when(lone, "one character only").otherwise("").alias("note"))


def isolated(read: Callable[[str], str]):
    """A reader of one field as a function of a column: value and problem, so that an error in one row stays there."""

    @F.pandas_udf("struct<value:string,problem:string>")
    def guarded(values: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, str | None]] = []
        for v in values:
            try:
                out.append((None if v is None else read(v), None))
            except Exception as e:  # noqa: BLE001  whatever a reader raises belongs to its row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "problem"])

    return guarded


def map_glyphs(text: Column, table: Mapping[str, str]) -> Column:
    """Replace single characters, those with longer targets after the others."""
    single = {k: v for k, v in table.items() if len(k) == len(v) == 1 and k != v}
    out = F.translate(text, "".join(single), "".join(single.values())) if single else text
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in table.items() if len(k) == 1 and len(v) != 1), out)


def map_digits(text: Column) -> Column:
    return map_glyphs(text, DIGIT_LOOKALIKES)


def match_form(text: Column, variants: Mapping[str, str] = VARIANTS, compose: bool = True) -> Column:
    """The form under which strings are compared; ``compose=False`` skips NFKC for ASCII input and stays built-in."""
    out = map_glyphs(nfkc(text) if compose else text, variants)
    return F.lower(F.regexp_replace(F.translate(out, "ヶヵ", "ケカ"), IGNORED, ""))


def clean_reading(text: Column, variants: Mapping[str, str] = VARIANTS) -> Column:
    """Usual glyphs, trimmed; a reading of brackets and rules only is empty."""
    out = trim_space(map_glyphs(text, variants))
    return F.when(out.rlike(ONLY_MARKS), "").otherwise(out)


# Marks of printed labels, tick boxes at their ends, and signs that pass for the long vowel's.
LABEL_MARKS, LABEL_BOXES, LONG_VOWELS = r"[\s　:：・.,、。()（）\[\]【】「」]+", "^[口ロ□■☐▢〇○●]+|[口ロ□■☐▢]+$", r"[ー—–‐\-─―一]"


def label_form(text: Column, compose: bool = True) -> Column:
    """Comparison form of printed labels: no marks, no tick boxes at the ends, one long-vowel sign."""
    bare = F.regexp_replace(nfkc(text) if compose else text, LABEL_MARKS, "")
    return F.regexp_replace(F.regexp_replace(bare, LABEL_BOXES, ""), LONG_VOWELS, "ー")


# White space as browsers trim it.
SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0  -     　﻿]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


# Marks that carry no meaning in prose.
NOISE = "|｜!！\"'`^~*#$%&@={}<>\\"
_NOISE_CLASS = "[" + "".join("\\" + c if c in "^\\|{}*$" else c for c in NOISE) + "]"
NOISE_PATTERN = f"(?<![0-9０-９])%|(?!%){_NOISE_CLASS}"


# Marks that may lead a reading.
LEADING_MARKS = r"^[\s.,、。・:：;；\-ー_]+"


def strip_noise(text: Column) -> Column:
    """Drop meaningless marks (a percent sign after a digit stays), squeeze blanks, drop marks at the start."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, NOISE_PATTERN, ""), "[ 　]{2,}", " "))
    return F.regexp_replace(trim_space(out), LEADING_MARKS, "")


def noise_found(text: Column) -> Column:
    """The marks that strip_noise drops, in order."""
    return F.regexp_extract_all(text, F.lit(f"({NOISE_PATTERN})"), F.lit(1))


# Look-alikes between characters of one script (context on both sides, wrong, right).
CONTEXT = [
    (KATAKANA, "力", "カ"), (KATAKANA, "口", "ロ"), (KATAKANA, "二", "ニ"), (KATAKANA, "へ", "ヘ"),
    (HIRAGANA, "ヘ", "へ"), (KATAKANA, "一", "ー"), (KATAKANA, "[-−–—]", "ー"),
]


def fix_in_context(text: Column) -> Column:
    """Characters whose neighbours on both sides are of the script they were mistaken in, one rule after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, f"(?<=[{r[0]}]){r[1]}(?=[{r[0]}])", r[2]), CONTEXT, text)


# Characters that pass for katakana.
KATAKANA_LOOKALIKES = {
    "力": "カ", "口": "ロ", "二": "ニ", "卜": "ト", "夕": "タ", "工": "エ", "才": "オ", "八": "ハ", "千": "チ",
    "一": "ー", "厶": "ム", "巳": "ミ", "乂": "メ", "又": "マ",
}
_RUN = re.compile(f"[{KATAKANA}{''.join(KATAKANA_LOOKALIKES)}]{{2,}}")
_REAL = re.compile(f"[{KATAKANA}]")


@F.pandas_udf(StringType())
def fix_katakana_runs(values: pd.Series) -> pd.Series:
    """Turn look-alikes to katakana in every run that has a true katakana."""
    table = str.maketrans(KATAKANA_LOOKALIKES)

    def one(match: re.Match) -> str:
        run = match.group()
        return run.translate(table) if _REAL.search(run) else run

    return values.map(lambda v: _RUN.sub(one, v), na_action="ignore")


# Broken units and their right form.
UNITS = {
    "mmHq": "mmHg", "rnmHg": "mmHg", "mrnHg": "mmHg", "rnrnHg": "mmHg", "mmHa": "mmHg", "rng": "mg", "rnl": "mL", "rnL": "mL",
    "m1": "mL", "mI": "mL", "ml": "mL", "rnm": "mm", "crn": "cm", "kq": "kg", "kgs": "kg", "dI": "dL", "dl": "dL",
    "単佼": "単位", "単佐": "単位",
}


def fix_units(text: Column, units: Mapping[str, str] = UNITS) -> Column:
    """Repair broken units directly after a digit, the longest first."""
    longest = sorted(units.items(), key=lambda kv: -len(kv[0]))
    # A marker keeps a repaired unit from being read again by a shorter rule.
    marked = reduce(lambda c, iv: F.regexp_replace(c, f"(?<=[0-9０-９])(\\s*){re.escape(iv[1][0])}", f"$1{chr(0xE001 + iv[0])}"), enumerate(longest), text)
    return reduce(lambda c, iv: F.replace(c, F.lit("" + chr(0xE001 + iv[0])), F.lit(iv[1][1])), enumerate(longest), marked)


def replace_words(text: Column, pairs: Column) -> Column:
    """Apply an ordered array of structs (wrong, right) one after the other; later pairs see earlier results."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["wrong"], p["right"]))


def words_replaced(text: Column, pairs: Column) -> Column:
    """The pairs that apply when taken in order."""
    start = F.struct(text.alias("t"), F.array().cast("array<struct<wrong:string,right:string>>").alias("used"))

    def step(acc: Column, p: Column) -> Column:
        hit = F.contains(acc["t"], p["wrong"]) & (p["wrong"] != p["right"])
        return F.struct(F.replace(acc["t"], p["wrong"], p["right"]).alias("t"), F.when(hit, F.array_append(acc["used"], F.struct(p["wrong"].alias("wrong"), p["right"].alias("right")))).otherwise(acc["used"]).alias("used"))

    return F.aggregate(pairs, start, step, lambda acc: acc["used"])


def pair_array(pairs: Mapping[str, str]) -> Column:
    """An ordered literal for replace_words."""
    return F.array(*(F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in pairs.items() if w != r))


# Characters that plausible text is made of.
PLAUSIBLE = f"[^{JAPANESE}0-9０-９a-zA-Zａ-ｚＡ-Ｚ\\s、。・（）()「」『』〔〕：:；;／/＋+－\\-.,％%℃㎎㎏㎜㎝ー～〜]"


class CharacterCounts:
    """How many characters of a text are in each of some classes, given as patterns of one character."""

    KNOWN = 1 << 16

    def __init__(self, patterns: tuple[str, ...]):
        self.patterns = [re.compile(p, re.ASCII) for p in patterns]  # as in the JVM, \s and \d are of ASCII
        self.held = np.array([self._row(chr(c)) for c in range(128)], np.int64)
        self.more: np.ndarray | None = None

    def _row(self, char: str) -> list[bool]:
        return [p.fullmatch(char) is not None for p in self.patterns]

    def of(self, text: str) -> list[int]:
        """The length, and the number of each class."""
        if text.isascii():
            return [len(text), *(np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128) @ self.held).tolist()]
        if self.more is None:
            self.more = np.array([self._row(chr(c)) for c in range(self.KNOWN)], np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = codes[codes >= self.KNOWN]
        counts = np.bincount(codes[codes < self.KNOWN].astype(np.int64))
        sums = counts @ self.more[: len(counts)]
        for c in high.tolist():
            sums = sums + np.array(self._row(chr(c)), np.int64)
        return [len(text), *sums.tolist()]


def character_counts(text: Column, *patterns: str) -> Column:
    """A text's length and how many of its characters each pattern of one character fits, as an array."""

    @F.pandas_udf(ArrayType(LongType()))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = CharacterCounts(patterns)
        for values in batches:
            yield pd.Series([None if v is None else counts.of(v) for v in values], dtype=object)

    return counted(text)


def script_score(text: Column, script: str = JAPANESE, implausible: str = PLAUSIBLE) -> Column:
    """How much text looks like the script, 0 to 1: plausible characters and those of the script; mostly digits count as plausible."""
    counts = character_counts(F.trim(text), implausible, f"[{script}]", "[0-9０-９]")
    n, digits = counts[0], counts[3]
    valid, own = (n - counts[1]) / n, counts[2] / n
    mixed = F.least(F.lit(1.0), valid * 0.6 + F.least(own * 2, F.lit(1.0)) * 0.4)
    return F.when(text.isNull(), None).when(n == 0, 1.0).otherwise(F.round(F.when(digits >= n * 0.6, valid).otherwise(mixed), 3))


def proofread(text: Column, pairs: Column, one_line: bool = True, compose: bool = True) -> Column:
    """The whole repair: marks, context, katakana runs, units, words. An empty result gives the text back."""
    t = nfkc(text) if one_line and compose else text
    out = replace_words(fix_units(fix_katakana_runs(fix_in_context(strip_noise(t)))), pairs)
    return F.when(out == "", text).otherwise(out)


KATAKANA_LETTERS = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA_LETTERS = "".join(map(chr, range(0x3041, 0x3097)))


def to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA_LETTERS, HIRAGANA_LETTERS)


def restore_point(text: Column, low: float, high: float) -> Column:
    """Put back a decimal point that was not read, if only so the number falls into its range."""
    t = F.trim(text)
    moved = F.regexp_replace(t, r"^(\d+)(\d)$", "$1.$2")
    odd = t.rlike(r"^\d{2,}$") & ~t.try_cast("double").between(low, high)
    return F.when(odd & moved.try_cast("double").between(low, high), moved).otherwise(t)


# How a corporation's name begins and ends.
CORPORATION = r"^(?:社会|特定)?医療法人\s*(?:社団法人|財団法人|社団|財団)?\s*(?:[^\s]{1,12}?(?:会館|協会|会))?\s+"


def strip_corporation(text: Column) -> Column:
    """Drop a corporation's name before a facility's, where white space parts them and three characters stay."""
    t = F.trim(text)
    rest = F.trim(F.regexp_replace(t, CORPORATION, ""))
    return F.when(t.rlike(CORPORATION) & (F.length(rest) >= 3), rest).otherwise(t)


# Character sets of fields.
CHARSETS = {"digits": "0-9", "decimal": "0-9.", "date_digits": "0-9年月日頃 ", "wareki": "0-9年月日頃明治大正昭和平成令和 ", "kana": "ぁ-ゖァ-ヶー゛゜・ 　"}


def phone(text: Column) -> Column:
    """Groups of digits joined by hyphens."""
    return F.array_join(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), "-")


def postal(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4))).otherwise(digits)


def keep_charset(text: Column, name: str) -> Column:
    """Only a field's characters; blanks are squeezed except in kana."""
    if name == "phone":
        return phone(text)
    if name == "postal":
        return postal(text)
    if name not in CHARSETS:
        return text
    kept = F.regexp_replace(text, f"[^{CHARSETS[name]}\\n]", "")
    return trim_space(kept) if name == "kana" else F.trim(F.regexp_replace(kept, r"[\s　]+", " "))


def join_japanese(text: Column) -> Column:
    """Drop blanks between two Japanese characters."""
    return F.regexp_replace(text, f"(?<=[{JAPANESE}])[ 　]+(?=[{JAPANESE}])", "")


def words_in_row(text: Column) -> Column:
    """Readable words between tick boxes: 2 to 14 characters, no broken Latin, at least 70 % Japanese."""
    parts = F.transform(F.split(text, "[□■☐▢口]"), lambda p: F.regexp_replace(p, r"[\s　:：・.,、。()（）\[\]【】「」]+", ""))

    def readable(w: Column) -> Column:
        own = F.length(F.regexp_replace(w, "[^ぁ-んァ-ヶ一-龥ーＡ-Ｚａ-ｚ０-９]", ""))
        return F.length(w).between(2, 14) & ~w.rlike(r"[A-Za-z+*/=<>~^|#$%&@\\]") & (own >= F.length(w) * 0.7)

    return F.filter(parts, readable)


def strip_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def clean_answer(text: Column) -> Column:
    """A model's answer: per line the longest quoted span or the line without its lead-in; words for nothing are empty."""

    def line(x: Column) -> Column:
        quoted = F.array_sort(F.regexp_extract_all(x, F.lit("[「『\"“]([^」』\"”]+)[」』\"”]"), F.lit(1)), lambda a, b: F.length(b) - F.length(a))
        bare = F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:答え|回答|読み取り結果|出力|結果)\s*[:：]\s*", ""), "[\"'「」『』“”]", ""))
        out = F.coalesce(F.get(quoted, F.lit(0)), bare)
        return F.when(out.rlike("^(?:なし|無し|空欄|記入なし|N/A|None)$"), "").otherwise(out)

    return F.array_join(F.filter(F.transform(F.split(text, "\n"), line), lambda x: x != ""), "\n")


# Marks that may be left at the ends of a reading.
LEAD = "｜|:：;；,，、。・･_＿=＝~〜/／\\＊*+＋\"'`^>＞→ー―—–-"
TAIL = "｜|:：;；,，_＿=＝~〜/／\\＊*+＋\"'`^>＞→"
PAIRS = dict(zip("（(「『［[｛{", "）)」』］]｝}"))
SIGNS = "+＋-ー―—–"
NOTHING = "（）()「」『』［］[]｛｝{}:：;；,，、。・･_＿=＝~〜/／\\|｜＊*+＋\"'`^ 　>＞<＜→←"
_SPACE = re.compile(f"^{SPACE}+|{SPACE}+$")


def trimmed_edges(text: str) -> str:
    """A reading without stray marks at its ends: brackets only where unbalanced, signs before digits stay."""
    whole = out = _SPACE.sub("", text)
    opens = {c: o for o, c in PAIRS.items()}

    def stray(ch: str, others: str) -> bool:
        if ch in PAIRS:
            return out.count(ch) > out.count(PAIRS[ch])
        if ch in opens:
            return out.count(ch) > out.count(opens[ch])
        return ch in others

    while out and not (out[0] in SIGNS and re.match(r"[\d.]", out[1:2])) and stray(out[0], LEAD):
        out = _SPACE.sub("", out[1:])
    while out and stray(out[-1], TAIL):
        out = _SPACE.sub("", out[:-1])
    if (out or whole) and set(out or whole) <= set(NOTHING):
        return ""
    return out or whole


@F.pandas_udf(StringType())
def trim_edges(values: pd.Series) -> pd.Series:
    return values.map(trimmed_edges, na_action="ignore")


def masked_shape(text: Column) -> Column:
    """A value's length in place of the value."""
    return F.concat(F.lit("（"), F.length(text).cast("string"), F.lit("文字）"))


def scrub_names(text: Column) -> Column:
    """Hide file names in messages."""
    return F.regexp_replace(text, r"[^\s/\\:]+\.(?i:pdf|png|jpe?g|tiff?|bmp)", "（ファイル名）")


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\r?\n", "<br>")


def short_label(label: Column, title: Column) -> Column:
    """A label without its group's title in front."""
    rest = F.regexp_replace(F.substring(label, F.length(title) + 1, F.length(label)), r"^[\s　:：・（(]+|[)）]+$", "")
    return F.when(F.startswith(label, title) & (rest != ""), rest).otherwise(label)


def valid_token(token: Column) -> Column:
    return token.rlike("^[0-9a-f]{8,64}$")


def strip_tags(html: Column) -> Column:
    """Text of HTML: no scripts or styles, tags to blanks, blanks squeezed."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def add_note(notes: Column, note: Column | str) -> Column:
    """A note joined to others unless it is there."""
    new = F.lit(note) if isinstance(note, str) else note
    return F.array_join(F.array_union(F.filter(F.split(F.coalesce(notes, F.lit("")), "／"), lambda x: x != ""), F.array(new)), "／")


def char_accuracy(truth: Column, read: Column) -> Column:
    """1 - edits / length of the truth, at least 0; an empty truth is right only if nothing was read. White space is ignored."""
    t, r = (F.regexp_replace(c, r"[\s　]+", "") for c in (truth, read))
    n = F.length(t)
    return F.when(n == 0, F.when(F.length(r) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(t, r) / n))


def bounded_edit(before: Column, after: Column) -> Column:
    """Whether a proposed repair is small and safe: length, edits, digits and Latin words nearly or wholly kept."""
    n = F.greatest(F.length(before), F.lit(1))
    digits = [F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)) for c in (before, after)]
    latin = [F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1)) for c in (before, after)]
    near = F.abs(F.length(after) - F.length(before)) <= F.greatest(F.lit(2.0), n * 0.25)
    return near & (F.levenshtein(before, after) / F.greatest(n, F.length(after)) <= 0.25) & (digits[0] == digits[1]) & (F.size(F.array_except(latin[1], latin[0])) == 0)


def char_overlap(a: Column, b: Column) -> Column:
    """Share of the first's distinct characters that the second has."""
    left, right = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(left), F.lit(1))


def names_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))
