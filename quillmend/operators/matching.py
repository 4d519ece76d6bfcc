"""Matching readings to lexicons and directories.

A lexicon travels as rows that each hold an array of at most BLOCK_TERMS terms,
so that a reading is scored in place and only its best terms become rows; the
best of all blocks are ranked again, so the number of blocks never changes a
result. Readings are made distinct first.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmend.functions import similarity as S

#: Terms of one broadcast row. Larger lexicons take several, one after the other.
BLOCK_TERMS = 20_000
#: Rows of a small side that may be broadcast; beyond it the join is left to the planner.
SMALL_ROWS = 100_000


def small(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The side with a broadcast hint, if a count shows it to be small."""
    return F.broadcast(side) if side.count() <= rows else side


def packed(terms: DataFrame, columns: list[str], per_block: int) -> list[DataFrame]:
    """Tables of one row with an array ``items`` of at most so many of the terms each, give or take a hash's unevenness."""
    n = max(1, -(-terms.count() // per_block))
    item = F.array_sort(F.collect_list(F.struct(*columns))).alias("items")
    if n == 1:
        return [terms.agg(item)]
    dealt = terms.withColumn("__block", F.pmod(F.xxhash64(*columns), F.lit(n)))
    return [dealt.filter(F.col("__block") == i).agg(item) for i in range(n)]


def top_terms(values: DataFrame, form: str, lexicon: DataFrame, term: str = "term", term_form: str = "form", k: int = 8, least: float = S.SUGGEST, groups: dict[str, str] | None = None, priority: str | None = None, per_block: int = BLOCK_TERMS) -> DataFrame:
    """The k most similar terms of each distinct value: form, rank, term, term_form, score.

    Ordered by score, then the longer form, then priority (true first), then the term.
    """
    first = (~F.coalesce(F.col(priority).cast("boolean"), F.lit(False))).cast("int") if priority else F.lit(0)
    terms = lexicon.select(F.col(term).alias("term"), F.col(term_form).alias("form"), first.alias("first"))
    distinct = values.select(F.col(form).alias("value")).filter("value is not null and value <> ''").distinct()

    def scored(e: Column) -> Column:
        score = S.similarity(F.col("value"), e["form"], groups)
        return F.struct((-score).alias("order"), (-F.length(e["form"])).alias("longer"), e["first"].alias("first"), e["term"].alias("term"), e["form"].alias("term_form"))

    ranked = F.array_sort(F.filter(F.transform("items", scored), lambda s: s["order"] <= -least))
    blocks = packed(terms, ["term", "form", "first"], per_block)
    best = reduce(DataFrame.unionByName, [distinct.join(F.broadcast(one)).select("value", F.explode(F.slice(ranked, 1, k)).alias("m")) for one in blocks])
    if len(blocks) > 1:
        best = best.groupBy("value").agg(F.slice(F.array_sort(F.collect_list("m")), 1, k).alias("m")).select("value", F.posexplode("m").alias("at", "m"))
    else:
        best = distinct.join(F.broadcast(blocks[0])).select("value", F.posexplode(F.slice(ranked, 1, k)).alias("at", "m"))
    return best.select(F.col("value").alias(form), (F.col("at") + 1).alias("rank"), F.col("m.term").alias("term"), F.col("m.term_form").alias("term_form"), (-F.col("m.order")).alias("score"))


def decide(readings: DataFrame, text: str, form: str, confidence: str, hits: DataFrame, adopt: float = S.ADOPT) -> DataFrame:
    """Add adopted and adopted_confidence to readings, given their top_terms.

    An exact term wins; a term that would drop meaning is not taken; from
    ``adopt`` on the best term is; the rest keeps its text with less confidence.
    """
    exact = hits.filter(F.col(form) == F.col("term_form")).groupBy(form).agg(F.min_by("term", "rank").alias("exact"))
    best = hits.filter("rank = 1").select(form, F.col("term").alias("best"), F.col("term_form").alias("best_form"), "score")
    joined = readings.join(best, form, "left").join(exact, form, "left")
    c = F.col(confidence)
    shorter = S.is_shortening(F.col(form), F.col("best_form"))
    takes = F.col("score") >= adopt
    value = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("best").isNull() | shorter | ~takes, F.col(text)).otherwise(F.col("best"))
    sure = F.when(F.col("exact").isNotNull(), F.least(F.lit(1.0), c + 0.20)).when(F.col("best").isNull(), c * 0.7).when(shorter | ~takes, c * 0.75).otherwise(F.least(F.lit(0.95), c * 0.5 + F.col("score") * 0.5))
    return joined.withColumn("adopted", value).withColumn("adopted_confidence", F.round(sure, 3)).drop("exact", "best", "best_form", "score")


def nearest_code(hits: DataFrame, form: str, codes: DataFrame, term: str = "term", code: str = "code", floor: float = S.CODE_FLOOR) -> DataFrame:
    """The code of each value's best term, if near enough and coded: form, code, score, exact."""
    best = hits.filter((F.col("rank") == 1) & (F.col("score") >= floor))
    return best.join(codes.select(F.col(term).alias("term"), F.col(code).alias("code")), "term").filter("code <> ''").select(form, "term", "code", "score", (F.col(form) == F.col("term_form")).alias("exact"))


# Qualifiers that stand before and after a name.
BEFORE = ["右", "左", "両", "同"]
AFTER = ["術後", "後遺症", "の疑い", "疑い", "増悪", "再発", "の既往", "既往"]


def standard_name(reading: Column, name: Column, before: list[str] = BEFORE, after: list[str] = AFTER, cover: float = 0.75) -> Column:
    """The standard name with the reading's qualifiers put back; the reading where the name is much shorter than its core."""
    r, n = F.trim(reading), F.trim(name)
    pre = F.coalesce(*(F.when(F.startswith(r, F.lit(q)), q) for q in before), F.lit("")) if before else F.lit("")
    post = F.coalesce(*(F.when(F.endswith(r, F.lit(q)), q) for q in after), F.lit("")) if after else F.lit("")
    core = F.length(r) - F.length(pre) - F.length(post)
    led = F.when((pre != "") & ~F.startswith(n, pre), F.concat(pre, n)).otherwise(n)
    out = F.when((post != "") & ~F.endswith(led, post), F.concat(led, post)).otherwise(led)
    return F.when((n == "") | ((core > 0) & (F.length(n) < core * cover)), r).otherwise(out)


def suggest(lexicon: DataFrame, term: str, form: str, ordinal: str, queries: DataFrame, query: str, k: int = 8, least: float = 0.45) -> DataFrame:
    """Completions of each query: terms that begin with it, then those that contain it, in lexicon order, then similar ones, best first.

    ``least`` of 1 or more leaves the similar ones out. The queries are the small side; the lexicon is read where it lies.
    """
    begins, holds = F.startswith(F.col(form), F.col(query)), F.contains(F.col(form), F.col(query))
    score = F.when(holds, 1.0).otherwise(S.similarity(F.col(query), F.col(form))) if least < 1 else holds.cast("double")
    hits = lexicon.join(small(queries), holds if least >= 1 else F.lit(True)).withColumn("score", score).filter(holds | (F.col("score") >= least))
    kind = F.when(begins, 0).when(holds, 1).otherwise(2)
    order = W.partitionBy(query).orderBy("kind", F.when(F.col("kind") < 2, 0.0).otherwise(-F.col("score")), ordinal)
    return hits.withColumn("kind", kind).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query, "rank", "kind", F.col(term).alias("suggestion"))


def character_masks(phrase: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(phrase):
        out[c] = out.get(c, 0) | 1 << i
    return out


def near_stretch(masks: dict[str, int], m: int, line: str, most: float) -> bool:
    """Whether some stretch of the line is at most so many edits from the phrase of m characters.

    A column of the edit table is held as the bits of its steps up and down, and all its cells move on at once.
    """
    if m <= most:
        return True
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, edits = full, 0, m
    for c in line:
        same = masks.get(c, 0)
        flat = ((same & up) + up ^ up) | same
        rise, fall = down | full & ~(flat | up), up & flat
        edits += bool(rise & top) - bool(fall & top)
        if edits <= most:
            return True
        keep = same | down
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | full & ~(keep | rise), rise & keep
    return False


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some spans, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


class NearPhrases:
    """Phrases by their bigrams and pieces, to tell which of them a line may be alike.

    Two strings are alike by the share of distinct bigrams, which is counted in bits, or by
    few edits. An edit spoils one of a phrase's pieces at most, and the others stand in the line
    at places that are shifted alike but for so many edits; so enough pieces must be met
    within a stretch of shifts. Phrases too short for that must have so many of their bigrams,
    repeats included, in the line, since an edit changes two of them at most. What is left is
    held against the nearest stretch of the line. No test misses a pair.
    """

    PIECE, FINER = 4, 3  # the second size for phrases that the first leaves
    FEW = 4  # doubtful phrases that take less time one by one than all at once

    def __init__(self, phrases: list[str], alike: float, length_ratio: float):
        self.alike, self.length_ratio = alike - 1e-4, length_ratio  # likeness is rounded to four places
        self.order = np.array(sorted(range(len(phrases)), key=lambda i: len(phrases[i])), np.int64)
        self.phrases = [phrases[i] for i in self.order.tolist()]
        self.lengths = m = np.array([len(p) for p in self.phrases], np.int64)
        self.most = (1 - self.alike) * (m + 2)
        self.edits = np.floor(self.most).astype(np.int64)
        self.needed = m // self.PIECE - self.edits
        codes = [code_points(p) for p in self.phrases]
        self.letters = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        grams = [np.unique(c[:-1] << 21 | c[1:]) for c in codes]
        self.distinct, self.grams = np.array([len(g) for g in grams], np.int64), np.unique(np.concatenate([np.zeros(0, np.int64), *grams]))
        self.bits = np.array([self._bits(g) for g in grams], np.uint64).reshape(len(grams), -(-max(1, len(self.grams)) // 64))
        self._cut(codes)
        self.short = np.flatnonzero(self.needed < 1)
        self.where = self._postings([self._numbered(self.phrases[i]) for i in self.short.tolist()])

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        """A bit for each of the phrases' bigrams, set for some of them."""
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        held = np.zeros(-(-max(1, len(self.grams)) // 64) * 64, bool)
        held[at[known][self.grams[at[known]] == grams[known]]] = True
        return np.packbits(held).view(np.uint64)

    def _pieces(self, codes: np.ndarray, size: int) -> np.ndarray:
        """A number for each stretch of a size; equal stretches have equal ones, and characters of no phrase count as one."""
        at = np.searchsorted(self.letters, codes)
        at[at == len(self.letters)] = 0
        ids = np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else codes * 0
        out = ids[: max(0, len(ids) - size + 1)] * 0
        for k in range(size if len(out) else 0):
            out = out * (len(self.letters) + 1) + ids[k : k + len(out)]
        return out

    def _cut(self, codes: list[np.ndarray]) -> None:
        """Pieces of the phrases one beside the other, by their numbers and then by phrase."""
        finer = [self._pieces(c, self.FINER)[:: self.FINER] for c in codes]
        self.finer, self.finer_n = np.concatenate([np.zeros(0, np.int64), *finer]), np.array([len(f) for f in finer], np.int64)
        made = [self._pieces(c, self.PIECE)[:: self.PIECE] for c in codes]
        sizes = np.where(self.needed >= 1, np.array([len(p) for p in made], np.int64), 0)
        numbers = np.concatenate([np.zeros(0, np.int64), *(p for p, n in zip(made, sizes) if n)])
        owner, place = np.repeat(np.arange(len(made)), sizes), spans(np.zeros(len(made), np.int64), sizes) * self.PIECE
        self.numbers, group = np.unique(numbers, return_inverse=True)
        key = group * len(made) + owner
        order = np.argsort(key, kind="stable")
        self.keys, self.owner, self.place = key[order], owner[order], place[order]
        self.lanes = np.array([-(-len(c) // 64) for c in codes], np.int64)
        self.lane = np.full((int(self.lanes.sum()), 64), -1, np.int32)
        self.lane_size = np.zeros(len(self.lane), np.int64)
        for at, c in zip(np.cumsum(self.lanes) - self.lanes, codes):
            for k in range(0, len(c), 64):
                part = c[k : k + 64]
                self.lane[at + k // 64, : len(part)], self.lane_size[at + k // 64] = part, len(part)

    @staticmethod
    def _numbered(text: str) -> set[str]:
        """Bigrams numbered by occurrence."""
        seen: dict[str, int] = {}
        numbered = set()
        for pair in map(operator.add, text, text[1:]):
            seen[pair] = seen.get(pair, 0) + 1
            numbered.add(f"{pair}{seen[pair]}")
        return numbered

    @staticmethod
    def _postings(grams: list[set[str]]) -> dict[str, np.ndarray]:
        out: dict[str, list[int]] = {}
        for i, held in enumerate(grams):
            for g in held:
                out.setdefault(g, []).append(i)
        return {g: np.array(at) for g, at in out.items()}

    def _by_pieces(self, codes: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which of some phrases have enough pieces in the line within a stretch of shifts."""
        numbers = self._pieces(codes, self.PIECE)
        at = np.searchsorted(self.numbers, numbers)
        at[at == len(self.numbers)] = 0
        here = np.flatnonzero(self.numbers[at] == numbers) if len(self.numbers) else np.zeros(0, np.int64)
        first, last = (np.searchsorted(self.keys, at[here] * len(self.lengths) + end) for end in (low, high))
        met = spans(first, last - first)
        owner = self.owner[met]
        counts = self._most_shifted_alike(owner, owner - low, np.repeat(here, last - first) - self.place[met], high - low)
        left = np.flatnonzero((counts >= self.needed[low:high]) & (self.needed[low:high] >= 1))
        # The rest have to pass with finer pieces, which are looked up in the line.
        numbers = self._pieces(codes, self.FINER)
        order = np.argsort(numbers, kind="stable")
        sizes, begin = self.finer_n[low + left], (np.cumsum(self.finer_n) - self.finer_n)[low + left]
        first, last = (np.searchsorted(numbers[order], self.finer[spans(begin, sizes)], side) for side in ("left", "right"))
        rank = np.repeat(np.repeat(np.arange(len(left)), sizes), last - first)
        place = np.repeat(spans(begin * 0, sizes) * self.FINER, last - first)
        counts = self._most_shifted_alike(low + left[rank], rank, order[spans(first, last - first)] - place, len(left))
        out = np.zeros(high - low, bool)
        out[left[counts >= self.lengths[low + left] // self.FINER - self.edits[low + left]]] = True
        return out

    def _fewest_edits(self, codes: np.ndarray, some: np.ndarray) -> np.ndarray:
        """No more than the edits of some phrases from any stretch of the line: the sum, over their runs of 64 characters, of the fewest of each. As in ``near_stretch``, for all runs at once."""
        at = spans((np.cumsum(self.lanes) - self.lanes)[some], self.lanes[some])
        runs, size, one = self.lane[at], self.lane_size[at], np.uint64(1)
        letters, line = np.unique(codes, return_inverse=True)
        masks = [np.packbits(runs == c, axis=1, bitorder="little").view("<u8")[:, 0] for c in letters]
        top = (size - 1).astype(np.uint64)
        up, down = np.full(len(runs), ~np.uint64(0)), np.zeros(len(runs), np.uint64)
        edits, fewest = size.copy(), size.copy()
        for c in line.tolist():
            same = masks[c]
            flat = (((same & up) + up) ^ up) | same | down
            rise, fall = down | ~(flat | up), up & flat
            edits += ((rise >> top) & one).view(np.int64)
            edits -= ((fall >> top) & one).view(np.int64)
            np.minimum(fewest, edits, out=fewest)
            rise, fall = rise << one, fall << one
            up, down = fall | ~(flat | rise), rise & flat
        return np.bincount(np.repeat(np.arange(len(some)), self.lanes[some]), fewest, len(some))

    def _most_shifted_alike(self, owner: np.ndarray, rank: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        """For each of n phrases, by rank, how many of its pieces' shifts lie in two neighbouring stretches of the edits' width at most."""
        stretch = (shift + self.lengths[owner]) // (self.edits[owner] + 1)
        width = int(stretch.max(initial=0)) + 2
        counts = np.bincount(rank * width + stretch, minlength=n * width).reshape(n, width)
        return (counts[:, :-1] + counts[:, 1:]).max(axis=1)

    def candidates(self, line: str) -> np.ndarray:
        """Places of the phrases of about the line's length that it may be alike."""
        n, codes = len(line), code_points(line)
        low, high = np.searchsorted(self.lengths, [n * self.length_ratio - 1e-6, n / self.length_ratio + 1e-6], "left")
        if low == high:
            return self.order[:0]
        grams = np.unique(codes[:-1] << 21 | codes[1:])
        shared = np.bitwise_count(self.bits[low:high] & self._bits(grams)).sum(axis=1, dtype=np.int64)
        by_share = 2 * shared >= self.alike * (len(grams) + self.distinct[low:high])
        by_edits = self._by_pieces(codes, low, high)
        some = slice(*np.searchsorted(self.short, [low, high]))
        if some.start < some.stop:
            held = np.bincount(np.concatenate([np.zeros(0, np.int64), *(self.where[g] for g in self._numbered(line) & self.where.keys())]).astype(np.int64), minlength=len(self.short))[some]
            short = self.short[some]
            by_edits[short - low] = held >= self.lengths[short] - 1 - 2 * self.most[short]
        doubtful, found = np.flatnonzero(by_edits & ~by_share), by_share | by_edits
        near = self._fewest_edits(codes, low + doubtful) <= self.most[low + doubtful] if len(doubtful) > self.FEW else doubtful >= 0
        found[doubtful[~near]] = False
        found[[i for i in doubtful[near].tolist() if not near_stretch(character_masks(self.phrases[low + i]), int(self.lengths[low + i]), line, self.most[low + i])]] = False
        return np.sort(self.order[low:high][found])


#: The phrases that this worker used last, and what was made of them: tasks of one table follow each other.
_LAST: list[tuple[list[str], tuple[float, float], NearPhrases]] = []


def near_phrases(phrases: list[str], alike: float, length_ratio: float) -> NearPhrases:
    if not _LAST or _LAST[0][0] is not phrases or _LAST[0][1] != (alike, length_ratio):
        _LAST[:] = [(phrases, (alike, length_ratio), NearPhrases(phrases, alike, length_ratio))]
    return _LAST[0][2]


# A proposal's likeness to an offered term, its characters' overlap with the reading, and the shortest reading.
PROPOSED_ALIKE, PROPOSED_OVERLAP, SHORTEST_ASKED = 0.9, 0.34, 3


def gated_proposal(reading: Column, proposal: Column, offered: Column) -> Column:
    """The offered term that a model's proposal stands for, null if it is none or has too little of the reading. All are match forms.

    The first that is equal or much alike counts; a reading that is too short is not worth asking about.
    """
    same = F.get(F.filter(offered, lambda o: (o == proposal) | (S.similarity(o, proposal) >= PROPOSED_ALIKE)), F.lit(0))
    letters = [F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")) for c in (reading, same)]
    overlap = F.try_divide(F.size(F.array_intersect(*letters)), F.least(F.size(letters[0]), F.size(letters[1])))
    return F.when((F.length(reading) >= SHORTEST_ASKED) & (proposal != "") & (F.coalesce(overlap, F.lit(0.0)) >= PROPOSED_OVERLAP), same)


def drop_boilerplate(lines: DataFrame, form: str, boilerplate: DataFrame, phrase: str, alike: float = S.LINES_ALIKE, length_ratio: float = 0.70, per_block: int = BLOCK_TERMS) -> DataFrame:
    """Lines that are no near copy of a printed phrase of about their length.

    Blocks of phrases go to the workers, which name the few that a line may be alike; only for those is the likeness worked out.
    """
    context = lines.sparkSession.sparkContext
    # A line costs far more than to move it, so lines are dealt out whatever few bytes they have.
    distinct = lines.select(F.col(form).alias("line")).filter("line is not null").repartition(4 * context.defaultParallelism, "line").distinct()

    def met(one: DataFrame) -> DataFrame:
        phrases = context.broadcast([x["p"] for x in one.first()["items"] or []])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = near_phrases(phrases.value, alike, length_ratio)
            for batch in batches:
                pairs = [(t, phrases.value[i]) for t in batch.column(0).to_pylist() for i in near.candidates(t).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["line", "p"])

        return distinct.mapInArrow(run, "line string, p string")

    phrases = boilerplate.select(F.col(phrase).alias("p")).filter("p is not null").distinct()
    n, m = F.length("line"), F.length("p")
    fits = F.least(m, n) / F.greatest(m, n) >= length_ratio
    shares = F.round(S.dice(F.col("line"), F.col("p")), 4) >= alike  # enough for most, and far cheaper than the rest of the likeness
    like = F.when(F.col("line") == F.col("p"), True).when(shares, True).otherwise(S.similarity(F.col("line"), F.col("p")) >= alike)
    seen = reduce(DataFrame.unionByName, [met(one).filter(fits & like).select(F.col("line").alias(form)) for one in packed(phrases, ["p"], per_block)]).distinct()
    return lines.join(seen, form, "left_anti")


# Ends of facility names.
FACILITY_ENDS = ["病院", "医院", "クリニック", "ｸﾘﾆｯｸ", "診療所", "センター", "医療センター", "歯科", "内科", "外科", "眼科", "皮膚科", "産科", "婦人科", "整形外科", "小児科", "耳鼻咽喉科", "薬局"]
OWNERS = r"^(?:特定|社会|地方独立行政|独立行政|国立研究開発|国立大学|公立大学|学校|社会福祉|公益財団|公益社団|一般財団|一般社団|医療|宗教|農業協同組合|消費生活協同組合)?(?:法人)?(?:社団|財団)?"


def core_names(name: Column, ends: list[str] = FACILITY_ENDS, owners: str = OWNERS, least: int = 4) -> Column:
    """A directory name and its forms without an owner in front."""
    parts = F.filter(F.split(name, r"[\s　]+"), lambda p: p != "")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))
    shorter = F.filter(tails, lambda t: (F.length(t) >= least) & t.rlike("(?:" + "|".join(ends) + ")$"))
    head = F.regexp_replace(F.get(parts, F.lit(0)), owners, "")
    bare = F.concat(head, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ""))
    own = F.when((F.size(parts) > 1) & (head != "") & (head != F.get(parts, F.lit(0))) & (F.length(bare) >= least), F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(name), F.when(F.size(parts) > 1, shorter).otherwise(F.array().cast("array<string>")), own))


# Marks and digits that lead a reading.
LEADING = r"^[\s　0-9０-９.,、。・\-ー―_|｜]+"


def query_forms(text: Column, ends: list[str] = FACILITY_ENDS) -> Column:
    """A reading and, if it differs, the part up to its last facility end without leading digits and marks."""
    cut = F.regexp_extract(text, "^(.*(?:" + "|".join(ends) + "))", 1)
    bare = F.trim(F.regexp_replace(F.when(cut != "", cut).otherwise(text), LEADING, ""))
    return F.array_distinct(F.filter(F.array(text, bare), lambda x: x != ""))


def _spread(some: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Values at their places of n, 0 elsewhere."""
    out = np.zeros(n, np.uint64)
    out[some[0]] = some[1]
    return out


class DirectoryForms:
    """Match forms of directory names, to bound how alike a reading is to every one of them at once.

    Forms lie in the order of their lengths. Edits come from bit vectors, one a form, that
    all move on by a character of the reading together.
    """

    def __init__(self, forms: list[str], names: list[int], groups: dict[str, str] | None = None):
        """``names`` has for each form the place of its name."""
        order = sorted(range(len(forms)), key=lambda i: len(forms[i]))
        self.forms, self.names = [forms[i] for i in order], np.array([names[i] for i in order], np.int64)
        self.lengths = np.array([len(f) for f in self.forms], np.int64)
        self.moved = str.maketrans({c: r for c, r in groups.items() if c != r}) if groups else None
        self.masks = self._masks(self.forms)
        self.moved_masks = self._masks([f.translate(self.moved) for f in self.forms]) if self.moved is not None else None
        grams = [self._grams(f) for f in self.forms]
        self.distinct, self.where = np.array([len(g) for g in grams], np.int64), NearPhrases._postings(grams)

    @staticmethod
    def _grams(form: str) -> set[str]:
        return {form[i : i + 2] for i in range(len(form) - 1)} or {form}

    @staticmethod
    def _masks(forms: list[str]) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """For each character the bits of its places in the first 64 of every form, or only the forms that have it and theirs where these are few."""
        out: dict[str, tuple[list[int], list[int]]] = {}
        for i, form in enumerate(forms):
            for c, bits in character_masks(form[:64]).items():
                at = out.setdefault(c, ([], []))
                at[0].append(i), at[1].append(bits)
        few = {c: (np.array(i), np.array(bits, np.uint64)) for c, (i, bits) in out.items()}
        return {c: _spread(v, len(forms)) if 8 * len(v[0]) >= len(forms) else v for c, v in few.items()}

    def edits(self, reading: str, some: slice, anywhere: bool, masks: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Edits from each form to the reading, or to the nearest stretch of it; of forms beyond 64 characters no more than these."""
        lengths = self.lengths[some]
        if not len(lengths):
            return lengths
        one, size = np.uint64(1), np.minimum(lengths, 64)
        top = one << (size - 1).astype(np.uint64)
        up, down, edits = np.full(len(lengths), ~np.uint64(0)), np.zeros(len(lengths), np.uint64), size.copy()
        fewest, none = edits.copy(), np.zeros(len(self.forms), np.uint64)
        for c in reading:
            bits = masks.get(c, none)
            same = (_spread(bits, len(self.forms)) if isinstance(bits, tuple) else bits)[some]
            flat = (((same & up) + up) ^ up) | same | down
            rise, fall = down | ~(flat | up), up & flat
            edits += ((rise & top) != 0).astype(np.int64) - ((fall & top) != 0)
            np.minimum(fewest, edits, out=fewest)
            rise, fall = rise << one, fall << one
            if not anywhere:
                rise |= one
            up, down = fall | ~(flat | rise), rise & flat
        return np.where(lengths > 64, 0, fewest if anywhere else edits)

    def bounds(self, reading: str) -> tuple[slice, np.ndarray, np.ndarray]:
        """The forms that count for a reading, by length, and the least and greatest likeness to each."""
        n = len(reading)
        first, longer = (int(np.searchsorted(self.lengths, v)) for v in (max(4.0, n * 0.5), n))
        some, longer = slice(first, len(self.forms)), max(0, longer - first)
        m = self.lengths[some]
        held = self._grams(reading)
        shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *(self.where[g] for g in held & self.where.keys())]).astype(np.int64), minlength=len(self.forms))[some]
        least = 2.0 * shared / (len(held) + self.distinct[some])
        inner = self.edits(reading, slice(first, first + longer), True, self.masks)
        whole = self.edits(reading, slice(first + longer, None), False, self.masks)
        inside, exact = (inner == 0) & (m[:longer] <= 64), m[longer:] <= 64
        least[:longer] = np.where(inside, np.maximum(least[:longer], 0.55 + 0.35 * m[:longer] / n), least[:longer])
        most = least.copy()
        most[:longer] = np.maximum(least[:longer], 1 - inner / (m[:longer] + 2))
        near = 1 - whole / m[longer:]
        most[longer:] = np.maximum(least[longer:], near)
        least[longer:] = np.where(exact, most[longer:], least[longer:])
        if self.moved is not None:
            close = self.edits(reading.translate(self.moved), slice(first, None), False, self.moved_masks) <= 1
            most[close] = np.maximum(most[close], 0.9)
        return some, least, most

    def best(self, readings: list[str], names: int, k: int, least: float) -> np.ndarray:
        """Places of the names, of so many, that may be among a reading's k best of at least a likeness. Names lie in the order that settles ties."""
        low, high = np.zeros(names), np.zeros(names)
        for reading in readings:
            some, lower, upper = self.bounds(reading)
            np.maximum.at(low, self.names[some], lower)
            np.maximum.at(high, self.names[some], upper)
        bar = np.partition(low, -k)[-k] if names > k else 0.0
        left = np.flatnonzero(high >= max(bar, least) - 0.0012)  # likenesses are rounded to four places and then to three
        sure = left[low[left] == high[left]]
        order = np.lexsort((sure, -low[sure]))
        value = low[sure][order]
        begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
        rank = np.arange(len(value)) - np.repeat(begin, np.diff(np.append(begin, len(value))))
        return np.concatenate([left[low[left] != high[left]], sure[order][rank < k]])


def match_directory(readings: DataFrame, text: str, region: str, directory: DataFrame, name: str, form_of, k: int = 5, least: float = 0.55, groups: dict[str, str] | None = None, ends: list[str] = FACILITY_ENDS, owners: str = OWNERS, shortest: int = 3, per_block: int = BLOCK_TERMS, at_once: int = 1000) -> DataFrame:
    """The k best directory names of each reading in its region: text, region, rank, name, score.

    The score is the best over the reading's forms and the name's core forms of at
    least half the reading's length. ``form_of`` makes match forms of array items, so it
    must be built in (compose beforehand). About ``at_once`` readings of a region meet about
    ``per_block`` of its names at a time, which names the few that may be among the best;
    only for those is the likeness worked out.
    """
    kinds = dict(readings.dtypes)
    of_text, of_name = F.transform(query_forms(F.col(text), ends), form_of), F.transform(core_names(F.col("name"), ends, owners), form_of)
    left = readings.select(text, region).dropna().distinct().withColumn("__q", of_text)
    left = left.filter(F.array_max(F.transform("__q", F.length)) >= shortest)
    names = directory.select(F.col(region), F.col(name).alias("name")).dropna().distinct()
    blocks, pieces = (max(1, -(-(rows.groupBy(region).count().agg(F.max("count")).first()[0] or 0) // most)) for rows, most in ((names, per_block), (left, at_once)))
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    dealt = lambda c, n, to: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(to)
    here = left.select("*", dealt(text, pieces, "__p")).select("*", every(blocks, "__b"))
    there = names.select("*", of_name.alias("c"), dealt("name", blocks, "__b")).select("*", every(pieces, "__p"))
    key = [region, "__b", "__p"]

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        known = sorted(zip(block["name"].to_pylist(), block["c"].to_pylist()), key=lambda v: (len(v[0]), v[0]))
        met = [(i, f) for i, (_, forms) in enumerate(known) for f in forms or [] if f]
        near = DirectoryForms([f for _, f in met], [i for i, _ in met], groups)
        found = [near.best([q for q in qs if q], len(known), k, least) for qs in some["__q"].to_pylist()]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        return pa.Table.from_arrays([some[text].take(at), some[region].take(at), pa.array([known[i][0] for f in found for i in f.tolist()], pa.string())], [text, region, "name"])

    # The work of a key grows with the product of its rows, so keys are dealt out, whatever few bytes they have.
    deal = 16 * readings.sparkSession.sparkContext.defaultParallelism
    met = here.repartition(deal, *key).groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(run, f"`{text}` {kinds[text]}, `{region}` {kinds[region]}, name string")

    def against(q: Column) -> Column:
        fit = F.filter("c", lambda c: F.length(c) >= F.greatest(F.lit(4.0), F.length(q) * 0.5))
        return F.coalesce(F.array_max(F.transform(fit, lambda c: S.similarity(q, c, groups))), F.lit(0.0))

    scored = met.withColumn("c", of_name).withColumn("score", F.round(F.array_max(F.transform(of_text, against)), 3)).filter(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy(text, region).orderBy(F.desc("score"), F.length("name"), "name"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(text, region, "rank", "name", "score")


def backfill(entries: DataFrame, best: DataFrame, key: list[str], fields: list[str], floors: dict[str, float], adopt: float = 0.85) -> DataFrame:
    """Adopt a directory row for companion fields: where its score is enough and the field is empty or unsure, with a confidence floor.

    ``best`` has the key, score and a column ``dir_<field>`` for each field; entries have ``<field>`` and ``<field>_confidence``.
    """
    joined = entries.join(best, key, "left")
    takes = F.coalesce(F.col("score") >= adopt, F.lit(False))
    sure = {f: F.coalesce(F.col(f"{f}_confidence"), F.lit(0.0)) for f in fields}
    weak = {f: takes & F.col(f"dir_{f}").isNotNull() & ((F.coalesce(F.col(f), F.lit("")) == "") | (sure[f] < 0.5)) for f in fields}
    made = {f: F.when(weak[f], F.col(f"dir_{f}")).otherwise(F.col(f)) for f in fields}
    made |= {f"{f}_confidence": F.when(weak[f], F.greatest(sure[f], F.lit(floors[f]))).otherwise(F.col(f"{f}_confidence")) for f in fields}
    return joined.withColumns(made).select(*entries.columns)


def infer_region(texts: DataFrame, key: str, ordinal: str, form: str, regions: DataFrame, region: str, region_form: str, list_ordinal: str, suffix: int = 1) -> DataFrame:
    """The first listed region found in a record's texts: by text order, whole names before names without their suffix, then list order."""
    short = F.substring(region_form, F.lit(1), F.length(region_form) - suffix)
    both = regions.select(F.col(region).alias("region"), F.col(list_ordinal).alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("pass"), F.col(region_form).alias("f")), F.struct(F.lit(1).alias("pass"), short.alias("f")))).alias("n"))
    hits = texts.join(small(both), (F.col("n.f") != "") & F.contains(F.col(form), F.col("n.f")))
    return hits.groupBy(key).agg(F.min_by("region", F.struct(ordinal, "n.pass", "at")).alias("region"))


def unique_parent(children: DataFrame, child: str, parents: DataFrame, name: str, parent: str) -> DataFrame:
    """The only parent of a name, for names that have just one."""
    one = parents.groupBy(F.col(name).alias(child)).agg(F.min(parent).alias("parent"), F.count_distinct(parent).alias("n")).filter("n = 1").drop("n")
    return children.join(one, child, "left")


def nearest_by_margin(hits: DataFrame, form: str, least: float = 0.50, margin: float = 0.08) -> DataFrame:
    """The best term of each value if it is near enough and clearly ahead of the second."""
    ahead = F.col("score") - F.coalesce(F.lead("score").over(W.partitionBy(form).orderBy("rank")), F.lit(-1.0))
    return hits.withColumn("ahead", ahead).filter((F.col("rank") == 1) & (F.col("score") >= least) & (F.col("ahead") >= margin)).select(form, "term", "score")


def pick_from_directory(directory: DataFrame, name: str, form: str, query: str, contains_first: int = 40, enough: int = 8, k: int = 20, least: float = 0.5) -> DataFrame:
    """Names that contain a query, and when these are few, similar ones after them: name, kind, rank."""
    held = directory.filter(F.contains(F.col(form), F.lit(query))).select(name).orderBy(name).limit(contains_first).withColumn("kind", F.lit(0)).withColumn("score", F.lit(1.0))
    few = held.agg((F.count(F.lit(1)) < enough).alias("few"))
    near = directory.filter(~F.contains(F.col(form), F.lit(query))).withColumn("score", S.similarity(F.lit(query), F.col(form))).filter(F.col("score") >= least)
    near = near.join(F.broadcast(few)).filter("few").orderBy(F.desc("score"), name).limit(k).select(name, F.lit(1).alias("kind"), "score")
    order = W.orderBy("kind", F.desc("score"), name)  # at most contains_first + k rows
    return held.unionByName(near).withColumn("rank", F.row_number().over(order))
