"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

At most ``sample_rows`` labelled texts, a quarter of them toxic, are the
examples. Every term of theirs is indexed with the weight (1 + log tf) * idf *
association, the squared phi coefficient of the term's presence and the label
among the examples (``association=False`` leaves it out): without it, most of a
cosine comes from the many words that say nothing of toxicity. Each term's
postings lie in blocks of BLOCK examples with the block's largest impact. A
query adds up, block by block, the most that its terms can give, visits the most
promising blocks and then those that can still beat the k-th best, so the k
nearest are exact. Votes are weighted by similarity, against a constant for
no evidence, and calibrated by leaving each example out once; the nearest
examples of the winning side are the evidence.

Scoring runs over whole texts and nothing shuffles.
Defined results: a null text is empty; a text without any term of the examples
scores 0; rows that repeat get equal scores; similarity ties go to the earlier
example; of examples with one id the first text in order counts, of equal ones
that with the smallest id; without toxic examples every score is 0; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .quality import THRESHOLD, labelled_sample, labelled_texts

SAMPLE_ROWS = 2400
BLOCK = 128
#: Blocks that a query visits at a time: a few first, then all that the best of these leave open.
FIRST_BLOCKS = 3
NEIGHBOURS = 15
NO_EVIDENCE = 0.5

words = re.compile(r"[^\W\d_]+").findall


def term_counts(text: str | None) -> Counter:
    return Counter(words((text or "").lower()))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one after the other."""
    lengths = ends - starts
    return np.repeat(ends - lengths.cumsum(), lengths) + np.arange(lengths.sum())


@dataclass
class Index:
    """Block-max inverted index over unit vectors of the examples.

    Term t owns the entries first[t]:first[t + 1], one a block that holds it;
    entry e has its block, the largest impact, and postings begin[e]:begin[e + 1].
    """

    terms: dict[str, int]
    weights: np.ndarray
    first: np.ndarray
    block: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    impact: np.ndarray
    ids: list
    toxic: np.ndarray
    cut: float = 0.5

    @classmethod
    def build(cls, ids: list, counts: list[Counter], labels: list[int], association: bool = True) -> Index:
        names, weights = term_weights(counts, labels, association)
        terms = {t: i for i, t in enumerate(names)}
        vectors = [unit_vector(c, terms, weights) for c in counts]
        # Alike examples in one block make its bounds sharp.
        order = sorted(range(len(ids)), key=lambda i: (labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else -1, i))
        rows, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([vectors[i][0] for i in order], [np.full(len(vectors[i][0]), k) for k, i in enumerate(order)]))
        impact = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        by_term = np.lexsort((place, rows))
        rows, place, impact = rows[by_term], place[by_term], impact[by_term]
        opens = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(place // BLOCK, prepend=-1) != 0))
        most = np.maximum.reduceat(impact, opens) if len(opens) else np.zeros(0)
        first = np.searchsorted(rows[opens], np.arange(len(names) + 1))
        return cls(terms, weights, first, (place[opens] // BLOCK).astype(np.int32), most, np.append(opens, len(rows)), place.astype(np.int32), impact, [ids[i] for i in order], np.array([labels[i] for i in order], bool))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        return unit_vector(counts, self.terms, self.weights)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine over 0, best first; ``without`` leaves out a place."""
        rows, weights = vector
        entries = ranges(self.first[rows], self.first[rows + 1])
        weight, block = np.repeat(weights, self.first[rows + 1] - self.first[rows]), self.block[entries]
        bound = np.bincount(block, weights=weight * self.most[entries], minlength=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for at, end in ((0, FIRST_BLOCKS), (FIRST_BLOCKS, len(order))):
            wave = order[at:end]
            if len(best) == k:
                wave = wave[bound[wave] >= best[-1] - 1e-9]
            if not len(wave):
                break
            visited = np.zeros(len(bound), bool)
            visited[wave] = True
            use = visited[block]
            starts, ends = self.begin[entries[use]], self.begin[entries[use] + 1]
            posting = ranges(starts, ends)
            got = np.bincount(self.place[posting], weights=np.repeat(weight[use], ends - starts) * self.impact[posting])
            if 0 <= without < len(got):
                got[without] = 0
            met = np.flatnonzero(got > 0)
            if len(met) > k:
                met = met[got[met] >= np.partition(got[met], len(met) - k)[len(met) - k] - 1e-9]
            best_at, best = np.append(best_at, met), np.append(best, got[met])
            keep = np.lexsort((best_at, -np.round(best, 12)))[:k]
            best_at, best = best_at[keep], best[keep]
        return best_at, best

    def raw(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines**2
        return float(weight[self.toxic[places]].sum() / (weight.sum() + NO_EVIDENCE))

    def calibrate(self, counts: list[Counter]) -> None:
        """Set the raw vote that separates the examples (in order of places) best, each judged by the others and without the words that only it has."""
        seen = Counter(t for c in counts for t in c)
        known = [Counter({t: n for t, n in c.items() if seen[t] > 1}) for c in counts]
        raw = np.array([self.raw(*self.nearest(self.vector(c), without=p)) for p, c in enumerate(known)])
        if len(raw) and self.toxic.any() and not self.toxic.all():
            y = self.toxic
            edges = np.unique(np.append(raw, [0.1, 0.9]))
            tries = (edges[1:] + edges[:-1]) / 2
            caught, passed = np.sort(raw[y]), np.sort(raw[~y])
            wrong = np.searchsorted(caught, tries) / len(caught) + 1 - np.searchsorted(passed, tries) / len(passed)
            best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
            widest = best[np.argmax((edges[1:] - edges[:-1])[best])]
            self.cut = float(np.clip(tries[widest], 0.1, 0.9))

    def score(self, raw: float) -> float:
        """A raw vote on a scale where THRESHOLD is the separating vote."""
        return THRESHOLD * raw / self.cut if raw < self.cut else min(1.0, THRESHOLD + (1 - THRESHOLD) * (raw - self.cut) / (1 - self.cut))

    def judge(self, text: str | None, evidence: int = 3) -> tuple[float, list]:
        places, cosines = self.nearest(self.vector(term_counts(text)))
        score = self.score(self.raw(places, cosines))
        side = self.toxic[places] == (score >= THRESHOLD)
        return score, [self.ids[p] for p in places[side][:evidence].tolist()]


def term_weights(counts: list[Counter], labels: list[int], association: bool = True) -> tuple[list[str], np.ndarray]:
    """All terms in order, and idf times the squared phi coefficient of presence and label."""
    y = np.asarray(labels, bool)
    n, n1 = len(y), int(y.sum())
    seen = Counter(t for c in counts for t in c)
    toxic = Counter(t for c, label in zip(counts, labels) if label for t in c)
    names = sorted(seen)
    d, a = np.array([seen[t] for t in names], float), np.array([toxic[t] for t in names], float)
    idf = np.log(1 + n / np.maximum(d, 1))
    if not association or not 0 < n1 < n:
        return names, idf
    return names, idf * (n * a - d * n1) ** 2 / np.maximum(d * (n - d) * n1 * (n - n1), 1)


def unit_vector(counts: Counter, terms: dict[str, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order and weights (1 + log count) * weight of a text's terms that the examples have, of length 1."""
    known = counts.keys() & terms.keys()
    rows, n = (np.fromiter(map(of.__getitem__, known), np.int64, len(known)) for of in (terms, counts))
    order = np.argsort(rows)
    rows, n = rows[order], n[order]
    values = (1 + np.log(n)) * weights[rows]
    length = np.sqrt((values**2).sum())
    return (rows[values > 0], values[values > 0] / length) if length else (rows[:0], values[:0])


def fit(df: DataFrame, labels: DataFrame, column: str = "toxic", out_of: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS, association: bool = True) -> Index:
    """Index the sampled labelled rows of ``df``: at most ``sample_rows`` texts of SAMPLE_BYTES come to the driver, as term counts."""
    small_batches(df.sparkSession)
    texts = labelled_texts(df, labelled_sample(labels, column, out_of, held, (sample_rows - sample_rows // 4, sample_rows // 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(term_counts(t).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([" ".join(t for t, _ in c) for c in found], pa.string()), pa.array([np.array([n for _, n in c], "<u4").tobytes() for c in found], pa.binary())], ["doc_id", "label", "terms", "counts"])

    # Equal texts would vote many times over: one row of each.
    kind = dict(texts.dtypes)["doc_id"]
    held_rows = texts.mapInArrow(run, f"doc_id {kind}, label int, terms string, counts binary").groupBy("terms", "counts").agg(F.min(F.struct("doc_id", "label")).alias("of"))
    rows = sorted(held_rows.select("of.doc_id", "of.label", "terms", "counts").collect(), key=lambda r: r[0])
    names: dict[str, str] = {}
    counts = [Counter(dict(zip((names.setdefault(t, t) for t in r[2].split()), np.frombuffer(r[3], "<u4").tolist()))) for r in rows]
    index = Index.build([r[0] for r in rows], counts, [r[1] for r in rows], association)
    of = {r[0]: c for r, c in zip(rows, counts)}
    index.calibrate([of[i] for i in index.ids])
    return index


def scores(df: DataFrame, index: Index, out_of: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples that agree, as text) of every row."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([[str(i) for i in f[1]] for f in found], pa.list_(pa.string()))], ["doc_id", "score", "evidence"])

    kind = dict(df.dtypes)["doc_id"]
    scored = df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<string>")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % out_of, F.lit(-1))
    return scored.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_civil(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows not predicted to be toxic, with all their columns; only the texts pass through Python."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.judge(t)[0] for t in texts], dtype="float64")

    return df.filter(score("text") < THRESHOLD)
