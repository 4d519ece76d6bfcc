"""Quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words, and the words' character n-grams of 3 to 5
code points hash into one table of learned vectors; a document is their mean,
and a softmax over it gives the label. Before that, a word that repeats the one
ahead of it is written as one repeat mark, a word like any other: a mean cannot
tell repetition of words it has never learned. Vectors and output layer are trained by
plain stochastic gradient descent in numpy on at most ``sample_rows`` labelled
texts of at most ``SAMPLE_BYTES`` each, half of each label.

The output is linear in the mean, so scoring needs one number a bucket; it runs
over whole texts, a few array operations each, and nothing shuffles.
Defined results: a null text is empty; a text without words scores by the bias;
rows that repeat get equal scores; of rows with one id the first text in order
is learned from, with the larger label; without labels of both kinds every
score is 0.5; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKET_BITS = 18
GRAMS = (3, 4, 5)
DIMENSIONS = 16
SAMPLE_ROWS = 2400
SAMPLE_BYTES = 1 << 16
THRESHOLD = 0.7

MIX = np.uint64(0x9E3779B97F4A7C15)
RADIX = np.uint64(0x100000001B3)
CHUNK = 1 << 16
REPEAT = "\u27f3"


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSE = _powers(int(RADIX)), _powers(pow(int(RADIX), -1, 1 << 64))


def _bucket(codes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (codes + np.uint64(salt)) * MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, in pieces of bounded size cut between words; a word longer than a piece counts as several."""
    long = CHUNK - 2
    plain = (text or "").lower().split()
    if len(text or "") > long:
        plain = [w[i : i + long] for w in plain for i in range(0, len(w), long)]
    words = [w if w != ahead else REPEAT for ahead, w in zip([None, *plain], plain)]
    before, at = None, 0
    while at < len(words):
        size, end = len(words[at]) + 2, at + 1
        while end < len(words) and size + len(words[end]) + 1 <= CHUNK:
            size += len(words[end]) + 1
            end += 1
        found, before = _features(words[at:end], before)
        yield found
        at = end


def _features(words: list[str], before: np.uint64 | None) -> tuple[np.ndarray, np.uint64]:
    """Buckets of words, pairs and n-grams, and the last word's hash; ``before`` is that of the word ahead."""
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = letters == 32
    codes = letters.astype(np.uint64)
    edges = np.flatnonzero(space)
    prefix = np.cumsum(codes * POWERS[: len(codes)], dtype=np.uint64)
    hashes = (prefix[edges[1:]] - prefix[edges[:-1]]) * INVERSE[edges[:-1]]
    ahead = hashes if before is None else np.append(before, hashes)
    out = [_bucket(hashes, 1), _bucket(ahead[:-1] * RADIX + ahead[1:], 2)]
    gram, inner = codes, None
    for n in range(2, GRAMS[-1] + 1):
        if len(codes) < n:
            break
        gram = gram[:-1] * RADIX + codes[n - 1 :]
        if n > 2:
            middle = space[n - 2 : len(space) - 1]
            inner = middle if inner is None else inner[:-1] | middle
        if n in GRAMS:
            out.append(_bucket(gram[~inner], n))
    return np.concatenate(out), hashes[-1]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *buckets(text)]), return_counts=True)


@dataclass
class Scorer:
    """A trained model: what each bucket adds to the margin of label 1, the bias, and the score's calibration."""

    weights: np.ndarray
    bias: float
    centre: float = 0.0
    slope: float = 1.0

    def margin(self, text: str | None) -> float:
        total, n = 0.0, 0
        for found in buckets(text):
            total += float(self.weights[found].sum(dtype=np.float64))
            n += len(found)
        return total / max(1, n) + self.bias

    def score(self, margin: float) -> float:
        """1 / (1 + exp(-x)), with THRESHOLD at the margin that separates the labels best."""
        x = self.slope * (margin - self.centre) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 12, rate: float = 1.0, seed: int = 7, least_steps: int = 6000) -> Scorer:
    """Stochastic gradient descent over (buckets, counts) examples, with more epochs where these are few; a fifth only calibrates, if it has enough of either label."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    order = rng.permutation(len(labels))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(labels[fit])) < 2:
        return Scorer(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(0.5 / 0.5)), centre=float(np.log(THRESHOLD / (1 - THRESHOLD))))
    share = np.bincount(labels[fit], minlength=2) / len(fit)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-least_steps // len(fit)))
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            now = rate * (1 - step / steps)
            step += 1
            found, counts = examples[i]
            weight = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = weight @ vectors[found]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= 0.5 / share[labels[i]]
            back = layer.T @ p
            layer -= now * np.outer(p, hidden)
            bias -= now * p
            vectors[found] -= np.outer(weight, (now * back))
    model = Scorer(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))
    margins = np.array([float(model.weights[b] @ c) / max(1, c.sum()) + model.bias for b, c in examples])
    use = held if np.bincount(labels[held], minlength=2).min() >= 10 else order
    model.centre, spread = best_cut(margins[use], labels[use])
    model.slope = 4 / max(spread, 1e-6)
    return model


def best_cut(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The middle of the widest best gap between labels, by balanced accuracy, and the distance of the class means."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    right = np.append(0, np.cumsum(y == 0)) / max(1, (y == 0).sum()) + (np.append((y == 1).sum(), (y == 1).sum() - np.cumsum(y == 1))) / max(1, (y == 1).sum())
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    gaps = edges[best + 1] - edges[best]
    at = best[np.argmax(gaps)]
    return float((edges[at] + edges[at + 1]) / 2), float(abs(m[y == 1].mean() - m[y == 0].mean()))


def labelled_sample(labels: DataFrame, column: str, out_of: int, held: int, rows: tuple[int, int]) -> DataFrame:
    """doc_id and label of labelled documents outside the held-out fold, at most so many of label 0 and 1, by a hash of the id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % out_of
    open_ = labels.filter((fold != held) & F.col(column).isNotNull()).select("doc_id", F.col(column).cast("int").alias("label"))
    parts = [open_.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[y]) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_texts(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label and text of the chosen documents of at most SAMPLE_BYTES, one row an id: no more rows than ids were chosen."""
    texts = df.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(df: DataFrame, labels: DataFrame, column: str = "quality", out_of: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Train on labelled rows of ``df``: ids and features of the sample come to the driver, bounded by ``sample_rows``."""
    small_batches(df.sparkSession)
    texts = labelled_texts(df, labelled_sample(labels, column, out_of, held, (sample_rows // 2, sample_rows // 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([b.astype("<u4").tobytes() for b, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], ["doc_id", "label", "buckets", "counts"])

    rows = sorted(texts.mapInArrow(run, "doc_id string, label int, buckets binary, counts binary").collect(), key=lambda r: (r[0], r[1]))
    return train([(np.frombuffer(r[2], "<u4"), np.frombuffer(r[3], "<u4")) for r in rows], [r[1] for r in rows])


def scores(df: DataFrame, model: Scorer, out_of: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            found = [use.score(use.margin(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = dict(df.dtypes)["doc_id"]
    scored = df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % out_of, F.lit(-1))
    return scored.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted to be of quality, with all their columns; only the texts pass through Python."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(shared.value.margin(t)) for t in texts], dtype="float64")

    return df.filter(score("text") >= THRESHOLD)
