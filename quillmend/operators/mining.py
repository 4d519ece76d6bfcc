"""Mining repairs from pairs of truth and reading."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import pairs_of_changes
from .matching import BLOCK_TERMS, packed, small


def changes_of(truth: str, read: str, pad: int = 2, longest: int = 8) -> list[tuple[str, str]]:
    """Equal-length replacements (wrong, right) that turn a reading into the truth, widened by a little context."""
    out = []
    for op, i, j, k, l in SequenceMatcher(None, read, truth, autojunk=False).get_opcodes():
        if op != "replace" or j - i != l - k or j - i > longest:
            continue
        left = min(pad, i, k)
        right = min(pad, len(read) - j, len(truth) - l)
        if read[i - left : i] == truth[k - left : k] and read[j : j + right] == truth[l : l + right]:
            out.append((read[i - left : j + right], truth[k - left : l + right]))
    return out


def diff_pairs(rows: DataFrame, key: str, truth: str, read: str, pad: int = 2) -> DataFrame:
    """key, wrong, right for every equal-length change, by an Arrow map over the rows."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wrong, right = [], [], []
            for k, t, r in zip(*(c.to_pylist() for c in batch.columns)):
                for w, x in changes_of(t or "", r or "", pad):
                    keys.append(k), wrong.append(w), right.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(wrong, pa.string()), pa.array(right, pa.string())], [key, "wrong", "right"])

    return rows.select(key, truth, read).mapInArrow(run, f"{key} {kind}, wrong string, right string")


def vocabulary(*terms: DataFrame, pattern: str = r"^[ぁ-んァ-ヶ一-龥ー]+$") -> DataFrame:
    """Distinct terms of one-column tables that match a pattern: word."""
    out = None
    for t in terms:
        one = t.toDF("word")
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("word").rlike(pattern)).distinct()


def real_words_removed(fixes: DataFrame, words: DataFrame, corpus: DataFrame, text: str, longest_word: int = 12) -> DataFrame:
    """Fixes whose wrong form is no word, occurs in no corpus text and holds no word of three or more characters.

    The corpus is searched once for each block of wrong forms, which travel as arrays.
    """
    bare = fixes.join(words.select(F.col("word").alias("wrong")), "wrong", "left_anti")
    grams = bare.select("wrong", F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(3), F.lit(longest_word)), lambda n: F.when(F.length("wrong") >= n, F.transform(F.sequence(F.lit(1), F.length("wrong") - n + 1), lambda i: F.substring("wrong", i, n))).otherwise(F.array().cast("array<string>")))), lambda g: g != "")).alias("word"))
    holds = grams.join(words, "word").select("wrong").distinct()
    bare = bare.join(holds, "wrong", "left_anti")
    blocks = packed(bare.select("wrong").distinct(), ["wrong"], BLOCK_TERMS)
    seen = reduce(DataFrame.unionByName, [corpus.join(F.broadcast(one)).select(F.explode(F.filter("items", lambda w: F.contains(F.col(text), w["wrong"]))["wrong"]).alias("wrong")) for one in blocks]).distinct()
    return bare.join(seen, "wrong", "left_anti")


def generated_fixes(words: DataFrame, confusions: DataFrame, word: str = "word") -> DataFrame:
    """Words with one character confused: wrong, right. Kept where the wrong form is no word and has one origin. Confusions: bad, good."""
    at = words.select(F.col(word).alias("right"), F.explode(F.sequence(F.lit(1), F.length(word))).alias("i")).withColumn("good", F.substring("right", F.col("i"), F.lit(1)))
    made = at.join(small(confusions), "good").select(F.concat(F.substring("right", F.lit(1), F.col("i") - 1), "bad", F.substring("right", F.col("i") + 1, F.length("right"))).alias("wrong"), "right")
    novel = made.join(words.select(F.col(word).alias("wrong")), "wrong", "left_anti")
    return novel.groupBy("wrong").agg(F.min("right").alias("right"), F.count_distinct("right").alias("n")).filter("n = 1").drop("n")


def mined_fixes(pairs: DataFrame, support: int) -> DataFrame:
    """Changes seen often enough with one clear target: wrong, right, n."""
    return pairs_of_changes(pairs, "wrong", "right", support)


def merged_fixes(generated: DataFrame, written: DataFrame) -> DataFrame:
    """Written fixes before generated ones, which go first in order: wrong, right, ord."""
    kept = generated.join(written.select("wrong"), "wrong", "left_anti").select("wrong", "right", F.lit(0).alias("ord"))
    return kept.unionByName(written.select("wrong", "right", F.lit(1).alias("ord")))


def dictionary_build(terms: DataFrame, term: str, flagged: Column) -> DataFrame:
    """Flagged terms first, then others not among them, each once: term, flagged."""
    return terms.groupBy(F.col(term).alias("term")).agg(F.bool_or(flagged).alias("flagged")).orderBy(F.desc("flagged"), "term")


def boilerplate_build(lines: DataFrame, line: str, shortest: int = 4) -> DataFrame:
    """Printed phrases without blanks and boxes, long enough, distinct, longest first."""
    bare = lines.select(F.regexp_replace(line, r"[\s　□■☐]+", "").alias("phrase"))
    return bare.filter(F.length("phrase") >= shortest).distinct().orderBy(F.desc(F.length("phrase")), "phrase")
