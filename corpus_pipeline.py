"""Documents to packed sequences in five stages, each over what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmend.llm import exact_dedup, packing, quality, simhash, toxicity
from quillmend.llm.common import cut, table
from quillmend.llm.pretokens import tokenizer_path


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labelled documents that are still there."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_topics(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of five-word shingles, the one with the smallest id."""
    return simhash.keep_one_of_each(docs, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("quality", good), ("exact dedup", distinct_texts), ("near dedup", distinct_topics), ("packing", packed)]

#: The classifiers' decisions have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents on, each cut from the one before by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
