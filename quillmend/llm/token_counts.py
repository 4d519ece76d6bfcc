"""Token counts by a two-tier lookup of pre-token lengths on the map side.

Tier one is a table of frequent pre-tokens and their token counts, found in a
bounded sample of documents and broadcast as one packed string and one byte
array; its size is a parameter. Tier two is each worker's own cache, which the
library fills for pre-tokens met for the first time. No pre-token is shuffled,
and what the table holds changes the speed only, never a count.

Defined results: a null text is empty and has 0 bytes and tokens; rows that
repeat get equal counts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import CACHE_ENTRIES, Encoder, encoder, gaps_in

#: Entries of the broadcast table, and the number and largest size of documents sampled to choose them. Only speed depends on either.
TABLE_ENTRIES = 30_000
SAMPLE_DOCUMENTS = 400
SAMPLE_BYTES = 1 << 15
SEPARATOR = "\x00"


class LengthTable:
    """Pre-tokens and their token counts in two flat buffers."""

    def __init__(self, lengths: dict[str, int]):
        kept = {w: n for w, n in lengths.items() if n < 256 and SEPARATOR not in w}
        self.words = SEPARATOR.join(kept).encode("utf-8", "surrogatepass")
        self.counts = np.array(list(kept.values()), np.uint8).tobytes()

    def unpacked(self) -> dict[str, int]:
        words = self.words.decode("utf-8", "surrogatepass").split(SEPARATOR) if self.counts else []
        return dict(zip(words, self.counts))


def frequent_lengths(texts: list[str | None], use: Encoder, entries: int = TABLE_ENTRIES) -> LengthTable:
    """Lengths of the most frequent pre-tokens of some texts."""
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update(use.split(text or "") or ())
    return LengthTable(lengths_of([w for w, _ in seen.most_common(entries)], use))


def lengths_of(words: list[str], use: Encoder) -> dict[str, int]:
    out: dict[str, int] = {}
    for part, _, ends in use.encoded(words):
        out.update(zip(part, np.diff(ends, prepend=0).tolist()))
    return out


class TokenCounter:
    """Counts tokens of texts, keeping lengths of pre-tokens that the shared table lacks."""

    def __init__(self, path: str, table: LengthTable):
        self.encoder = encoder(path)
        self.shared = table.unpacked()
        self.known = dict(self.shared)

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > len(self.shared) + CACHE_ENTRIES:
            self.known = dict(self.shared)
        get = self.known.get
        split = [self.encoder.split(t or "") for t in texts]
        parts = [None if w is None else list(map(get, w)) for w in split]
        gaps = [(w, p, at) for w, p in zip(split, parts) if p is not None for at in gaps_in(p)]
        if gaps:
            self.known.update(lengths_of(list({w[at]: None for w, _, at in gaps}), self.encoder))
            for w, p, at in gaps:
                p[at] = self.known[w[at]]
        return [len(self.encoder.whole(t)) if p is None else sum(p) for t, p in zip(texts, parts)]


def token_counts(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[doc_id]
    sample = [r[0] for r in df.filter(F.octet_length(text) <= SAMPLE_BYTES).select(text).limit(SAMPLE_DOCUMENTS).collect()]
    shared = spark.sparkContext.broadcast(frequent_lengths(sample, encoder(tokenizer), entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer, shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = counter.counts(texts)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
