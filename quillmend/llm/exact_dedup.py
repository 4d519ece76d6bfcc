"""Exact duplicates by two passes over Bloom filters.

Pass one reads a 64-bit hash of every text and fills two bit arrays: "once"
holds the cells that any hash has hit, "twice" those that were hit again. The
pair is a counting Bloom filter saturated at two; merging is associative, so
tasks build sparse pieces and the pieces of one segment meet in one task.
Pass two tests each row against "twice": a hash with a cell outside it occurs
once, and its row passes straight through. Only the others shuffle, as a
SHA-256 and an id, and are grouped exactly, so false positives cost time but
never change a result.

One filter has at most ``max_bits`` cells. Tables that need more cut the hashes
into slices, each with a filter and a pass of its own, so that the share of rows
that shuffle does not grow. Defined results: a null text counts as empty; of equal texts the largest
id stays (rows that repeat both id and text get equal answers, and
``drop_exact_duplicates`` returns one of them); a null id loses to any other;
an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_hot, small_batches, text_of, unused

SEGMENT_BITS = 1 << 18
PROBES = 3


def filter_bits(rows: int, per_row: int = 12, max_bits: int = 1 << 30) -> int:
    """Cells for so many rows: a power of two between one segment and ``max_bits``."""
    return int(min(max_bits, max(SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(2, rows) * per_row))))))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES cells of each 64-bit hash, as rows."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((low + steps * high) & np.uint64(bits - 1)).astype(np.int64)


def first_column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _pieces(bits: int, hashes_of=first_column, flush_rows: int = 200_000):
    """Batches -> sparse pieces (segment, cells hit once, cells hit again) of the hashes that they hold."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, hits = np.unique(cells(np.concatenate(held), bits), return_counts=True)
        where = np.flatnonzero(np.diff(cell // SEGMENT_BITS, prepend=-1))
        ends = np.append(where[1:], len(cell))
        segments, once, twice = [], [], []
        for a, b in zip(where, ends):
            segments.append(int(cell[a] // SEGMENT_BITS))
            offset = (cell[a:b] % SEGMENT_BITS).astype(np.uint32)
            once.append(offset.tobytes())
            twice.append(offset[hits[a:b] > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(hashes_of(batch))
            rows += len(held[-1])
            if rows >= flush_rows:
                yield emit(held)
                held, rows = [], 0
        if rows:
            yield emit(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch], which: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's segments -> its segments of "once" (0) or "twice" (1), packed. Holds two bit arrays a segment."""
    arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if segment not in arrays:
                arrays[segment] = (np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool))
            seen, again = arrays[segment]
            new = np.frombuffer(once, np.uint32)
            again[new] |= seen[new]
            again[np.frombuffer(twice, np.uint32)] = True
            seen[new] = True
    packed = [zlib.compress(np.packbits(again, bitorder="little").tobytes(), 1) for again in (pair[which] for pair in arrays.values())]
    yield pa.RecordBatch.from_arrays([pa.array(list(arrays), pa.int32()), pa.array(packed, pa.binary())], ["segment", "bits"])


def filter_of(rows: DataFrame, bits: int, repeated: bool, hashes_of=first_column) -> np.ndarray:
    """The packed "twice" or "once" array over the 64-bit hashes of a table's batches: bits/8 bytes, at most max_bits/8."""
    spark = rows.sparkSession
    pieces = rows.mapInArrow(_pieces(bits, hashes_of), "segment int, once binary, twice binary")
    wide = max(1, min(bits // SEGMENT_BITS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = pieces.repartition(wide, "segment").mapInArrow(lambda batches: _merged(batches, int(repeated)), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, packed in merged.collect():
        at = segment * (SEGMENT_BITS // 8)
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def in_filter(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of each hash are set."""
    cell = cells(hashes, bits)
    return ((packed[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all(axis=0)


def filter_slices(rows: int, per_row: int = 12, max_bits: int = 1 << 30) -> int:
    """Slices of the hashes, so that each one's filter has room for its rows."""
    return max(1, -(-rows * per_row // max_bits))


def _test(shared, bits: int):
    """A function of a hash column: whether all its cells are set in the broadcast filter."""

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_filter(shared.value, hashes.to_numpy(), bits))

    return test


def maybe_repeated(df: DataFrame, key: str, into: str, rows: int, max_bits: int = 1 << 30, slices: int | None = None) -> DataFrame:
    """``df`` with a column that is false only where the 64-bit hash ``key`` certainly occurs once."""
    n = slices or filter_slices(rows, max_bits=max_bits)
    bits = filter_bits(-(-rows // n), max_bits=max_bits)
    out = None
    for k in range(n):
        part = df if n == 1 else df.filter(F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(n)) == k)
        twice = df.sparkSession.sparkContext.broadcast(filter_of(part.select(key), bits, repeated=True))
        found = part.withColumn(into, _test(twice, bits)(key))
        out = found if out is None else out.unionByName(found)
    return out


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 1 << 30, slices: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    small_batches(df.sparkSession, rows=10_000)
    keys = cut(df.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_of(text), 256)).alias("sha"), F.xxhash64(text_of(text)).alias("h")))
    rows = cut(maybe_repeated(keys, "h", "maybe", keys.count(), max_bits, slices))
    single = rows.filter(~F.col("maybe")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    repeated = rows.filter("maybe").select("doc_id", "sha")
    groups = cut(repeated.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = [r[0] for r in groups.filter(F.col("group_size") > max(50, total // HOT_SHARE)).select("sha").collect()]
    found = single.unionByName(join_hot(repeated, groups, "sha", hot).select("doc_id", "sha", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 1 << 30, slices: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rows that may repeat are the only ones to shuffle."""
    small_batches(df.sparkSession)
    h, maybe, sha, of, keep = unused(df, "h", "maybe", "sha", "of", "keep")
    marked = maybe_repeated(df.withColumn(h, F.xxhash64(text_of(text))), h, maybe, df.count(), max_bits, slices)
    repeated = marked.filter(F.col(maybe)).withColumn(sha, F.sha2(text_of(text), 256))
    winners = cut(repeated.groupBy(F.col(sha).alias(of)).agg(F.max(doc_id).alias(keep)))
    # One row per text and id at most: ids decide among copies, so hot texts thin out to one row each before any join.
    kept = repeated.join(winners, (F.col(sha) == F.col(of)) & F.col(doc_id).eqNullSafe(F.col(keep)), "left_semi").dropDuplicates([sha])
    return marked.filter(~F.col(maybe)).select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(kept.select(*(F.col(f"`{c}`") for c in df.columns)))
