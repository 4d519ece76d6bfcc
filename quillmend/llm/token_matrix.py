"""Token ids as packed binary matrices, by best-fit decreasing.

Inside a partition, a bounded group of documents at a time, pieces are placed
longest first into the open sequence whose free room is the smallest that
fits; a segment tree over free room finds it. Documents longer than a sequence
are split losslessly into full sequences and a remainder. A row of the result
is one row of the id matrix as little-endian unsigned integers padded with the
pad id, the cumulative segment lengths (from 0 to the tokens used), the row of
the position matrix, which restarts at 0 with each segment (padding has 0), and
its pieces. Ids or positions beyond ``dtype`` raise an error.

Defined results: as for packing: null texts are empty, each row is packed, an
empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .packing import CAPACITY, END_ID, GROUP_TOKENS, Piece, encoded_documents


class RoomTree:
    """Open bins by free room; a segment tree holds how many bins each range of rooms has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.bins[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, size: int) -> int | None:
        """The smallest room of at least ``size`` that a bin has."""
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the lengths in each bin, by best fit in decreasing order."""
    tree, bins = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            bins.append([])
            where, room = len(bins) - 1, capacity
        else:
            where = tree.take(room)
        bins[where].append(i)
        tree.put(room - lengths[i], where)
    return bins


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of each used token: 0 at every segment's start."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def filled(matrix: np.ndarray, row: int, at: int, values: np.ndarray) -> None:
    """Write values into a matrix row; they must fit its type."""
    if len(values) and int(values.max()) > np.iinfo(matrix.dtype).max:
        raise ValueError(f"{int(values.max())} does not fit {matrix.dtype.str}")
    matrix[row, at : at + len(values)] = values


def unpack_row(ids: bytes, cu_seqlens: list[int], dtype: str = "<u2") -> list[np.ndarray]:
    """The segments of a matrix row."""
    row = np.frombuffer(ids, dtype)
    return [row[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:])]


PIECE = "struct<doc_id:{}, start:bigint, length:bigint, offset:bigint, doc_tokens:bigint, ids_crc32:bigint>"


def token_matrix(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, pad_id: int = 0, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, dtype: str = "<u2") -> DataFrame:
    """One row per sequence: sequence_id, ids and positions (binary), cu_seqlens, pieces. ``dtype`` must hold every id."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    schema = f"sequence_id bigint, ids binary, positions binary, cu_seqlens array<int>, pieces array<{PIECE.format(kind)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, count = TaskContext.get().partitionId() << 36, 0
        id_type = pa.int64()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        def rows(group: list[Piece]) -> pa.RecordBatch:
            nonlocal count
            bins = best_fit([len(p.ids) for p in group], capacity)
            matrix, places = np.full((len(bins), capacity), pad_id, dtype), np.zeros((len(bins), capacity), dtype)
            cumulative, pieces = [], []
            for row, members in enumerate(bins):
                cu, inside = [0], []
                for i in members:
                    p, a = group[i], cu[-1]
                    b = a + len(p.ids)
                    filled(matrix, row, a, p.ids)
                    inside.append({"doc_id": p.doc_id, "start": p.start, "length": b - a, "offset": a, "doc_tokens": p.doc_tokens, "ids_crc32": zlib.crc32(matrix[row, a:b].astype("<u4").tobytes())})
                    cu.append(b)
                filled(places, row, 0, positions(cu))
                cumulative.append(cu)
                pieces.append(inside)
            struct = pa.struct([("doc_id", id_type), *((n, pa.int64()) for n in ("start", "length", "offset", "doc_tokens", "ids_crc32"))])
            arrays = [pa.array(range(first + count, first + count + len(bins)), pa.int64()), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (matrix, places)), pa.array(cumulative, pa.list_(pa.int32())), pa.array(pieces, pa.list_(struct))]
            count += len(bins)
            return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "ids", "positions", "cu_seqlens", "pieces"])

        group, tokens = [], 0
        for one, ids in encoded_documents(typed(), tokenizer, end_id):
            piece, total = Piece(one, 0, ids, len(ids)), len(ids)
            while len(piece.ids) > capacity:
                full, piece = piece.split(capacity)
                group.append(full)
            group.append(piece)
            tokens += total
            if tokens >= group_tokens:
                yield rows(group)
                group, tokens = [], 0
        yield rows(group)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pieces_of(matrix: DataFrame) -> DataFrame:
    """One row per piece with its sequence, the sequence's number of segments, and checksums of its ids, positions and cumulative lengths (as text joined by commas)."""
    digests = [F.crc32(F.col(c)).alias(f"{name}_crc32") for name, c in (("row", "ids"), ("positions", "positions"))]
    lengths = F.crc32(F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").cast("binary")).alias("cu_seqlens_crc32")
    rows = matrix.select("sequence_id", "pieces", (F.size("cu_seqlens") - 1).alias("segments"), *digests, lengths)
    return rows.select(F.posexplode("pieces").alias("segment", "p"), *rows.columns).select("p.*", "sequence_id", "segment", "segments", "row_crc32", "positions_crc32", "cu_seqlens_crc32")
