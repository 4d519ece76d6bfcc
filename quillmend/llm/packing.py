"""Packing by multiway Karmarkar-Karp differencing.

Documents are encoded where they lie and packed inside their partition, a
bounded group at a time, so nothing shuffles. Pieces longer than a sequence are
cut into full sequences. The rest of a group is differenced: partial partitions
into as many windows as the group needs start with one piece each, and the two
with the largest imbalance merge with opposing order until one is left. If a
window exceeds the capacity, the window count rises by one and the group is
differenced again. A little of each group is held back and cut to fill the
near-equal windows up; what is left moves to the next group, and at a
partition's end it is cut into sequences of powers of two, which need no padding.

Defined results: a null text is empty and yields its end id alone; rows that
repeat are packed each; a null id is carried; an empty table gives no rows;
further columns are ignored. Sequence ids are unique over the table: the
partition in the high bits, then a count.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import encoder

CAPACITY = 4096
END_ID = 2
#: Tokens of one group; what a task holds of its documents' ids.
GROUP_TOKENS = 1 << 20
#: Tokens a window has on average left when it is differenced; cut pieces of what the group held back then fill it up.
SLACK = 96


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


def difference(lengths: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """A window for each length, and the windows' sums, by Karmarkar-Karp differencing."""
    if not lengths:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    heap, sums, tree = [], [], []
    for i, n in enumerate(lengths):
        heap.append((-n, i))
        sums.append(n)
        tree.append(None)
    heapq.heapify(heap)

    def spread_out(node: int) -> np.ndarray:
        if tree[node] is not None:
            return sums[node]
        single = np.zeros(windows, np.int64)
        single[0] = sums[node]
        return single

    while len(heap) > 1:
        left, right = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = spread_out(left) + spread_out(right)[::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        for used in (left, right):
            if tree[used] is not None:
                sums[used] = None
        heapq.heappush(heap, (int(merged[-1] - merged[0]), len(sums)))
        sums.append(merged)
        tree.append((left, right, order))
    root = heap[0][1]
    out = np.zeros(len(lengths), np.int64)
    places = {root: np.arange(windows)}
    for node in range(root, -1, -1):
        place = places.pop(node)
        if tree[node] is None:
            out[node] = place[0]
            continue
        left, right, order = tree[node]
        places[left], places[right] = np.empty(windows, np.int64), np.empty(windows, np.int64)
        places[left][order] = place
        places[right][windows - 1 - order] = place
    return out, np.bincount(out, weights=lengths, minlength=windows).astype(np.int64)


def windows_of(lengths: list[int], windows: int, capacity: int) -> tuple[np.ndarray, int]:
    """Differencing with as many windows, at least ``windows``, as keep every sum within the capacity."""
    while True:
        where, sums = difference(lengths, windows)
        if not len(sums) or sums.max() <= capacity:
            return where, windows
        windows += 1


class Packer:
    """Packs a stream of pieces; ``ready`` collects finished sequences, each a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS):
        self.capacity, self.group_tokens = capacity, group_tokens
        self.held: list[Piece] = []
        self.tokens = 0
        self.ready: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.capacity:
            full, piece = piece.split(self.capacity)
            self.ready.append([full])
        if len(piece.ids):
            self.held.append(piece)
            self.tokens += len(piece.ids)
        if self.tokens >= self.group_tokens:
            self.flush()

    def flush(self, last: bool = False) -> None:
        windows = self.tokens // self.capacity
        over = self.tokens - max(0, windows * (self.capacity - SLACK))
        rest: list[Piece] = []
        while over:
            piece = self.held.pop()
            if len(piece.ids) > over:
                stays, piece = piece.split(len(piece.ids) - over)
                self.held.append(stays)
            rest.append(piece)
            over -= len(piece.ids)
        if windows:
            where, windows = windows_of([len(p.ids) for p in self.held], windows, self.capacity)
            sequences: list[list[Piece]] = [[] for _ in range(windows)]
            for piece, window in zip(self.held, where.tolist()):
                sequences[window].append(piece)
            for sequence in sequences:
                room = self.capacity - sum(len(p.ids) for p in sequence)
                while room and rest:
                    piece = rest.pop()
                    if len(piece.ids) > room:
                        piece, after = piece.split(room)
                        rest.append(after)
                    sequence.append(piece)
                    room -= len(piece.ids)
            self.ready += [s for s in sequences if s]
        self.held = rest
        self.tokens = sum(len(p.ids) for p in rest)
        if last:
            self._binary_tail()

    def _binary_tail(self) -> None:
        """The last tokens as sequences of decreasing powers of two, cut to fit exactly."""
        left = list(reversed(self.held))
        while self.tokens:
            room = min(self.capacity, 1 << (self.tokens.bit_length() - 1))
            self.tokens -= room
            sequence: list[Piece] = []
            while room:
                piece = left.pop()
                if len(piece.ids) > room:
                    piece, after = piece.split(room)
                    left.append(after)
                sequence.append(piece)
                room -= len(piece.ids)
            self.ready.append(sequence)
        self.held = []


def encoded_documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each row's id and its token ids with the end id."""
    end = np.uint32(end_id).tobytes()
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist())):
            yield doc_id, np.frombuffer(ids + end, "<u4")


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, count, first = Packer(capacity, group_tokens), 0, TaskContext.get().partitionId() << 36

        def rows() -> pa.RecordBatch:
            nonlocal count
            found: list[list] = [[] for _ in range(7 + with_ids)]
            for sequence in packer.ready:
                offset = 0
                for p in sequence:
                    raw = p.ids.tobytes()
                    for column, value in zip(found, (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, first + count, offset, raw)):
                        column.append(value)
                    offset += len(p.ids)
                count += 1
            packer.ready = []
            arrays = [pa.array(found[0], id_type), *(pa.array(c, pa.int64()) for c in found[1:7]), *(pa.array(c, pa.binary()) for c in found[7:])]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

        id_type = pa.int64()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        for one, ids in encoded_documents(typed(), tokenizer, end_id):
            packer.add(Piece(one, 0, ids, len(ids)))
            if len(packer.ready) >= 256:
                yield rows()
        packer.flush(last=True)
        yield rows()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
