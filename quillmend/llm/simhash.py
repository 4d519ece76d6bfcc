"""SimHash near-duplicates by multi-index hashing over small Hamming balls.

A document's fingerprint has a bit set where over half of its shingle hashes
have it. Fingerprints are cut into segments and every segment has a table of
its values. Of two fingerprints within RADIUS bits, one of SEGMENTS segments
differs in RADIUS // SEGMENTS bits at most, so each fingerprint looks up the
ball of that radius around its segment's value, and complete distances of the
matches are verified. A bit that differs is set on one side only, so a side
enumerates only the flips that clear a bit, and every pair is met once a table.
Where more than CROWD fingerprints share a segment's value, the points one bit
around the remaining bits extend the key on both sides: remainders within two
bits share such a point and few lie around one, so no bucket grows with a group.

``similar_groups`` serves stages that ask for a similarity of shingle sets,
which small Hamming distances alone cannot promise (sets of similarity 0.8
differ by some ten bits of 64). Its first links come from the same tables; the
rest from prefixes: in one order of all shingles, sets of similarity s share
one of the first n - ceil(s n) + 1 of each set's n. Prefix shingles that occur
once are dropped by a Bloom filter before they shuffle. Of shingles that the
same texts have, only the bucket of the first in the order is kept, so a pair
meets once for all of them. Large buckets are dealt into parts. A part first
proposes a spanning forest of its likeliest pairs; when the verified ones are
contracted, all pairs of a bucket that are still in different components are
compared, across its parts too, unless it has become one component. Three
bounds rule pairs out without error: sizes; places in the order, since sets
share nothing ahead of the first shingle that they share, and in its bucket the
rest of each must be enough; and odd sketches (parities of the shingles in each
cell, which differ in no more cells than the sets differ in shingles), of a cell
a shingle or more. The complete sets decide every link, so the result is exact.
Work can grow with the square of a bucket only where its texts stay in different
components.

Components are contracted inside tasks first, then by hooking each node to its
smallest neighbour and pointer jumping until few pairs are left, which one task
finishes. Documents join at the end. Defined results: a null text is empty; no
words gives fingerprint zero, which links like any other; equal texts share a
fingerprint; ids may repeat; null ids are never the smallest unless alone; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, join_hot, small_batches, without_ids
from .exact_dedup import filter_bits, filter_of, in_filter

SEED = 42
SEGMENTS = 2
RADIUS = 2
#: Fingerprints that may share a segment's value before the rest of their bits joins the key.
CROWD = 64
#: Rows of a table that may be broadcast, and pairs that one task may contract to the end. Larger ones take the distributed way.
BROADCAST_ROWS = 500_000
LAST_PAIRS = 500_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of so many words of the ASCII-lower-cased text, or of the whole shorter sequence."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, b: a + 1 + b))
    width = min(words, len(found))
    starts = [0] + [e + 1 for e in ends[: len(found) - width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes, repeats included; zero of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_masks(segments: int) -> list[int]:
    """The bits of each segment; widths differ by one at most."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def segment_balls(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(segment, its bits, a flip) of each lookup: flips of at most ``radius`` // ``segments`` bits inside the segment."""
    inside = radius // segments
    if inside > 1 or segments < 1:
        raise ValueError("segments must be so many that a radius of one bit inside a segment is enough")
    return [(i, mask, flip) for i, mask in enumerate(segment_masks(segments)) for flip in [0, *(1 << b for b in range(64) if inside and mask >> b & 1)]]


def _literals(rows: list[tuple[int, ...]], names: list[str]) -> Column:
    return F.array(*(F.struct(*(F.lit(signed(v)).cast("bigint").alias(n) for v, n in zip(row, names))) for row in rows))


def links(distinct: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Pairs a < b of all fingerprints (one column fp, distinct) within ``radius`` bits, which is two at most."""
    if radius > 2:
        raise ValueError("crowded values are split for a radius of two at most")
    value = F.col("x.mask").bitwiseAND(F.col("fp"))
    table = distinct.select(F.col("fp").alias("b"), F.explode(_literals(list(enumerate(segment_masks(segments))), ["segment", "mask"])).alias("x"), "fp").select("b", "x.segment", value.alias("value"), "x.mask")
    clears = (F.col("x.flip") == 0) | (F.col("x.flip").bitwiseAND(F.col("fp")) != 0)
    ball = distinct.select("fp", F.explode(_literals(segment_balls(segments, radius), ["segment", "mask", "flip"])).alias("x")).filter(clears)
    probes = ball.select(F.col("fp").alias("a"), "x.segment", value.bitwiseXOR(F.col("x.flip")).alias("value"), "x.mask", (F.col("x.flip") == 0).alias("same"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (~F.col("same") | (F.col("a") < F.col("b")))
    key = ["segment", "value"]

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        sides = left.select("a", "same", *on).alias("l").join(right.select("b", *(F.col(c).alias(f"_{c}") for c in on)).alias("r"), [F.col(c) == F.col(f"_{c}") for c in on] + [near])
        return sides.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    crowded = cut(table.groupBy(*key).count().filter(F.col("count") > crowd).select(*key), FEWER)
    n = crowded.count()
    if not n:
        return met(probes, table, key).distinct()
    crowded = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
    rest = F.explode(F.array(*(F.lit(signed(1 << b)).cast("bigint") for b in range(64)), F.lit(0).cast("bigint"))).alias("flip")

    def around(rows: DataFrame, of: str) -> DataFrame:
        points = rows.join(crowded, key, "left_semi").select("*", rest).filter(F.col("flip").bitwiseAND(F.col("mask")) == 0)
        return points.withColumn("point", F.col(of).bitwiseXOR(F.col("flip")).bitwiseAND(F.bitwise_not("mask")))

    few = met(probes.join(crowded, key, "left_anti"), table.join(crowded, key, "left_anti"), key)
    return few.unionByName(met(around(probes, "a"), around(table, "b"), [*key, "point"])).distinct()


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the pairs, in order, and the smallest node that it can reach."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        open_ = low != high
        i, j = i[open_], j[open_]
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, root[root]):
            root = root[root]
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch], whole: bool = False, at_once: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a task as (node, its root among them): no more rows than nodes; with ``whole``, roots of roots too."""
    held, rows = [], 0

    def roots() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = local_roots(*(np.concatenate([h[side] for h in held]) if held else np.zeros(0, np.int64) for side in (0, 1)))
        return (nodes, root) if whole else (nodes[nodes != root], root[nodes != root])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns[:2]))
        rows += batch.num_rows
        if rows > at_once:
            held = [roots()]
            rows = 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots()], ["a", "b"])


def components(edges: DataFrame, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """node and root (the smallest node it can reach) for every node of the pairs (a, b), both longs.

    Tasks contract their own pairs, rounds hook every node to its smallest
    neighbour, jump pointers until all point at roots and contract the pairs to
    roots; once ``last_pairs`` or fewer are left, one task finishes them.
    """
    pairs = "a bigint, b bigint"
    edges = cut(edges.select("a", "b").mapInArrow(_contracted, pairs), FEWER)
    found = None

    def after(parent: DataFrame) -> DataFrame:
        """What was found before, followed to the new roots, and what is new."""
        if found is None:
            return parent
        ahead = _follow(found, parent, "root")
        return cut(ahead.unionByName(parent.join(ahead.select("node"), "node", "left_anti")), FEWER)

    while n := edges.count():
        if n <= last_pairs:
            return after(cut(edges.coalesce(1).mapInArrow(lambda batches: _contracted(batches, whole=True), pairs).toDF("node", "root")))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), FEWER)
        while True:
            jumped = cut(_follow(parent.withColumn("before", F.col("root")), parent, "root"), FEWER)
            parent = jumped.select("node", "root")
            if jumped.filter("before <> root").isEmpty():
                break
        found = after(parent)
        ahead = _follow(_follow(edges, parent, "a"), parent, "b").filter("a <> b")
        edges = cut(ahead.mapInArrow(_contracted, pairs), FEWER)
    return found if found is not None else edges.toDF("node", "root")


def _follow(rows: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Replace a column by its root in ``parent``; values that have none stay. AQE splits the rows of a hot root."""
    step = parent.select(F.col("node").alias("__key"), F.col("root").alias("__root"))
    if parent.count() <= BROADCAST_ROWS:
        step = F.broadcast(step)
    return rows.withColumnRenamed(column, "__key").join(step, "__key", "left").withColumn(column, F.coalesce("__root", "__key")).select(*rows.columns)


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    docs = cut(fingerprints(df, doc_id, text, words))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    total = docs.count()
    rooted = cut(_follow(distinct.withColumn("root", F.col("fp")), components(links(distinct.select("fp"))), "root"), FEWER)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(rooted.select("fp", "root", "n").join(smallest, "root").select("fp", "component_id", "n"), FEWER)
    hot = [r[0] for r in of.filter(F.col("n") > max(50, total // HOT_SHARE)).select("fp").collect()]
    return join_hot(docs, of.drop("n"), "fp", hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts whose shingles are counted: one in so many, by a hash of the id.
COMMON_SHARE = 16
#: Times that a common shingle is seen in these, and the most that are listed. The list only sets an order, so it never changes a result.
COMMON_SEEN = 3
COMMON_MOST = 200_000
#: Cells in which entries of a bucket are compared first, the most of an entry's odd sketch, and the fewest and most of a node's own.
ENTRY_CELLS = 512
ENTRY_MOST = 1 << 15
NODE_CELLS = (512, 1 << 16)
#: Small tables are written in this share of the shuffle's partitions.
FEWER = 8
#: Entries of a bucket that meet in one block, give or take; entries a task compares at a time, pairs of them, and bytes of their sketches.
BLOCK = 256
ENTRIES_AT_ONCE = 20_000
PAIRS_AT_ONCE = 1 << 18
BYTES_AT_ONCE = 1 << 24


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(shingle_hashes(text, words))


def set_mark(shingles: np.ndarray) -> int:
    """A signed long that stands for a set of shingles."""
    return signed(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED))


def set_prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first shingles, uncommon ones before common ones, of which sets of this similarity share at least one."""
    if not len(shingles):
        return shingles
    place = np.searchsorted(common, shingles)
    listed = np.append(common, np.uint64(0))[place] == shingles if len(common) else np.zeros(len(shingles), bool)
    listed &= place < len(common)
    keep = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-9)) + 1
    return np.concatenate([shingles[~listed], shingles[listed]])[:keep]


def odd_sketch(shingles: np.ndarray, cells: int) -> bytes:
    """Whether each of a power of two of cells holds an odd number of shingles, eight cells a byte."""
    held = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(held.astype(bool), bitorder="little").tobytes()


def node_sketch(shingles: np.ndarray) -> bytes:
    """An odd sketch of two cells a shingle or more."""
    return odd_sketch(shingles, int(np.clip(1 << (2 * len(shingles)).bit_length(), *NODE_CELLS)))


def entry_sketch(shingles: np.ndarray) -> bytes:
    """An odd sketch of a cell a shingle or more, up to a bound."""
    return odd_sketch(shingles, int(np.clip(1 << len(shingles).bit_length(), ENTRY_CELLS, ENTRY_MOST)))


def sketches_apart(a: bytes, b: bytes) -> int:
    """Cells in which two odd sketches differ: no more than the shingles in which their sets do. The longer one is folded."""
    left, right = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(left) > len(right):
        left, right = right, left
    return int(np.bitwise_count(left ^ np.bitwise_xor.reduce(right.reshape(-1, len(left)), axis=0)).sum())


def most_apart(size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """What sets of these sizes differ by at most at this similarity; negative where the sizes rule it out."""
    fits = np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-6
    return np.where(fits, (1 - similarity) / (1 + similarity) * (size_a + size_b) + 1e-6, -1)


def may_start(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may have the similarity if the shingle at these places is the first that they share."""
    return np.minimum(size_a - place_a, size_b - place_b) >= similarity / (1 + similarity) * (size_a + size_b) - 1e-6


def are_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and shared / (len(a) + len(b) - shared) >= similarity


class Sketches:
    """Odd sketches of entries, by their lengths, and all of them folded to ENTRY_CELLS."""

    def __init__(self, column: list[bytes]) -> None:
        self.words = np.array([len(s) // 8 for s in column], np.int64)
        self.row = np.zeros(len(column), np.int64)
        self.folded = np.zeros((len(column), ENTRY_CELLS // 64), np.uint64)
        self.of: dict[int, np.ndarray] = {}
        for n in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == n)
            self.of[n] = np.frombuffer(b"".join(column[k] for k in at), "<u8").reshape(-1, n)
            self.row[at] = np.arange(len(at))
            self.folded[at] = self.fold(self.of[n], ENTRY_CELLS // 64)

    @staticmethod
    def fold(sketches: np.ndarray, words: int) -> np.ndarray:
        return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)

    def coarse(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Cells of ENTRY_CELLS in which the entries of each pair differ."""
        return np.bitwise_count(self.folded[left] ^ self.folded[right]).sum(axis=1, dtype=np.int64)

    def fine(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Cells in which they differ with the longer sketch folded to the shorter."""
        short, long_ = np.where(self.words[left] <= self.words[right], (left, right), (right, left))
        apart = np.zeros(len(left), np.int64)
        for n, m in np.unique(np.stack([self.words[short], self.words[long_]], axis=1), axis=0).tolist():
            at = np.flatnonzero((self.words[short] == n) & (self.words[long_] == m))
            step = max(1, BYTES_AT_ONCE // (8 * m))
            for some in (at[k : k + step] for k in range(0, len(at), step)):
                sides = self.of[n][self.row[short[some]]], self.fold(self.of[m][self.row[long_[some]]], n)
                apart[some] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
        return apart


def open_pairs(starts: np.ndarray, sizes_of_blocks: np.ndarray, roots: np.ndarray, own: np.ndarray, within: np.ndarray, sizes: np.ndarray, places: np.ndarray, sketches: Sketches, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of two entries of one block that are of different components and may be similar, and how far they are apart.

    Blocks are runs of entries; blocks of one length are compared together, a bounded number of pairs at a time.
    Pairs that share a shingle ahead of the block's may be left to the bucket of the first that they share.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for n in np.unique(sizes_of_blocks[sizes_of_blocks > 1]).tolist():
        first, second = np.triu_indices(n, 1)
        at = starts[sizes_of_blocks == n]
        step = max(1, PAIRS_AT_ONCE // len(first))
        for some in range(0, len(at), step):
            left, right = ((at[some : some + step, None] + side).ravel() for side in (first, second))
            open_ = (roots[left] != roots[right]) & (within[left] | (own[left] != own[right]))
            open_ &= may_start(sizes[left], places[left], sizes[right], places[right], similarity)
            left, right = left[open_], right[open_]
            most = most_apart(sizes[left], sizes[right], similarity)
            left, right, most = left[most >= 0], right[most >= 0], most[most >= 0]
            met = sketches.coarse(left, right) <= most
            left, right, most = left[met], right[met], most[met]
            apart = sketches.fine(left, right)
            met = apart <= most
            out.append((left[met], right[met], apart[met] / np.maximum(most[met], 1e-9)))
    return tuple(np.concatenate(x) for x in zip(*out))


def likeliest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) of a minimum spanning forest: each component takes its nearest pair, until none is open."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(far, kind="stable")
    left, right = flat[: len(a)][order], flat[len(a) :][order]
    root, rank, chosen = np.arange(len(names)), np.arange(len(order)), [np.zeros(0, np.int64)]
    while True:
        rank = rank[root[left[rank]] != root[right[rank]]]
        if not len(rank):
            return order[np.unique(np.concatenate(chosen))]
        best = np.full(len(names), len(order))
        np.minimum.at(best, root[left[rank]], rank)
        np.minimum.at(best, root[right[rank]], rank)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        nodes, to = local_roots(root[left[picked]], root[right[picked]])
        jump = np.arange(len(names))
        jump[nodes] = to
        root = jump[root]


def _longs(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in column.to_pylist()]


def common_shingles(source: DataFrame, words: int) -> np.ndarray:
    """Shingles that a share of the texts holds repeatedly, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["h"])

    share = source.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % COMMON_SHARE == 0)
    counted = share.mapInArrow(run, "h bigint").groupBy("h").count().filter(F.col("count") >= COMMON_SEEN)
    return np.sort(counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").toArrow().column(0).to_numpy().view(np.uint64))


def verified(pairs: DataFrame, source: DataFrame, nodes: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity: sketches pass over most others, the sets decide."""

    def with_sides(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for column in ("a", "b"):
            rows = rows.join(table.select(F.col("node").alias(column), *(F.col(c).alias(f"{column}_{c}") for c in columns)), column)
        return rows.select("a", "b", *(f"{column}_{c}" for c in columns for column in ("a", "b")))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (c.to_numpy() for c in batch.columns[:4])
            apart = np.array([sketches_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            met = apart <= most_apart(size_a, size_b, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[met]), pa.array(b[met])], ["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_mark(s) for s in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], ["node", "shingles"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = np.array([are_similar(a, b, similarity) for a, b in zip(_longs(batch.column(2)), _longs(batch.column(3)))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(c.to_numpy()[met]) for c in batch.columns[:2]], ["a", "b"])

    def of_pairs(pairs: DataFrame) -> tuple[DataFrame, bool]:
        """The nodes in the pairs, and whether they are few."""
        few = 2 * pairs.count() <= BROADCAST_ROWS
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return nodes.join(F.broadcast(wanted) if few else wanted, "node", "left_semi"), few

    likely = cut(with_sides(pairs, of_pairs(pairs)[0], ["size", "sketch"]).mapInArrow(maybe, "a bigint, b bigint"), FEWER)
    held, few = of_pairs(likely)
    ids = held.select("doc_id").distinct()
    texts = source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    shingles = cut(texts.mapInArrow(sets, "node bigint, shingles binary"))
    if shingles.count() > held.count():  # ids repeat
        shingles = cut(shingles.dropDuplicates(["node"]))
    return cut(with_sides(likely, shingles, ["shingles"]).mapInArrow(exact, "a bigint, b bigint"), FEWER)


def proposals(forests: bool, similarity: float):
    """Entries (key, i, j, node, root, own, size, place, small), sorted by block -> open pairs of nodes, all of them or a forest of the likeliest."""

    def of(held: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        _, i, j, nodes, roots, own, sizes, places, small = held
        left, right, far = open_pairs(starts, ends - starts, roots, own, i == j, sizes, places, Sketches(small.tolist()), similarity)
        pairs = np.stack([np.minimum(nodes[left], nodes[right]), np.maximum(nodes[left], nodes[right])], axis=1)
        _, once = np.unique(pairs, axis=0, return_index=True)
        if forests:
            once = once[likeliest(roots[left[once]], roots[right[once]], far[once])]
        return pa.RecordBatch.from_arrays([pa.array(pairs[once, 0]), pa.array(pairs[once, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            held = [np.concatenate(x) for x in zip(*parts)]
            edges = np.flatnonzero(np.any([np.diff(x) != 0 for x in held[:3]], axis=0)) + 1
            bounds = np.concatenate([[0], edges, [len(held[0])] * last]).astype(np.int64)
            if len(bounds) > 1:
                yield of(held, bounds[:-1], bounds[1:])
            parts[:] = [] if last else [[x[bounds[-1] :] for x in held]]

        for batch in batches:
            if batch.num_rows:
                parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in parts) >= ENTRIES_AT_ONCE:
                yield from flush(last=False)
        if parts:
            yield from flush(last=True)

    return run


def similar_groups(df: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", words: int = 5, max_bits: int = 1 << 30) -> DataFrame:
    """doc_id and component_id of rows that are not alone in their component; rows with a null id are left out."""
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[doc_id]
    source = df.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(source, words))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            found = [np.unique(h) for h in hashes]
            longs = [[set_mark(s) for s in found], [signed(fingerprint_of(h)) for h in hashes], [len(s) for s in found]]
            raw = [[node_sketch(s) for s in found], [entry_sketch(s) for s in found], [set_prefix(s, similarity, common.value).astype("<u8").tobytes() for s in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in longs), *(pa.array(x, pa.binary()) for x in raw)], ["doc_id", "node", "fp", "size", "sketch", "small", "prefix"])

    docs = cut(source.mapInArrow(marks, f"doc_id {kind}, node bigint, fp bigint, size bigint, sketch binary, small binary, prefix binary"))
    heads = cut(docs.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    repeats = heads.filter("n > 1").select("node")
    repeats = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    marked = docs.join(repeats, "node", "left_anti").unionByName(docs.join(repeats, "node", "left_semi").dropDuplicates(["node"]))
    nodes = cut(marked.select("node", "doc_id", "size", "sketch"))
    prefixed = marked.select("node", "size", "small", "prefix")
    rows, keys = prefixed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("prefix") / 8), F.lit(0)).cast("bigint")).first()
    bits = filter_bits(keys, max_bits=max_bits)
    shared = spark.sparkContext.broadcast(filter_of(prefixed, bits, True, lambda batch: np.concatenate([np.zeros(0, np.uint64), *_longs(batch.column(3))]).view(np.int64)))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _longs(batch.column(3))
            n = np.array([len(f) for f in found], np.int64)
            key = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            met = in_filter(shared.value, key, bits)
            yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(np.repeat(batch.column(0).to_numpy(), n)[met]), pa.array(place[met])], ["key", "node", "place"])

    entries = cut(prefixed.mapInArrow(repeated, "key bigint, node bigint, place bigint"))
    # Shingles of the same nodes have one order in all of them, so the first has the least sum of places.
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.sum("place").alias("places")).filter("n > 1")
    firsts = buckets.groupBy("n", "x", "y").agg(F.min_by("key", "places").alias("key"))
    firsts = cut(firsts.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), FEWER)
    chosen = entries.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "key")
    dealt = chosen.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")).join(prefixed.select("node", "size", "small"), "node")
    in_order = lambda entries: entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    columns = ["key", "i", "j", "node", "root", "own", "size", "place", "small"]
    blocks = cut(in_order(dealt.select("*", F.col("own").alias("i"), F.col("own").alias("j"), F.col("node").alias("root"))).select(*columns, "parts"))

    # Fingerprints within a few bits, one node of each; the others of a fingerprint meet that node.
    heads_of = cut(heads.groupBy("fp").agg(F.min("node").alias("head")), FEWER)
    ends = links(heads_of.select("fp"))
    for side in ("a", "b"):
        ends = ends.join(heads_of.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    same = heads.join(heads_of, "fp").filter("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    close = ends.select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).unionByName(same)

    likely = cut(blocks.select(*columns).mapInArrow(proposals(True, similarity), "a bigint, b bigint").unionByName(close).distinct(), FEWER)
    near = verified(likely, source, nodes, similarity, words)
    roots = components(near)
    rooted = _follow(blocks, roots, "root")
    whole = rooted.filter("parts = 1").select(*columns)
    if roots.count() > BROADCAST_ROWS:  # a join by shuffle has left no order
        whole = in_order(whole)
    found = whole.mapInArrow(proposals(False, similarity), "a bigint, b bigint")
    if not firsts.filter("parts > 1").isEmpty():
        large = rooted.filter("parts > 1")
        still = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        pieces = large.join(still, "key", "left_semi").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = pieces.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).select(*columns)
        found = found.unionByName(in_order(met).mapInArrow(proposals(False, similarity), "a bigint, b bigint"))
    others = cut(found.distinct().join(likely, ["a", "b"], "left_anti"), FEWER)
    roots = components(near.unionByName(verified(others, source, nodes, similarity, words)))

    rooted = cut(_follow(heads.withColumn("root", F.col("node")), roots, "root"), FEWER)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).filter("n > 1")
    of = cut(rooted.select("node", "root", F.col("n").alias("copies")).join(groups.select("root", "component_id"), "root").select("node", "component_id", "copies"), FEWER)
    copies = [r[0] for r in of.filter(F.col("copies") > max(50, rows // HOT_SHARE)).select("node").collect()]
    return join_hot(docs.select("doc_id", "node"), of.drop("copies"), "node", copies).select("doc_id", "component_id")


def keep_one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows whose id is the smallest of their component of similar texts, with all their columns; null ids stay."""
    groups = similar_groups(df, similarity, doc_id, text, words)
    gone = cut(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), FEWER)
    return without_ids(df, gone, doc_id)
