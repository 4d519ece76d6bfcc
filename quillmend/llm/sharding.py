"""Shards of near-equal bytes by sampled splitters, in DataFrame functions only.

A record's key is a hash of its text, so equal texts lie together. A sample
drawn with probability proportional to size gives key quantiles as splitters,
which cut the key space into a fixed number of ranges of about equal bytes; a
few draws by rows are added, so that a key with many rows shows in the sample
too, and only such keys are counted. Ranges that turn out overfull are
subdivided by a second hash; keys whose own group is larger than a range (fewer
than there are ranges) are subdivided by id. Each shard takes a contiguous run
of ranges at the byte quantiles, and ranges then move from the fullest to the
emptiest shard while that evens them out. The driver sees the sample and sums
per range, whose number depends on parameters only; nothing but the rows of a
unit shuffles, to be numbered.

Equal texts share a shard unless their group alone exceeds a shard.
Slots are a unit's offset plus the rank inside the unit. A unit of more than
``rows_per_window`` rows is numbered in parts by a hash, whose counts are summed
up in a table of their own. Defined results: a null text has 0 bytes (size 8);
repeated rows each take a slot; a null id sorts first; an empty table gives no
rows; ``shard_records`` keeps all further columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, literal_table, small_batches, text_of

PREFIX_BITS = 12
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Of two dozen expected draws or more, a key with this many is taken for a hot one and counted.
LEAST_DRAWS = 8


def record_size(text: str = "text") -> Column:
    return (F.octet_length(text_of(text)) + 8).cast("bigint")


def splitters(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Keys at the weighted quantiles of a (key, weight) sample; a range is [splitter, next splitter)."""
    sample = sorted(sample)
    total = sum(w for _, w in sample)
    found, passed = [], 0.0
    for key, weight in sample:
        if total and passed >= total * (len(found) + 1) / ranges and (not found or key > found[-1]):
            found.append(key)
        passed += weight
    return found


def prefix_rows(cuts: list[int]) -> dict[str, list[int]]:
    """Ranges of the splitters by the key prefixes they touch, for an equality join: at most ranges + 2**PREFIX_BITS rows."""
    lows = [-(1 << 63), *cuts]
    rows: dict[str, list[int]] = {"prefix": [], "low": [], "high": [], "range": []}
    for i, low in enumerate(lows):
        high = lows[i + 1] - 1 if i + 1 < len(lows) else (1 << 63) - 1
        for prefix in range(low >> (64 - PREFIX_BITS), (high >> (64 - PREFIX_BITS)) + 1):
            for name, value in (("prefix", prefix), ("low", low), ("high", high), ("range", i)):
                rows[name].append(value)
    return rows


def place(units: list[tuple[int, int]], shards: int) -> list[int]:
    """A shard for each (bytes, bundle) unit in key order; units of one bundle stay together.

    Contiguous runs at the byte quantiles first, then the move or swap between
    the fullest and the emptiest shard that leaves them most alike, while any does.
    """
    bundles: dict[int, list[int]] = {}
    for i, (_, bundle) in enumerate(units):
        bundles.setdefault(bundle, []).append(i)
    groups = list(bundles.values())
    sizes = [sum(units[i][0] for i in g) for g in groups]
    total, passed = sum(sizes), 0
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for g, s in enumerate(sizes):
        members[min(shards - 1, (2 * passed + s) * shards // max(1, 2 * total))].append((s, g))
        passed += s
    for m in members:
        m.sort()
    loads = [sum(s for s, _ in m) for m in members]
    for _ in range(60 * shards):
        top, low = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[top] - loads[low]
        best = None
        for back in [None, *members[low]]:
            want = gap / 2 + (back[0] if back else 0)
            at = bisect_left(members[top], (int(want), -1))
            for one in members[top][max(0, at - 1) : at + 1]:
                net = one[0] - (back[0] if back else 0)
                if 0 < net < gap and (best is None or abs(gap - 2 * net) < best[0]):
                    best = (abs(gap - 2 * net), one, back)
        if best is None:
            break
        _, one, back = best
        for give, frm, to in ((one, top, low), (back, low, top)):
            if give:
                members[frm].remove(give)
                members[to].insert(bisect_left(members[to], give), give)
                loads[frm] -= give[0]
                loads[to] += give[0]
    out = [0] * len(units)
    for shard, m in enumerate(members):
        for _, g in m:
            for i in groups[g]:
                out[i] = shard
    return out


@dataclass
class Layout:
    """Where ranges and hot keys go: tables of at most a few times the number of ranges, all from parameters and the input's sums."""

    cuts: list[int]
    hot: list[int]
    parts: dict[int, int]
    units: dict[tuple[int, int], tuple[int, int, int]]  # (range, part) -> shard, offset, windows

    def with_unit(self, rows: DataFrame) -> DataFrame:
        """Add range and part to rows with doc_id and key, by broadcast lookups only."""
        spark = rows.sparkSession
        by_prefix = prefix_rows(self.cuts)
        lookup = literal_table(spark, {f"__{k}": by_prefix[k] for k in ("prefix", "low", "high", "range")})
        first = len(self.cuts) + 1
        hot = literal_table(spark, {"__hot": self.hot, "__hot_range": [first + i for i in range(len(self.hot))]})
        split = literal_table(spark, {"__of": list(self.parts), "__parts": list(self.parts.values())})
        found = rows.withColumn("__at", F.shiftright("key", 64 - PREFIX_BITS))
        found = found.join(F.broadcast(lookup), (F.col("__at") == F.col("__prefix")) & F.col("key").between(F.col("__low"), F.col("__high")))
        found = found.join(F.broadcast(hot), F.col("key") == F.col("__hot"), "left").withColumn("range", F.coalesce("__hot_range", "__range"))
        found = found.join(F.broadcast(split), F.col("range") == F.col("__of"), "left")
        second = F.when(F.col("__hot").isNotNull(), F.xxhash64("doc_id", F.lit("part"))).otherwise(F.xxhash64("key", F.lit("part")))
        return found.withColumn("part", F.pmod(second, F.coalesce("__parts", F.lit(1))).cast("bigint")).select(*rows.columns, "range", "part")

    def located(self, rows: DataFrame) -> DataFrame:
        """Add shard and slot to rows with doc_id, key and size."""
        spark = rows.sparkSession
        names = ("shard", "offset", "windows")
        columns = {"range": [u[0] for u in self.units], "part": [u[1] for u in self.units]} | {f"__{n}": [v[i] for v in self.units.values()] for i, n in enumerate(names)}
        found = self.with_unit(rows).join(F.broadcast(literal_table(spark, columns)), ["range", "part"])
        unit = ["range", "part"]
        if any(v[2] > 1 for v in self.units.values()):
            unit.append("__window")
            found = found.withColumn("__window", F.pmod(F.xxhash64("doc_id", "key", F.lit("window")), F.col("__windows")))
            counts = cut(found.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n")))
            before = W.partitionBy("range", "part").orderBy("__window").rowsBetween(W.unboundedPreceding, -1)
            starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
            found = found.join(F.broadcast(starts) if counts.count() <= BROADCAST_ROWS else starts, unit).withColumn("__offset", F.col("__offset") + F.col("__start"))
        inside = W.partitionBy(*unit).orderBy("key", "doc_id", "size")
        slot = (F.col("__offset") + F.row_number().over(inside) - 1).cast("bigint")
        return found.withColumn("slot", slot).select(*rows.columns, F.col("__shard").cast("int").alias("shard"), "slot")


def layout(keys: DataFrame, shards: int = 24, ranges_per_shard: int = 64, rows_per_window: int = 1 << 20, draws: int = 32) -> Layout:
    """Fit shards to a table with columns doc_id, key and size (no null key or size), which is read four times: cut it before."""
    rows, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * ranges_per_shard
    per_rows, per_bytes = max(1, rows // ranges), max(1, size // ranges)

    # About draws * ranges rows by size and as many by count come to the driver.
    by_size, by_rows = draws * ranges / max(1, size), draws * ranges / max(1, rows)
    drawn = keys.select("key", "size", F.rand(7).alias("u")).filter(F.col("u") < F.col("size") * by_size + by_rows)
    sample = drawn.select("key", F.when(F.col("u") < F.col("size") * by_size, F.greatest(F.lit(1.0), F.col("size") * by_size)).otherwise(0.0).alias("w")).collect()
    cuts = splitters([(k, w) for k, w in sample if w], ranges)
    often = [k for k, n in Counter(r[0] for r in sample).items() if n >= LEAST_DRAWS]
    candidates = literal_table(keys.sparkSession, {"key": often})
    own = keys.join(F.broadcast(candidates), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    hot = sorted((k, n, b) for k, n, b in own.filter(f"n > {2 * per_rows + 8}").collect())  # fewer than ranges

    # How many parts each range needs: hot keys by their counts, other ranges by what fell into them.
    found = Layout(cuts, [h[0] for h in hot], {}, {})
    first = len(cuts) + 1
    for i, (_, n, b) in enumerate(hot):
        found.parts[first + i] = max(1, -(-n // per_rows), -(-b // per_bytes))
    for r, n, b in found.with_unit(keys).groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect():
        if r < first and (n > 2 * per_rows or b > 2 * per_bytes):
            found.parts[r] = max(-(-n // per_rows), min(n, -(-b // per_bytes)))

    sums = sorted(tuple(r) for r in found.with_unit(keys).groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect())
    fits = {first + i for i, (_, _, b) in enumerate(hot) if b <= size // shards}
    where = place([(b, r if r in fits else -1 - i) for i, (r, _, _, b) in enumerate(sums)], shards)
    base = [0] * shards
    for (r, part, n, _), shard in zip(sums, where):
        found.units[r, part] = (shard, base[shard], -(-n // rows_per_window))
        base[shard] += n
    return found


def _keys(df: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("key"), record_size(text).alias("size")]


def shard_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    small_batches(df.sparkSession)
    keys = cut(df.select(*_keys(df, doc_id, text), F.crc32(text_of(text).cast("binary")).alias("text_crc32")))
    found = layout(keys, **how).located(keys)
    return found.select("doc_id", "size", F.col("text_crc32").cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_records(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``df`` with columns shard and slot added (replacing any of these names), for ``write.partitionBy("shard")``.

    Keys are placed first; whole records are then read once and shuffle once, to be numbered.
    """
    small_batches(df.sparkSession)
    kept = df.drop("shard", "slot")
    placed = layout(cut(df.select(*_keys(df, doc_id, text))), **how)
    record = F.struct(*(F.col(f"`{c}`") for c in kept.columns))
    return placed.located(kept.select(*_keys(kept, doc_id, text), record.alias("record"))).select("record.*", "shard", "slot")
