"""Edit events as streams: bursts, first-seen values, records, retention and running summaries.

Each has a batch twin in ``operators.windows``; the stream's result is the
batch's without what is still open at the last watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, time: str, late: str) -> DataFrame:
    """Events with a timestamp column and a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def debounce(edits: DataFrame, key: list[str], time: str, before: str, after: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """One row per burst of edits of a field, when the watermark passes its gap: the first before-value, the last after-value, unless equal."""
    order = F.struct(time, before)
    bursts = event_time(edits, time, late).groupBy(*key, F.session_window(time, gap).alias("burst")).agg(F.min_by(before, order).alias("before"), F.max_by(after, order).alias("after"), F.count(F.lit(1)).alias("edits"))
    return bursts.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*key, F.col("burst.start").alias("started"), "before", "after", "edits")


def first_seen(events: DataFrame, key: list[str], time: str, late: str | None = None) -> DataFrame:
    """The first event of each key to arrive; with ``late``, keys may come again after that time and state is bounded."""
    if late is None:
        return events.dropDuplicates(key)
    return event_time(events, time, late).dropDuplicatesWithinWatermark(key)


def summary(events: DataFrame, time: str, window: str, action: str, edit: str, amount: str, late: str = "10 minutes") -> DataFrame:
    """Counts of actions and edits, and the amount edited, by tumbling window."""
    hit = F.col(action) == edit
    out = event_time(events, time, late).groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("actions"), F.count_if(hit).alias("edits"), F.round(F.sum(F.when(hit, F.col(amount))), 4).alias("amount"))
    return out.select(F.col("w.start").alias("started"), "actions", "edits", "amount")


def split_records(pages: DataFrame, key: str, ordinal: str, page: str) -> DataFrame:
    """Number the records of each key's page stream: page 1, or a page the record has, begins the next. Rows of a micro-batch are taken in order."""
    kind = dict(pages.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record, seen = state.get if state.exists else (0, [])
        seen = set(seen)
        rows = pd.concat(list(batches)).sort_values(ordinal)
        numbers = []
        for p in rows[page]:
            if record == 0 or p == 1 or p in seen:
                record, seen = record + 1, set()
            seen.add(int(p))
            numbers.append(record)
        state.update((record, sorted(seen)))
        yield pd.DataFrame({key: [k[0]] * len(rows), ordinal: rows[ordinal].to_numpy(), "record": numbers})

    return pages.select(key, ordinal, page).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {ordinal} {kind[ordinal]}, record int", "record int, seen array<bigint>", "append", GroupStateTimeout.NoTimeout)


def retain(events: DataFrame, key: str, ordinal: str, most: int) -> DataFrame:
    """After each micro-batch, how many events of a key are held and the oldest of them: the state is its latest ``most`` ordinals."""
    kind = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted([*held, *map(int, batch[ordinal])])[-most:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "held": [len(held)], "oldest": [held[0]]})

    return events.select(key, ordinal).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, held int, oldest bigint", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)


def of_token(events: DataFrame, token: str, own: str | Column) -> DataFrame:
    """Only a user's own events, for validly formed tokens."""
    return events.filter((F.col(token) == own) & F.col(token).rlike("^[0-9a-f]{8,64}$"))


def held_by_token(events: DataFrame, token: str) -> DataFrame:
    """How many events each validly formed token holds."""
    return events.filter(F.col(token).rlike("^[0-9a-f]{8,64}$")).groupBy(token).agg(F.count(F.lit(1)).alias("held"))


def purged(events: DataFrame, token: str, own: str | Column) -> DataFrame:
    """What stays when all other tokens' events are purged; events without a token are nobody's and stay."""
    return events.filter(F.col(token).isNull() | (F.col(token) == own))


def migrated(events: DataFrame, token: str, own: str | Column) -> DataFrame:
    """Events from before there were tokens, given to the one that is in use."""
    return events.withColumn(token, F.coalesce(token, F.lit(own) if isinstance(own, str) else own))


def flush(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int | None = None) -> None:
    """Take in all that has arrived, write what is finished and stop: before an export, nothing is pending that could be written.

    Bursts still open at the last watermark stay in the checkpoint's state and come with the next flush.
    """
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.exception() is not None:
        raise query.exception()
