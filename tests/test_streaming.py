"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from quillmend.operators import windows
from quillmend.streaming import edits


@pytest.fixture()
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def finished(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


@pytest.fixture()
def stream(spark, sf_dir, events, tmp_path):
    folder = str(tmp_path / "in")
    events.repartition(1).sortWithinPartitions("event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def test_debounce_is_batch_without_open_bursts(spark, events, stream, tmp_path):
    shape = lambda d: d.select("user_id", "event_type", "ts", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("before"), F.col("value").cast("string").alias("after"))
    batch = windows.debounce(shape(events), ["user_id", "event_type"], "ts", "before", "after", 7200.0)
    got = finished(spark, edits.debounce(shape(stream), ["user_id", "event_type"], "ts", "before", "after", "2 hours"), tmp_path, "bursts")
    want = {tuple(r) for r in batch.select("user_id", "event_type", "before", "after", "edits").collect()}
    seen = {tuple(r) for r in got.select("user_id", "event_type", "before", "after", "edits").collect()}
    last = events.agg(F.max("ts")).first()[0]
    open_ = {tuple(r) for r in batch.filter(F.col("last_at") >= F.lit(last) - F.expr("interval 2 hours 10 minutes")).select("user_id", "event_type", "before", "after", "edits").collect()}
    assert seen <= want and want - seen <= open_ and seen


def test_first_seen(spark, events, stream, tmp_path):
    got = finished(spark, edits.first_seen(stream, ["user_id", "event_type"], "ts"), tmp_path, "seen")
    assert got.count() == events.select("user_id", "event_type").distinct().count()


def test_record_splitter(spark, events, stream, tmp_path):
    page = lambda d: d.select("user_id", "event_id", (F.col("event_id") * 7 % 5 + 1).alias("page"))
    want = {tuple(r) for r in windows.split_records(page(events), "user_id", "event_id", "page").collect()}
    assert {tuple(r) for r in finished(spark, edits.split_records(page(stream), "user_id", "event_id", "page"), tmp_path, "records").collect()} == want


def test_retention(spark, events, stream, tmp_path):
    got = {r["user_id"]: (r["held"], r["oldest"]) for r in finished(spark, edits.retain(stream, "user_id", "event_id", 5), tmp_path, "held", "update").collect()}
    kept = windows.retain(events, "user_id", [F.desc("event_id")], 5).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("m")).collect()
    assert got == {r["user_id"]: (r["n"], r["m"]) for r in kept}


def test_summary(spark, events, stream, tmp_path):
    got = {r["started"]: r["actions"] for r in finished(spark, edits.summary(stream, "ts", "1 day", "event_type", "click", "value"), tmp_path, "days").collect()}
    want = {r["d"]: r["n"] for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[d] == n for d, n in got.items())


def test_flush_writes_what_is_finished(spark, events, stream, tmp_path):
    out = str(tmp_path / "out")
    edits.flush(edits.first_seen(stream.select("user_id", "ts"), ["user_id"], "ts"), out, str(tmp_path / "state"), timeout=120)
    assert spark.read.parquet(out).count() == events.select("user_id").distinct().count()


def test_tokens_are_kept_apart(spark):
    own, other = "ab" * 6, "cd" * 6
    e = spark.createDataFrame([(own, 1), (own, 2), (other, 3), (None, 4), ("bad!", 5)], "token string, n int")
    assert {tuple(r) for r in edits.held_by_token(e, "token").collect()} == {(own, 2), (other, 1)}
    assert sorted(r["n"] for r in edits.purged(e, "token", own).collect()) == [1, 2, 4]
    assert edits.migrated(e, "token", own).filter(F.col("token") == own).count() == 3
