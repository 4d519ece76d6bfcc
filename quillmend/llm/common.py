"""What the operators share: table access, lineage cuts, skew-safe joins, literal tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given directory, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500, read_rows: int = 256) -> None:
    """Keep Arrow batches and those of the Parquet reader small enough for long texts. Read when a plan runs, so it stays set."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(read_rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def cut(df: DataFrame, fewer: int = 1) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    A table much smaller than what it comes from is written in a share, 1/``fewer``, of the shuffle's partitions.
    Only where that is unset and everything runs on one machine, as in tests, a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    if fewer > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // fewer))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def literal_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table of longs from driver lists, built by SQL functions from one literal per column.

    For tables whose size is bounded by a parameter only.
    """
    names = list(columns)
    rows = len(columns[names[0]])
    if not rows:
        return spark.range(0).select(*(F.lit(0).cast("bigint").alias(n) for n in names))
    arrays = [F.split(F.lit(",".join(map(str, columns[n]))), ",").cast("array<bigint>").alias(n) for n in names]
    return spark.range(1, numPartitions=1).select(F.arrays_zip(*arrays).alias("z")).select(F.inline("z")).toDF(*names)


def join_hot(rows: DataFrame, one_per_key: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Inner or left join of many rows to one row per key.

    Rows of hot keys (fewer than HOT_SHARE keys, so a bounded table) stay where
    they are and meet a broadcast; only the others shuffle. Keys are not null.
    """
    if not hot:
        return rows.join(one_per_key, key, how)
    is_hot = F.col(key).isin(hot)
    there = rows.filter(is_hot).join(F.broadcast(one_per_key.filter(is_hot)), key, how)
    return there.unionByName(rows.filter(~is_hot).join(one_per_key.filter(~is_hot), key, how))


def without_ids(df: DataFrame, gone: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone`` (one key column, already cut).

    The list is broadcast only if it was counted to be small; else both sides shuffle.
    """
    return df.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, key, "left_anti").select(*df.columns)
