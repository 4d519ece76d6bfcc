"""Tables of a directory, through Spark's reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Rows dealt out by key to some tasks a core, or more for at most about so many rows a task.

    It serves where work on a row costs far more than to move it, or a row becomes many: a small file
    is one task otherwise, and AQE joins small partitions unless their number is given.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, -(-rows.count() // most)) if most else tasks, key)


def per_value(rows: DataFrame, value: str, made: dict[str, Column]) -> DataFrame:
    """Rows with columns that are made of one column only, worked out once for each of its values."""
    return rows.join(dealt(rows.select(value).distinct(), value).withColumns(made), value, "left")
