"""Exchanges with as many tasks as the rows need.

A session's number of shuffle partitions is fixed, so the rows of one task, and what it
sorts, would grow with the input. Tables of known size are dealt out in more parts instead;
small ones are left to the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

#: Rows that a task should sort or group at most.
ROWS_EACH = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))


def spread(df: DataFrame, keys: Sequence[str | Column], rows: int | None) -> DataFrame:
    """``df`` dealt out by the keys if its rows (None: unknown) are too many for the session's parts."""
    spark = df.sparkSession
    if rows is None or rows <= ROWS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks_for(spark, rows), *keys)
