"""Tables stored bucketed on their keys, so that joins between them need no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def store_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a catalog table at ``path``, one sorted file per bucket of the keys.

    Tables with the same keys and number of buckets are joined on them bucket by bucket.
    An existing table is left alone: storing it again is an error.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("error")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)
