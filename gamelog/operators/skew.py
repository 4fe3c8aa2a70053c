"""Finding keys that hold more rows than one task should, and setting them apart.

A key is named by the hash of its columns. A hash shared by two keys only sets one key more
apart: the plans for ordinary and for hot keys give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys looked for, and counters kept per task and group while looking: both fixed, so what
# detection holds and returns does not grow with the data.
MOST_HOT = 64
TRACKED = 1024


class HotKeys(list):
    """Hot keys, and the rows of the table they were looked for in (None if not counted)."""

    def __init__(self, keys: Iterable[int] = (), rows: int | None = None) -> None:
        super().__init__(keys)
        self.rows = rows


def rows_behind(hot: Sequence[int]) -> int | None:
    """The rows of the table that ``hot`` was found in, if known."""
    return getattr(hot, "rows", None)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality: a NULL key is a group of its own, as in a group-by."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def key_hash(keys: Sequence[str | Column]) -> Column:
    return F.xxhash64(*keys)


def heavy_hitters(key: Column, most: int = MOST_HOT) -> Column:
    """Aggregate: the most frequent hashes and their counts, approximate in bounded space."""
    return F.call_function("approx_top_k", key, F.lit(most), F.lit(TRACKED))


def hot_among(counts: Mapping[int, int], rows: int, share: float) -> HotKeys:
    """The keys that have more than ``share`` of the rows, most frequent first."""
    return HotKeys([key for key, n in sorted(counts.items(), key=lambda item: -item[1]) if n > share * rows][:MOST_HOT], rows)


def task_share(spark: SparkSession) -> float:
    """The share of a table's rows that one task gets."""
    return 1 / max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys_of(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], share: float | None = None
) -> dict[str, list[int]]:
    """The hot keys of each ``{name: (table, key columns)}``, in one job over the key columns.

    Hot is a key with more than a task's share of its table's rows, whatever their number
    (or with more than ``share`` of them). Names that give the same table share its scan.
    Counts are approximate (heavy hitters in bounded space); a key they miss or overrate is
    only placed in the other plan. Each result knows its table's rows, which are exact.
    """
    if not tables:
        return {}
    scans: dict[int, tuple[DataFrame, dict[str, Sequence[str]]]] = {}
    for name, (df, keys) in tables.items():
        scans.setdefault(id(df), (df, {}))[1][name] = keys
    width = max(len(sets) for _, sets in scans.values())
    parts = []
    for at, (df, sets) in enumerate(scans.values()):
        keys = [key_hash(k).alias(f"_key{i}") for i, k in enumerate(sets.values())]
        keys += [F.lit(None).cast("long").alias(f"_key{i}") for i in range(len(sets), width)]
        parts.append(df.select(F.lit(at).alias("_table"), *keys))
    tops = [heavy_hitters(F.col(f"_key{i}")).alias(f"top{i}") for i in range(width)]
    counted = reduce(DataFrame.unionAll, parts).groupBy("_table").agg(*tops, F.count(F.lit(1)).alias("n"))
    found = {row["_table"]: row for row in counted.collect()}
    share = task_share(parts[0].sparkSession) if share is None else share
    hot: dict[str, list[int]] = {name: HotKeys(rows=0) for name in tables}
    for at, (_, sets) in enumerate(scans.values()):
        for i, name in enumerate(sets if at in found else ()):
            counts = {item["item"]: item["count"] for item in found[at][f"top{i}"]}
            hot[name] = hot_among(counts, found[at]["n"], share)
    return hot


def hot_keys(df: DataFrame, keys: Sequence[str], share: float | None = None) -> list[int]:
    """The hot keys of one table, for the ``hot`` argument of the operators."""
    return hot_keys_of({"table": (df, keys)}, share)["table"]


def split_hot(df: DataFrame, keys: Sequence[str], hot: Sequence[int]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of the given hot keys or None); together all of ``df``."""
    if not hot:
        return df, None
    is_hot = key_hash(keys).isin(*hot)
    return df.where(~is_hot), df.where(is_hot)
