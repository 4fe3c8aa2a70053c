"""Mergeable sketches: approximate distinct counts and quantiles, stored once per key.

The exact measures need all rows of a group together. Sketches of small groups are stored
beside them and merged to any coarser grain (player, season, everything) without the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the distinct sketch's slots: counts are off by 1.6 per cent (one standard deviation).
DISTINCT_BITS = 12
#: Size of the quantile sketch. Ranks of its answers are off by at most ``RANK_ERROR`` of the
#: rows with 99 per cent confidence, at any number of rows and after any number of merges.
QUANTILE_SIZE = 200
RANK_ERROR = 0.0165


def sketched(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], quantiles: Mapping[str, str]) -> DataFrame:
    """One row per key: its rows ``n`` and ``{name: column}`` sketches, combined map-side."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.hll_sketch_agg(c, F.lit(DISTINCT_BITS)).alias(name) for name, c in distinct.items()],
        *[F.max(F.col(c).isNull()).alias(f"{name}_null") for name, c in distinct.items()],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_SIZE)).alias(name) for name, c in quantiles.items()],
    )


def merged(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """The sketches of a coarser grain, from those of a finer one."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.hll_union_agg(name).alias(name) for name in distinct],
        *[F.max(f"{name}_null").alias(f"{name}_null") for name in distinct],
        *[F.kll_merge_agg_double(name, F.lit(QUANTILE_SIZE)).alias(name) for name in quantiles],
    )


def distinct_estimate(name: str):
    """Distinct values of a sketched column, NULL counted as one of them."""
    return F.hll_sketch_estimate(name) + F.col(f"{name}_null").cast("long")


def quantile_estimate(name: str, q: float):
    """The value at rank ``q`` (0 to 1); NULL without known values."""
    known = F.kll_sketch_get_n_double(name) > 0
    return F.when(known, F.kll_sketch_get_quantile_double(name, F.lit(q)))
