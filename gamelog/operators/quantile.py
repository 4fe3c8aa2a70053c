"""Exact quantiles by nearest rank."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.aggregates import distinct_with_null
from gamelog.operators.skew import rows_behind, same_keys, split_hot
from gamelog.operators.spread import spread

#: Bins of a hot group's range of values; the few bins that hold a quantile are ordered.
BINS = 1000


def nearest_rank(q: float, known: Column) -> Column:
    """0-based rank of quantile ``q`` among ``known`` values: halves round up."""
    return F.floor((known - 1) * F.lit(q) + F.lit(0.5))


def add_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``_rank`` (0-based, NULL values last) and ``_known`` for :func:`picked`.

    One exchange and one sort serve any number of quantiles, and a group-by on the
    same keys right after needs no further exchange.
    """
    group = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "_rank": F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1,
            "_known": F.count(value).over(group),
        }
    )


def picked(value: str, q: float) -> Column:
    """Aggregate picking quantile ``q`` after :func:`add_ranks`."""
    return F.max(F.when(F.col("_rank") == nearest_rank(q, F.col("_known")), F.col(value)))


def quantiles_by_position(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """The same quantiles without putting a group into one task. Meant for hot keys.

    Equal values are counted first, map-side. Counts per equally wide bin tell which bin of
    a group holds a rank, and only the distinct values of that bin are ordered.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    spans = counts.groupBy(*keys).agg(F.sum("_n").alias("_known"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    named = spans.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    width = F.col("_high") - F.col("_low")
    place = F.floor((F.col(value) - F.col("_low")) / F.nullif(width, F.lit(0.0)) * BINS)
    binned = counts.join(F.broadcast(named), match).select(
        *keys, value, "_n", "_known", F.coalesce(F.least(place, F.lit(BINS - 1)), F.lit(0)).alias("_bin")
    )
    ranks = F.array(*[F.struct(F.lit(n).alias("_name"), nearest_rank(q, F.col("_known")).alias("_at")) for n, q in quantiles.items()])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        binned.groupBy(*keys, "_known", "_bin")
        .agg(F.sum("_n").alias("_in_bin"))
        .withColumn("_end", F.sum("_in_bin").over(before))
        .select("*", F.explode(ranks).alias("_want"))
        .select(*keys, "_bin", "_want._name", (F.col("_want._at") - F.col("_end") + F.col("_in_bin")).alias("_at"), "_in_bin")
        .where((F.col("_at") >= 0) & (F.col("_at") < F.col("_in_bin")))
        .withColumnsRenamed({k: f"_of_{k}" for k in keys} | {"_bin": "_of_bin"})
    )
    chosen = binned.join(F.broadcast(bins), match & (F.col("_bin") == F.col("_of_bin")))
    within = Window.partitionBy(*keys, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    picked_value = F.min(F.when(F.col("_upto") > F.col("_at"), F.col(value)))
    found = chosen.withColumn("_upto", F.sum("_n").over(within)).groupBy(*keys, "_name").agg(picked_value.alias("_value"))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in quantiles]
    )


def nearest_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    extra: dict[str, Column] | None = None,
    distinct: dict[str, str] | None = None,
    hot: Sequence[int] = (),
) -> DataFrame:
    """Per-key nearest-rank quantiles, ``{name: q}``, plus other aggregates of the group.

    ``extra`` are plain aggregates; ``distinct`` are ``{name: column}`` counts of
    distinct values, NULL counted as one. A group without a known value gets NULL
    quantiles.

    A distinct count as an aggregate would first group everything by key and value,
    with all the other measures in tow. Where groups are small their rows are together
    anyway, so the first row of each value is marked instead: one more sort, no exchange.
    """
    extra, distinct = extra or {}, distinct or {}
    ordinary, apart = split_hot(df, keys, hot)
    ordinary = spread(ordinary, keys, rows_behind(hot))
    others = [column.alias(name) for name, column in extra.items()]
    firsts = {
        f"_first_{name}": F.row_number().over(Window.partitionBy(*keys, c).orderBy(value)) == 1
        for name, c in distinct.items()
    }
    result = (
        add_ranks(ordinary.withColumns(firsts) if firsts else ordinary, keys, value)
        .groupBy(*keys)
        .agg(
            *others,
            *[F.count_if(f"_first_{name}").alias(name) for name in distinct],
            *[picked(value, q).alias(name) for name, q in quantiles.items()],
        )
    )
    if apart is None:
        return result
    others += [distinct_with_null(F.col(c)).alias(name) for name, c in distinct.items()]
    # Every hot group keeps a row, also one without a known value.
    groups = apart.groupBy(*keys).agg(*(others or [F.count(F.lit(1)).alias("_rows")]))
    ranked = quantiles_by_position(apart, keys, value, quantiles)
    joined = groups.join(ranked, same_keys(groups, ranked, keys), "left").select(
        *[groups[k] for k in keys], *[groups[name] for name in (*extra, *distinct)], *quantiles
    )
    return result.unionByName(joined)
