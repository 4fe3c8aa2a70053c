"""Form features of new rounds from carried state, without going through the rounds before.

What the windows of a player's series need of the past is small: the last rows that a frame
can reach, and two decayed sums per weighted mean. This state is one row per player and
season. New games are appended to it; a player for whom a game of an old round arrives late
is worked out again from the whole season.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.scalars import ratio
from gamelog.operators.series import ewm_horizon, rolling
from gamelog.operators.skew import same_keys
from gamelog.plans import boxscore
from gamelog.plans.feature_set import series_order

KEYS = list(boxscore.SERIES_KEYS)
REACH = max(boxscore.WINDOW_SIZES) - 1
#: What frames look at, and the weighted means with the column each one averages.
VALUES = ("minutes_played", "Points", "PIR")
WEIGHTED = {"pir_ewm": "PIR", "points_ewm": "Points"}
DECAY = 1.0 - boxscore.EWM_ALPHA


@dataclass(frozen=True)
class Advance:
    """What new rows change: features to add, the state afterwards, and the series (season,
    player) whose stored features are replaced as a whole."""

    features: DataFrame
    state: DataFrame
    replaced: DataFrame


def _position(rows: DataFrame) -> Column:
    return F.struct(*series_order(rows))


def _sums(name: str) -> tuple[str, str]:
    return f"_x_{name}", f"_w_{name}"


def _state_of(rows: DataFrame) -> DataFrame:
    """(keys, tail, last, sums): the state after rows that carry their sums."""
    order = series_order(rows)
    kept = F.array_sort(F.collect_list(F.struct(*order, *VALUES)))
    newest = [F.max_by(c, _position(rows)).alias(c) for name in WEIGHTED for c in _sums(name)]
    return (
        rows.groupBy(*KEYS)
        .agg(kept.alias("tail"), F.max(_position(rows)).alias("last"), *newest)
        .withColumn("tail", F.slice("tail", F.greatest(F.lit(1), F.size("tail") - (REACH - 1)), F.lit(REACH)))
    )


def form_state(box: DataFrame) -> DataFrame:
    """The state after all rows of a box-score table: one row per season and player.

    Only the rows within reach of the sums (weights below 1e-19 are invisible) and the last
    ones are kept of each series before they are collected.
    """
    rows = boxscore.add_shooting(box)
    backwards = Window.partitionBy(*KEYS).orderBy(*[F.desc_nulls_last(c) for c in series_order(rows)])
    near = rows.withColumn("_back", F.row_number().over(backwards) - 1).where(F.col("_back") <= 2 * ewm_horizon(boxscore.EWM_ALPHA))
    weight = F.pow(F.lit(DECAY), F.col("_back"))
    whole = Window.partitionBy(*KEYS)
    for name, source in WEIGHTED.items():
        x, w = _sums(name)
        near = near.withColumn(x, F.coalesce(F.sum(F.col(source).cast("double") * weight).over(whole), F.lit(0.0)))
        near = near.withColumn(w, F.coalesce(F.sum(F.when(F.col(source).isNotNull(), weight)).over(whole), F.lit(0.0)))
    return _state_of(near.where(F.col("_back") < REACH))


def _appended(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of new rows that all come after the state, and the state after them."""
    rows = boxscore.add_shooting(new)
    columns, order = rows.columns, series_order(rows)
    sums = [c for name in WEIGHTED for c in _sums(name)]
    known = state.select(*KEYS, *sums, F.explode("tail").alias("_row")).select(*KEYS, *sums, "_row.*", F.lit(True).alias("_known"))
    together = rows.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    series = Window.partitionBy(*KEYS).orderBy(*order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEYS)
    forms = {}
    for n in boxscore.WINDOW_SIZES:
        for prefix, source in (("minutes", "minutes_played"), ("Points", "Points"), ("pir", "PIR")):
            forms[f"{prefix}_ma{n}"] = rolling(F.col(source), series, n, "mean")
        forms[f"pir_std_ma{n}"] = rolling(F.col("PIR"), series, n, "std")
    formed = together.withColumns(forms).withColumn("_j", F.sum(F.when(F.col("_known"), 0).otherwise(1)).over(so_far))
    # the sums of the state, decayed, and the terms since: growing powers keep one running sum per column
    growth, shrink = F.pow(F.lit(DECAY), -F.col("_j")), F.pow(F.lit(DECAY), F.col("_j"))
    for name, source in WEIGHTED.items():
        for column, term in zip(_sums(name), (F.col(source).cast("double"), F.when(F.col(source).isNotNull(), 1.0))):
            fresh = F.sum(F.when(~F.col("_known"), term * growth)).over(so_far)
            before = F.coalesce(F.max(column).over(whole), F.lit(0.0))
            formed = formed.withColumn(f"_now{column}", shrink * (before + F.coalesce(fresh, F.lit(0.0))))
    formed = formed.drop(*sums).withColumnsRenamed({f"_now{c}": c for c in sums})
    means = {name: ratio(*[F.col(c) for c in _sums(name)]) for name in WEIGHTED}
    features = formed.where(~F.col("_known")).withColumns(means).withColumn("recent_form", F.col("pir_ma3") - F.col("pir_ma10"))
    return features.select(*columns, *forms, *means, "recent_form"), _state_of(formed)


def advance(state: DataFrame, new: DataFrame, history: DataFrame) -> Advance:
    """Features of newly arrived box-score rows.

    ``history`` is the box score with the new rows; it is read only for the series that must
    be worked out again: those with a new row before the last one of the state, and those
    with more new rows than the growing powers of the sums bear.
    """
    counted = new.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min(_position(new)).alias("_first"))
    known = state.select(*KEYS, "last")
    met = counted.join(known, same_keys(counted, known, KEYS), "left").select(*[counted[k] for k in KEYS], "_n", "_first", "last")
    again = met.where((F.col("_first") <= F.col("last")) | (F.col("_n") > ewm_horizon(boxscore.EWM_ALPHA))).select(*KEYS)
    apart = lambda df, how: df.join(again, same_keys(df, again, KEYS), how)
    appended, after = _appended(apart(state, "left_anti"), apart(new, "left_anti"))
    whole = apart(history, "left_semi")
    rebuilt = boxscore.add_box_features(whole)
    features = appended.unionByName(rebuilt.select(*appended.columns))
    return Advance(features, after.unionByName(form_state(whole)), again)


def merged(stored: DataFrame, step: Advance) -> DataFrame:
    """Stored features with a step's rows: new ones added, replaced series swapped."""
    kept = stored.join(step.replaced, same_keys(stored, step.replaced, KEYS), "left_anti")
    return kept.unionByName(step.features.select(*stored.columns))
