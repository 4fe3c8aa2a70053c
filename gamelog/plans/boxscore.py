"""Box-score features: efficiency of one game, and form over the last games."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.scalars import clock_minutes, floor_at, ratio
from gamelog.operators.ordering import with_sequences
from gamelog.operators.series import add_ewm_means, ewm_reach, rolling
from gamelog.plans.feature_set import FeatureSet, series_order

# Counters of the box score and what they are worth in the rating.
RATING_GAINS = (
    "Points",
    "OffensiveRebounds",
    "DefensiveRebounds",
    "Assistances",
    "Steals",
    "BlocksFavour",
    "FoulsReceived",
)
RATING_LOSSES = ("Turnovers", "BlocksAgainst", "FoulsCommited")
SHOT_COUNTERS = (
    ("FieldGoalsMade2", "FieldGoalsAttempted2"),
    ("FieldGoalsMade3", "FieldGoalsAttempted3"),
    ("FreeThrowsMade", "FreeThrowsAttempted"),
)
FREE_THROW_WEIGHT = 0.44
WINDOW_SIZES = (3, 5, 10)
EWM_ALPHA = 0.3
SERIES_KEYS = ("Season", "Player_ID")
PASSED_ON = ("Season", "Phase", "Round", "Gamecode", "Player_ID", "IsStarter", "Home")


def add_shooting(df: DataFrame) -> DataFrame:
    """Minutes, shooting percentages, true shooting and the performance rating.

    An unknown attempt count is taken as 1 in the percentages, but leaves true
    shooting unknown. The rating is unknown if any counter is.
    """
    (made2, tried2), (made3, tried3), (made1, tried1) = [
        (F.col(made), F.col(tried)) for made, tried in SHOT_COUNTERS
    ]
    tried = (tried2 + tried3 + F.lit(FREE_THROW_WEIGHT) * tried1) * 2
    gains = sum((F.col(c) for c in RATING_GAINS[1:]), F.col(RATING_GAINS[0]))
    losses = sum((F.col(c) for c in RATING_LOSSES[1:]), F.col(RATING_LOSSES[0]))
    misses = (tried2 - made2) + (tried3 - made3) + (tried1 - made1)
    return df.withColumns(
        {
            "minutes_played": clock_minutes(F.col("Minutes")),
            "fg_percentage": ratio(made2 + made3, floor_at(tried2 + tried3)),
            "fg_percentage_2pt": ratio(made2, floor_at(tried2)),
            "fg_percentage_3pt": ratio(made3, floor_at(tried3)),
            "ft_percentage": ratio(made1, floor_at(tried1)),
            "true_shooting_percentage": ratio(F.col("Points"), floor_at(tried, keep_null=True)),
            "PIR": gains - losses - misses,
        }
    )


def add_form(
    df: DataFrame,
    sizes: Sequence[int] = WINDOW_SIZES,
    alpha: float = EWM_ALPHA,
    hot: Sequence[int] = (),
) -> DataFrame:
    """Rolling means and deviations, exponentially weighted means, and their trend."""
    order = series_order(df)

    def add(rows: DataFrame, parts: list[str]) -> DataFrame:
        series = Window.partitionBy(*parts).orderBy(*order)
        columns = {}
        for n in sizes:
            for prefix, source in (("minutes", "minutes_played"), ("Points", "Points"), ("pir", "PIR")):
                columns[f"{prefix}_ma{n}"] = rolling(F.col(source), series, n, "mean")
            columns[f"pir_std_ma{n}"] = rolling(F.col("PIR"), series, n, "std")
        weighted = {"pir_ewm": "PIR", "points_ewm": "Points"}
        return add_ewm_means(rows.withColumns(columns), parts, order, weighted, alpha)

    reach = max(max(sizes) - 1, ewm_reach(alpha))
    weighted = ("pir_ewm", "points_ewm")
    formed = with_sequences(
        df, SERIES_KEYS, order, add, before=reach, carry=weighted, hot=hot
    )
    return formed.withColumn("recent_form", F.col("pir_ma3") - F.col("pir_ma10"))


def add_box_features(df: DataFrame, hot: Sequence[int] = ()) -> DataFrame:
    return add_form(add_shooting(df), hot=hot)


def box_features(df: DataFrame, hot: Sequence[int] = ()) -> DataFrame:
    """The features with the columns identifying a player-game, one row per input row."""
    return make_set(hot).transform(df).select(*PASSED_ON, *FEATURES)


# Names of the features, in order.
FEATURES = (
    "minutes_played",
    "Points",
    "fg_percentage",
    "fg_percentage_2pt",
    "fg_percentage_3pt",
    "ft_percentage",
    "true_shooting_percentage",
    "PIR",
    "pir_ewm",
    "points_ewm",
    "recent_form",
    *[f"{p}_ma{n}" for n in WINDOW_SIZES for p in ("minutes", "Points", "pir", "pir_std")],
)


def make_set(hot: Sequence[int] = ()) -> FeatureSet:
    counters = [c for pair in SHOT_COUNTERS for c in pair]
    return FeatureSet(
        name="combined_stats",
        source="player_stats",
        required=(
            "Season",
            "Player_ID",
            "Gamecode",
            "Round",
            "Minutes",
            *RATING_GAINS,
            *RATING_LOSSES,
            *counters,
        ),
        features=FEATURES,
        rows=partial(add_box_features, hot=hot),
    )
