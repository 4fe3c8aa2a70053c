"""Model input: the columns a forecast is built on, and the next-game target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.operators.columns import align_columns, present_columns
from gamelog.operators.series import lead_value
from gamelog.plans.feature_set import series_order

TARGET = "next_PIR"
ID_COLUMNS = ("Season", "Phase", "Round", "Gamecode", "Player_ID")

# Model input names, in order. Those that no feature set produces are
# constants in the model input; align_columns reports which.
MODEL_FEATURES = (
    "true_shooting_percentage",
    "points_per_shot_right",
    "free_throw_rate",
    "offensive_rebound_rate_right",
    "defensive_rebound_rate_right",
    "assist_rate_right",
    "steal_rate_right",
    "block_rate_right",
    "turnover_rate_right",
    "usage_rate_right",
    "game_score",
    "floor_percentage",
    "shot_quality_index",
    "avg_shot_distance",
    "shot_distance_variation",
    "court_coverage_area",
    "unique_scoring_zones",
    "shot_angle_spread",
    "effective_fg_percentage",
    "close_shot_percentage",
    "mid_range_percentage",
    "long_range_percentage",
    "fastbreak_fg_percentage",
    "second_chance_fg_percentage",
    "avg_play_impact",
    "total_play_impact",
    "clutch_play_impact",
    "best_impact_sequence",
    "worst_impact_sequence",
    "game_volatility",
    "close_game_time_ratio",
    "super_clutch_plays",
    "super_clutch_scores",
    "close_game_impact_plays",
    "consecutive_positive_plays",
    "minutes_ma3",
    "minutes_ma5",
    "minutes_ma10",
    "points_ma3",
    "points_ma5",
    "points_ma10",
    "pir_ma3",
    "pir_ma5",
    "pir_ma10",
    "usage_rate_ma3",
    "usage_rate_ma5",
    "net_contribution_ma3",
    "net_contribution_ma5",
    "scoring_efficiency_ma3",
    "scoring_efficiency_ma5",
    "pir_median_ma5",
    "pir_std5",
    "consistency_score",
    "trend_indicator",
    "recent_form",
    "pir_vs_season_avg",
    "pir_ewm",
    "points_ewm",
    "net_contribution_ewm",
    "minutes_played",
    "Points",
    "ast_to_turnover",
    "fg_percentage",
)


def with_next_game(
    features: DataFrame, scope: str = "player", hot: Sequence[int] = ()
) -> DataFrame:
    """Add the rating of the player's next game; rows without a next game are dropped.

    With scope ``"player"`` the last game of a season is followed by the first of the
    next; with ``"season_player"`` it has no next game.
    """
    keys = {"player": ["Player_ID"], "season_player": ["Season", "Player_ID"]}[scope]
    order = ["Season", *series_order(features)]
    led = lead_value(features, keys, order, "PIR", TARGET, hot)
    return led.where(F.col(TARGET).isNotNull())


def training_set(
    features: DataFrame,
    names: Sequence[str] = MODEL_FEATURES,
    scope: str = "player",
    hot: Sequence[int] = (),
) -> tuple[DataFrame, list[str]]:
    """Feature rows with target and all model columns, and the columns made up as 0."""
    return align_columns(with_next_game(features, scope, hot), names)


def scoring_set(
    features: DataFrame, names: Sequence[str] = MODEL_FEATURES
) -> tuple[DataFrame, list[str]]:
    """Model columns, identifiers and the current rating, and the columns made up as 0."""
    aligned, made_up = align_columns(features, names)
    return aligned.select(*present_columns(aligned, [*names, *ID_COLUMNS, "PIR"])), made_up
