"""Play-by-play features: clutch play, play mix, impact, momentum and scoring.

Two feature sets read the same table at the same grain. Their measures are plain
aggregates over the raw columns, so computing both costs one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gamelog.functions.aggregates import (
    distinct_with_null,
    percent_of,
    share,
    total,
    total_where,
)
from gamelog.functions.scalars import first_match, mentions, ratio_or_zero
from gamelog.operators.ordering import with_sequences
from gamelog.operators.series import rolling
from gamelog.plans.feature_set import KEYS, FeatureSet

# Tokens looked for in the play type, per kind of play.
TOKENS = {
    "assist": ("AS",),
    "shot_attempt": ("2FGA", "3FGA"),
    "defensive_play": ("D", "BLK", "ST"),
    "turnover": ("TO",),
    "offensive_rebound": ("O",),
    "defensive_rebound": ("D",),
    "block": ("BLK",),
    "steal": ("ST",),
    "made": ("Made", "FTM"),
    "scoring_attempt": ("2FGA", "3FGA", "FTA"),
    "disruption": ("BLK", "ST"),
}
# Play types that help the team.
POSITIVE = ("2FGM", "3FGM", "FTM", "D", "O", "AS", "ST", "BLK")
# Worth of a play; the first token that matches decides.
IMPACT = (
    ("3FGM", 4.0),
    ("2FGM", 3.0),
    ("AS", 2.0),
    ("ST", 2.0),
    ("BLK", 1.5),
    ("O", 1.2),
    ("D", 1.0),
    ("TO", -1.5),
)
# Points of a made shot.
POINTS = (("2FGM", 2), ("3FGM", 3), ("FTM", 1))


@dataclass(frozen=True)
class PlayRules:
    """How play types are read.

    By default a token matches anywhere in the play type. So ``TO`` also counts as an
    offensive rebound (its ``O``), with that impact, and "made" covers free throws
    but not ``2FGM`` and ``3FGM``. With ``exact`` the play type must equal the token
    and "made" means any made shot.
    """

    exact: bool = False
    tokens: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TOKENS))
    last_quarter: int = 4
    clutch_minute: int = 35
    super_clutch_minute: int = 38
    close_margin: float = 5

    def has(self, *tokens: str) -> Column:
        play = F.col("PLAYTYPE")
        return play.isin(*tokens) if self.exact else mentions(play, tokens)

    def kind(self, name: str) -> Column:
        if self.exact and name == "made":
            return self.has(*[token for token, _ in POINTS])
        return self.has(*self.tokens[name])

    def clutch(self, minute: int) -> Column:
        return (F.col("PERIOD") == self.last_quarter) & (F.col("MINUTE") >= minute)

    def impact(self) -> Column:
        return first_match([(self.has(token), worth) for token, worth in IMPACT], 0.0)

    def points(self) -> Column:
        return first_match([(self.has(token), points) for token, points in POINTS], 0)


def score_margin() -> Column:
    return F.col("POINTS_A").cast("double") - F.col("POINTS_B").cast("double")


def is_positive() -> Column:
    return F.col("PLAYTYPE").isin(*POSITIVE)


def add_momentum(
    df: DataFrame, rules: PlayRules = PlayRules(), hot: Sequence[int] = ()
) -> DataFrame:
    """The impact of each play, of the last three together, and whether a good play follows."""
    order = ["NUMBEROFPLAY"]

    def add(rows: DataFrame, parts: list[str]) -> DataFrame:
        sequence = Window.partitionBy(*parts).orderBy(*order)
        return rows.withColumns(
            {
                "next_is_positive": F.lead(is_positive()).over(sequence),
                "rolling_impact": rolling(F.col("play_impact"), sequence, 3, "sum"),
            }
        )

    valued = df.withColumn("play_impact", rules.impact())
    return with_sequences(valued, KEYS, order, add, before=2, after=1, hot=hot)


def play_measures(rules: PlayRules = PlayRules()) -> dict[str, Column]:
    """Expects :func:`add_momentum`."""
    play = F.col("PLAYTYPE")
    impact = F.col("play_impact")
    clutch = rules.clutch(rules.clutch_minute)
    super_clutch = rules.clutch(rules.super_clutch_minute)
    made = rules.kind("made")
    close = F.abs(score_margin()) <= rules.close_margin
    measures = {
        "clutch_plays": F.count_if(clutch),
        "clutch_scores": F.count_if(clutch & made),
        "super_clutch_plays": F.count_if(super_clutch),
        "super_clutch_scores": F.count_if(super_clutch & made),
        "close_game_impact_plays": F.count_if(close & is_positive()),
        "first_quarter_plays": F.count_if(F.col("PERIOD") == 1),
        "fourth_quarter_plays": F.count_if(F.col("PERIOD") == 4),
        "unique_play_types": distinct_with_null(play),
        "turnover_rate": ratio_or_zero(
            F.lit(100.0) * F.count_if(rules.kind("turnover")),
            F.count_if(rules.kind("shot_attempt")) + F.count_if(rules.kind("assist")),
        ),
        "avg_play_impact": F.avg(impact),
        "total_play_impact": total(impact),
        "clutch_play_impact": total(impact * clutch.cast("int")),
        "game_volatility": F.stddev_samp(score_margin()),
        "close_game_time_ratio": share(close),
        "consecutive_positive_plays": F.count_if(is_positive() & F.col("next_is_positive")),
        "best_impact_sequence": F.max("rolling_impact"),
        "worst_impact_sequence": F.min("rolling_impact"),
    }
    for kind in (
        "assist",
        "shot_attempt",
        "defensive_play",
        "offensive_rebound",
        "defensive_rebound",
        "block",
        "steal",
    ):
        measures[f"{kind}_rate"] = percent_of(rules.kind(kind), play)
    return measures


def matchup_measures(rules: PlayRules = PlayRules()) -> dict[str, Column]:
    points = rules.points()
    close = F.abs(score_margin()) <= rules.close_margin
    return {
        "scoring_efficiency": ratio_or_zero(
            total(points), F.count_if(rules.kind("scoring_attempt"))
        ),
        "points_in_close_games": total_where(points, close),
        "clutch_points": total_where(points, rules.clutch(rules.clutch_minute)),
        "defensive_plays": F.count_if(rules.kind("disruption")),
        "scoring_volatility": F.stddev_samp(points),
        "usage_rate": ratio_or_zero(F.lit(100.0) * total(points), F.count("PLAYTYPE")),
    }


# Names of the features, in order.
PLAY_FEATURES = (
    "clutch_plays",
    "clutch_scores",
    "super_clutch_plays",
    "super_clutch_scores",
    "close_game_impact_plays",
    "first_quarter_plays",
    "fourth_quarter_plays",
    "unique_play_types",
    "assist_rate",
    "shot_attempt_rate",
    "defensive_play_rate",
    "turnover_rate",
    "offensive_rebound_rate",
    "defensive_rebound_rate",
    "block_rate",
    "steal_rate",
    "avg_play_impact",
    "total_play_impact",
    "clutch_play_impact",
    "game_volatility",
    "close_game_time_ratio",
    "consecutive_positive_plays",
    "best_impact_sequence",
    "worst_impact_sequence",
)
# Names of the features, in order.
MATCHUP_FEATURES = (
    "scoring_efficiency",
    "points_in_close_games",
    "clutch_points",
    "defensive_plays",
    "scoring_volatility",
    "usage_rate",
)


def make_play_set(rules: PlayRules = PlayRules(), hot: Sequence[int] = ()) -> FeatureSet:
    return FeatureSet(
        name="playbyplay",
        source="playbyplay",
        required=(
            *KEYS,
            "PERIOD",
            "MINUTE",
            "PLAYTYPE",
            "POINTS_A",
            "POINTS_B",
            "NUMBEROFPLAY",
        ),
        features=PLAY_FEATURES,
        rows=partial(add_momentum, rules=rules, hot=hot),
        measures=partial(play_measures, rules),
    )


def make_matchup_set(rules: PlayRules = PlayRules()) -> FeatureSet:
    return FeatureSet(
        name="position_matchups",
        source="playbyplay",
        required=(*KEYS, "PERIOD", "MINUTE", "PLAYTYPE", "POINTS_A", "POINTS_B"),
        features=MATCHUP_FEATURES,
        measures=partial(matchup_measures, rules),
    )
