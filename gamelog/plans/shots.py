"""Shot features: where a player shoots from, and how well, per game."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gamelog.functions.aggregates import share, success_rate
from gamelog.functions.scalars import (
    angle_from_origin,
    distance_from_origin,
    first_match,
    floor_at,
    mentions,
    ratio,
)
from gamelog.operators.quantile import nearest_quantiles
from gamelog.plans.feature_set import KEYS, FeatureSet


@dataclass(frozen=True)
class ShotRules:
    """Thresholds and weights, in the unit of the coordinates."""

    close: float = 3
    long: float = 5
    far: float = 7
    fastbreak_weight: float = 1.3
    second_chance_weight: float = 1.1
    close_weight: float = 1.2
    far_weight: float = 0.8
    other_weight: float = 1.0


# Wordings of the action column.
TWO, THREE, MISSED = "Two Pointer", "Three Pointer", "Missed"

QUARTILES = {"shot_distance_75th": 0.75, "shot_distance_25th": 0.25}
DISTINCT = {"unique_scoring_zones": "ZONE"}


def is_two() -> Column:
    return F.col("ACTION").contains(TWO)


def is_three() -> Column:
    return F.col("ACTION").contains(THREE)


def is_made() -> Column:
    return mentions(F.col("ACTION"), (TWO, THREE)) & ~F.col("ACTION").contains(MISSED)


def shot_points() -> Column:
    return first_match([(is_made() & is_two(), 2), (is_made() & is_three(), 3)], 0)


def shot_angle() -> Column:
    return angle_from_origin(F.col("COORD_X"), F.col("COORD_Y"))


def add_distance(df: DataFrame) -> DataFrame:
    """Flags as integers (bad text fails) and the distance from the basket."""
    return df.withColumns(
        {
            "FASTBREAK": F.col("FASTBREAK").cast("long"),
            "SECOND_CHANCE": F.col("SECOND_CHANCE").cast("long"),
            "shot_distance": distance_from_origin(F.col("COORD_X"), F.col("COORD_Y")),
        }
    )


def shot_quality(rules: ShotRules = ShotRules()) -> Column:
    """A weight for the kind of chance; the first kind that applies counts."""
    distance = F.col("shot_distance")
    return first_match(
        [
            (F.col("FASTBREAK") == 1, rules.fastbreak_weight),
            (F.col("SECOND_CHANCE") == 1, rules.second_chance_weight),
            (distance < rules.close, rules.close_weight),
            (distance > rules.far, rules.far_weight),
        ],
        rules.other_weight,
    )


def distance_bands(rules: ShotRules = ShotRules()) -> dict[str, Column]:
    distance = F.col("shot_distance")
    return {
        "close_shot": distance < rules.close,
        "mid_range": (distance >= rules.close) & (distance < rules.long),
        "long_range": distance >= rules.long,
    }


def shot_measures(rules: ShotRules = ShotRules()) -> dict[str, Column]:
    """Everything but the quartiles and the zones; expects :func:`add_distance`."""
    made, two, three = is_made(), is_two(), is_three()
    weighted_makes = F.count_if(made & two) + F.lit(1.5) * F.count_if(made & three)
    measures = {
        "shot_quality_index": F.avg(shot_quality(rules)),
        "avg_shot_distance": F.avg("shot_distance"),
        "shot_distance_variation": F.stddev_samp("shot_distance"),
        "court_coverage_area": F.stddev_samp("COORD_X") * F.stddev_samp("COORD_Y"),
        "fastbreak_rate": F.avg("FASTBREAK"),
        "second_chance_rate": F.avg("SECOND_CHANCE"),
        "three_point_attempt_rate": share(three),
        "shot_angle_spread": F.stddev_samp(shot_angle()),
        "points_per_shot": F.avg(shot_points()),
        "effective_fg_percentage": ratio(
            weighted_makes, floor_at(F.count_if(two) + F.count_if(three))
        ),
        "fastbreak_fg_percentage": success_rate(made, F.col("FASTBREAK") == 1),
        "second_chance_fg_percentage": success_rate(made, F.col("SECOND_CHANCE") == 1),
    }
    for band, condition in distance_bands(rules).items():
        measures[f"{band}_percentage"] = success_rate(made, condition)
    return measures


def group_shots(df: DataFrame, measures: dict[str, Column], hot: Sequence[int] = ()) -> DataFrame:
    return nearest_quantiles(df, KEYS, "shot_distance", QUARTILES, measures, DISTINCT, hot)


# Names of the features, in order.
FEATURES = (
    "shot_quality_index",
    "avg_shot_distance",
    "shot_distance_variation",
    "court_coverage_area",
    "unique_scoring_zones",
    "fastbreak_rate",
    "second_chance_rate",
    "three_point_attempt_rate",
    "shot_distance_75th",
    "shot_distance_25th",
    "shot_angle_spread",
    "points_per_shot",
    "effective_fg_percentage",
    "close_shot_percentage",
    "mid_range_percentage",
    "long_range_percentage",
    "fastbreak_fg_percentage",
    "second_chance_fg_percentage",
)


def make_set(rules: ShotRules = ShotRules(), hot: Sequence[int] = ()) -> FeatureSet:
    return FeatureSet(
        name="shot_patterns",
        source="shot_data",
        required=(
            *KEYS,
            "FASTBREAK",
            "SECOND_CHANCE",
            "COORD_X",
            "COORD_Y",
            "ZONE",
            "ID_ACTION",
            "ACTION",
        ),
        features=FEATURES,
        rows=add_distance,
        measures=partial(shot_measures, rules),
        group=partial(group_shots, hot=hot),
    )
