"""What a feature set is, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from gamelog.operators.columns import require_columns

# One player in one game. The season is part of every key: game codes restart each season.
KEYS = ("Season", "Player_ID", "Gamecode")
# The player column of each source table, renamed to Player_ID on the way in.
PLAYER_COLUMN = {
    "player_stats": "Player_ID",
    "shot_data": "ID_PLAYER",
    "playbyplay": "PLAYER_ID",
}


def keyed(df: DataFrame, source: str) -> DataFrame:
    """The source table with its player column under the common name."""
    return df.withColumnRenamed(PLAYER_COLUMN[source], "Player_ID")


def series_order(df: DataFrame) -> list[str]:
    """Game order within a player's season. The game code orders games of one round;
    the team, where known, orders the two team-total rows of one game."""
    return ["Round", "Gamecode"] + [c for c in ("Team",) if c in df.columns]


def group_plainly(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*KEYS).agg(*[column.alias(name) for name, column in measures.items()])


@dataclass(frozen=True)
class FeatureSet:
    """A named group of features over one source table.

    ``rows`` adds columns row by row or over a sequence. ``measures`` are aggregates
    per player and game; a set without measures keeps one output row per input row.
    Sets that share a source and a ``group`` step are computed in one pass.
    """

    name: str
    source: str
    required: tuple[str, ...]
    features: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame] = lambda df: df
    measures: Callable[[], dict[str, Column]] | None = None
    group: Callable[[DataFrame, dict[str, Column]], DataFrame] = group_plainly

    def transform(self, df: DataFrame) -> DataFrame:
        return transform_together([self], df)


def transform_together(sets: Sequence[FeatureSet], df: DataFrame) -> DataFrame:
    """Apply sets of one source in one pass: all row steps, then at most one group-by."""
    for one in sets:
        require_columns(df, one.required)
    for one in sets:
        df = df.transform(one.rows)
    measures = {n: c for one in sets if one.measures for n, c in one.measures().items()}
    if not measures:
        return df
    names = [name for one in sets for name in one.features]
    return sets[0].group(df, measures).select(*KEYS, *names).fillna(0, subset=names)


def chain(steps: Iterable[Callable[[DataFrame], DataFrame]], df: DataFrame) -> DataFrame:
    """Apply transformations one after the other."""
    for step in steps:
        df = df.transform(step)
    return df


class FeatureRegistry:
    """Feature sets by name."""

    def __init__(self) -> None:
        self._sets: dict[str, FeatureSet] = {}

    def register(self, feature_set: FeatureSet) -> None:
        if feature_set.name in self._sets:
            raise ValueError(f"feature set {feature_set.name!r} is already registered")
        self._sets[feature_set.name] = feature_set

    def get(self, name: str) -> FeatureSet:
        if name not in self._sets:
            raise KeyError(f"no feature set named {name!r}")
        return self._sets[name]

    def names(self) -> list[str]:
        return list(self._sets)


