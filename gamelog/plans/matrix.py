"""The feature matrix: every feature set joined to the box score."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.operators.skew import hot_keys_of, rows_behind
from gamelog.operators.spread import spread
from gamelog.plans import boxscore, plays, shots
from gamelog.plans.feature_set import (
    KEYS,
    FeatureRegistry,
    FeatureSet,
    keyed,
    transform_together,
)
from gamelog.sources.buckets import read_bucketed, store_bucketed
from gamelog.sources.catalog import SEASON, landed_hot, read_seasons, write_features

log = logging.getLogger(__name__)

BASE = "player_stats"


# The keys that a source's windows and ranks are partitioned by.
SEQUENCE_KEYS = {"player_stats": boxscore.SERIES_KEYS, "shot_data": KEYS, "playbyplay": KEYS}


def find_hot(tables: Mapping[str, DataFrame], sources: Sequence[str] = tuple(SEQUENCE_KEYS)) -> dict[str, list[int]]:
    """The hot keys of each source, for ``hot``: one job over the sources' key columns."""
    wanted = [s for s in sources if s in tables]
    return hot_keys_of({s: (keyed(tables[s], s), SEQUENCE_KEYS[s]) for s in wanted})


# The key sets of landed tables that stand for ``SEQUENCE_KEYS``.
KEPT_AS = {"player_stats": "series", "shot_data": "game", "playbyplay": "game"}


def stored_hot(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], seasons: Sequence[int | str] | None = None) -> dict[str, list[int]]:
    """The same for stored tables: from the counts kept when they were landed, without a job
    over rows; only tables that were not landed here are looked through."""
    known = landed_hot(spark, root, seasons)
    hot = {s: known[s][KEPT_AS[s]] for s in SEQUENCE_KEYS if s in known}
    return hot | find_hot(tables, [s for s in SEQUENCE_KEYS if s not in known])


def default_registry(hot: Mapping[str, Sequence[int]] | None = None) -> FeatureRegistry:
    hot = hot or {}
    registry = FeatureRegistry()
    registry.register(boxscore.make_set(hot.get("player_stats", ())))
    registry.register(shots.make_set(hot=hot.get("shot_data", ())))
    registry.register(plays.make_play_set(hot=hot.get("playbyplay", ())))
    registry.register(plays.make_matchup_set())
    return registry


def choose_sets(registry: FeatureRegistry, names: Sequence[str] | None) -> list[FeatureSet]:
    """The named sets, all of them by default. An unknown name is skipped with a warning."""
    chosen = []
    for name in registry.names() if names is None else names:
        try:
            chosen.append(registry.get(name))
        except KeyError:
            log.warning("no feature set named %r, skipped", name)
    return chosen


def feature_matrix(
    tables: Mapping[str, DataFrame],
    sets: Sequence[str] | None = None,
    registry: FeatureRegistry | None = None,
    season: int | str | None = None,
    exclude_ids: Sequence[str] = (),
    hot: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """One row per box-score row: its raw columns, then the features, unknown ones 0.

    All seasons are computed in one plan; ``season`` restricts it to one, which prunes
    partitions in every source. ``exclude_ids`` leaves players out, e.g. ``("Total",)``
    for the team totals. ``hot`` (see :func:`find_hot`) are keys to split between tasks;
    it belongs to the default registry.
    """
    matrix, *others = matrix_parts(tables, sets, registry, season, exclude_ids, hot)
    return joined_parts(matrix, others, most_rows(hot))


def matrix_parts(
    tables: Mapping[str, DataFrame],
    sets: Sequence[str] | None = None,
    registry: FeatureRegistry | None = None,
    season: int | str | None = None,
    exclude_ids: Sequence[str] = (),
    hot: Mapping[str, Sequence[int]] | None = None,
) -> list[DataFrame]:
    """The box score with its features, then each other source's features by key."""
    chosen = choose_sets(registry or default_registry(hot), sets)
    by_source: dict[tuple, list[FeatureSet]] = {}
    for one in chosen:
        step = one.group if one.measures else None
        by_source.setdefault((one.source, step), []).append(one)

    def source(name: str) -> DataFrame:
        df = keyed(tables[name], name)
        if season is not None:
            df = df.where(F.col(SEASON) == int(season))
        if exclude_ids:
            unwanted = F.coalesce(F.col("Player_ID").isin(*exclude_ids), F.lit(False))
            df = df.where(~unwanted)
        return df

    matrix = source(BASE)
    for (name, step), group in by_source.items():
        if step is None and name == BASE:
            matrix = transform_together(group, matrix)
    return [matrix, *[transform_together(group, source(name)) for (name, step), group in by_source.items() if step is not None]]


def most_rows(hot: Mapping[str, Sequence[int]] | None) -> int | None:
    """The rows of the largest source, where ``hot`` knows them."""
    return max((n for keys in (hot or {}).values() if (n := rows_behind(keys)) is not None), default=None)


def joined_parts(matrix: DataFrame, others: Sequence[DataFrame], rows: int | None = None) -> DataFrame:
    """The parts joined on their keys, in as many tasks as ``rows`` of the largest source need.

    Unknown values become 0 part by part: one projection over all columns of the matrix is a
    method too long to be compiled. Keys are filled last, as an unknown key matches nothing.
    """
    matrix = matrix.fillna(0, subset=_but_keys(matrix))
    if others:
        matrix = spread(matrix, KEYS, rows)
    for features in others:
        names = _but_keys(features)
        _check_new(matrix, names)
        matrix = matrix.join(features, list(KEYS), "left").fillna(0, subset=names)
    return matrix.fillna(0, subset=list(KEYS))


def _but_keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def store_parts(parts: Sequence[DataFrame], name: str, path: str, buckets: int) -> list[str]:
    """Store the parts bucketed on (season, player, game); returns the tables' names.

    The matrix joined from them (:func:`stored_matrix`) exchanges neither side.
    """
    tables = [f"{name}_{i}" for i in range(len(parts))]
    for table, part in zip(tables, parts):
        store_bucketed(part, table, f"{path}/{table}", KEYS, buckets)
    return tables


def stored_matrix(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """The feature matrix from stored parts."""
    matrix, *others = [read_bucketed(spark, table) for table in tables]
    return joined_parts(matrix, others)


def _check_new(matrix: DataFrame, names: Sequence[str]) -> None:
    have = {c.lower() for c in matrix.columns}
    clash = [name for name in names if name.lower() in have]
    if clash:
        raise ValueError(f"features already in the matrix: {clash}")


@dataclass(frozen=True)
class FeatureConfig:
    """Where to read, where to write, and what to compute."""

    data_dir: str
    output_dir: str
    seasons: Sequence[int | str]
    sets: Sequence[str] | None = None
    exclude_ids: Sequence[str] = ()

    @classmethod
    def from_mapping(cls, settings: Mapping[str, object]) -> FeatureConfig:
        missing = [f for f in ("data_dir", "output_dir", "seasons") if f not in settings]
        if missing:
            raise ValueError(f"missing settings: {missing}")
        return cls(
            settings["data_dir"],
            settings["output_dir"],
            settings["seasons"],
            settings.get("transformers"),
            settings.get("exclude_ids", ()),
        )


def build_features(spark: SparkSession, config: FeatureConfig) -> str:
    """Compute the matrix of the configured seasons and write it; returns its path."""
    tables = read_seasons(spark, config.data_dir, config.seasons)
    path = f"{config.output_dir.rstrip('/')}/features"
    hot = stored_hot(spark, config.data_dir, tables, config.seasons)
    write_features(feature_matrix(tables, config.sets, exclude_ids=config.exclude_ids, hot=hot), path)
    return path


def feature_summary(features: DataFrame) -> DataFrame:
    """Number of columns and rows, and the seasons covered."""
    return features.agg(
        F.lit(len(features.columns)).cast("long").alias("n_columns"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(SEASON)).alias("n_seasons"),
        F.min(SEASON).alias("first_season"),
        F.max(SEASON).alias("last_season"),
    )
