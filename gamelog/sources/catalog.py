"""The tables of a game-log store, by season.

Landed tables are kept in versions (:mod:`gamelog.sources.versions`). Plain folders without a
manifest, ``<root>/<table>/Season=<year>/*.parquet``, are read as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.operators.skew import hot_among, task_share
from gamelog.sources import versions
from gamelog.sources.versions import SEASON

# Tables the features are computed from, and tables that are only landed.
FEATURE_TABLES = ("player_stats", "shot_data", "playbyplay")
LANDED_TABLES = (*FEATURE_TABLES, "quarter_data", "end_quarter_data")
# Keys that windows and ranks of a table are partitioned by; their frequent values are kept
# when a season is landed.
KEY_SETS = {
    "player_stats": {"series": (SEASON, "Player_ID"), "player": ("Player_ID",)},
    "shot_data": {"game": (SEASON, "ID_PLAYER", "Gamecode")},
    "playbyplay": {"game": (SEASON, "PLAYER_ID", "Gamecode")},
}


WRITTEN = f"{SEASON} int, table_name string, path string, n_rows long"


def table_path(root: str, table: str) -> str:
    if table not in LANDED_TABLES:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(LANDED_TABLES)}")
    return f"{root.rstrip('/')}/{table}"


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    seasons: Sequence[int | str] | None = None,
    keep: bool = False,
) -> DataFrame:
    """One table, all seasons or the given ones (partition pruning).

    ``keep`` persists it (memory and disk) for callers that read it several times.
    """
    path = table_path(root, table)
    df = versions.read(spark, path, seasons)
    if df is None and seasons is None:
        df = read_parquet(spark, [path], f"table {table!r}")
    elif df is None:
        # The folders themselves are read, so a season that was never landed is an error.
        parts = [f"{path}/{SEASON}={int(s)}" for s in seasons]
        df = read_parquet(spark, parts, f"table {table!r}, seasons {[int(s) for s in seasons]}", path)
    return df.persist() if keep else df


def read_parquet(spark: SparkSession, paths: Sequence[str], what: str = "table", base: str | None = None) -> DataFrame:
    """Read parquet; a missing path is reported with what was looked for."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no data for {what}: {error.getMessageParameters().get('path', paths)}") from error
        raise


def read_seasons(
    spark: SparkSession, root: str, seasons: Sequence[int | str] | None = None
) -> dict[str, DataFrame]:
    """All tables the features need, as one frame each. Fails if any is missing."""
    return {name: read_table(spark, root, name, seasons) for name in FEATURE_TABLES}


def union_seasons(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack separately landed seasons; the columns must be the same."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def _key_sets(df: DataFrame, table: str) -> dict[str, tuple[str, ...]]:
    columns = {*df.columns, SEASON}
    return {name: keys for name, keys in KEY_SETS.get(table, {}).items() if columns >= {*keys}}


def land_season(df: DataFrame, root: str, table: str, season: int | str) -> tuple[str, int] | None:
    """Replace one season of a raw table; returns its path and rows. An empty one is skipped."""
    files = versions.land(df, table_path(root, table), int(season), _key_sets(df, table))
    return None if files is None else (files.path, files.n_rows)


def landed_hot(
    spark: SparkSession, root: str, seasons: Sequence[int | str] | None = None, share: float | None = None
) -> dict[str, dict[str, list[int]]]:
    """Hot keys ``{table: {key set: hashes}}`` of landed tables, from what was counted while
    they were written: no scan.

    A season's frequent keys are the 64 most frequent ones at most, so a key that is
    moderately frequent in every season may be rated too low; the rows are the same.
    """
    share = task_share(spark) if share is None else share
    found = {}
    for table, key_sets in KEY_SETS.items():
        rows, counts = versions.heavy_keys(spark, table_path(root, table), seasons)
        if rows:
            found[table] = {name: hot_among(counts.get(name, {}), rows, share) for name in key_sets}
    return found


def land_seasons(
    spark: SparkSession,
    sources: dict[int, dict[str, DataFrame]],
    root: str,
) -> DataFrame:
    """Land ``{season: {table: frame}}`` and return the manifest of what was written."""
    written = [
        (int(season), table, *landed)
        for season, tables in sources.items()
        for table, df in tables.items()
        if (landed := land_season(df, root, table, season)) is not None
    ]
    return spark.createDataFrame(written, WRITTEN)


def land_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str, seasons: Sequence[int | str]) -> DataFrame:
    """The same for tables that hold all seasons: each is computed once and written in one go."""
    landed = {name: versions.land_all(df, table_path(root, name), seasons, _key_sets(df, name)) for name, df in tables.items()}
    written = [
        (int(season), table, files[int(season)].path, files[int(season)].n_rows)
        for season in seasons
        for table, files in landed.items()
        if int(season) in files
    ]
    return spark.createDataFrame(written, WRITTEN)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A small listing (seasons x tables), kept as one JSON file."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def season_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per season and table."""
    parts = [
        df.groupBy(SEASON)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(SEASON, F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return union_seasons(parts)


def list_parquet_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every parquet file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length")
    )


def table_columns(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Columns of each table in order, merged over all its files. Footers only."""
    rows = []
    for name, path in paths.items():
        schema = spark.read.option("mergeSchema", "true").parquet(path).schema
        rows += [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema)]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, column_type string"
    )


def write_features(features: DataFrame, path: str) -> None:
    """Write the feature matrix by season; only the seasons present are replaced, all at once.

    All seasons must have the same columns: a matrix whose columns differ from the stored
    ones is refused.
    """
    stored = versions.read(features.sparkSession, path)
    if stored is not None:
        have, new = ({f.name: f.dataType for f in df.schema} for df in (stored, features))
        if have != new:
            differing = sorted(c for c in {*have, *new} if have.get(c) != new.get(c))
            raise ValueError(f"columns differ from the stored seasons at {path}: {differing}")
    versions.replace(features, path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    stored = versions.read(spark, path)
    return read_parquet(spark, [path], "the feature matrix; build it first") if stored is None else stored


def write_report_files(df: DataFrame, path: str) -> bool:
    """Write a result as JSON and CSV (with header); an empty one is skipped.

    The rows are kept while they are written, so they are computed once.
    """
    kept = df.persist()
    some = not kept.isEmpty()
    if some:
        kept.write.mode("overwrite").json(f"{path}.json")
        kept.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    kept.unpersist()
    return some
