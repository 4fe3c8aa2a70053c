"""Landing, reading and listing tables, on a fresh folder."""

import json
from pathlib import Path

import pytest
from helpers import TINY
from helpers import assert_same, box_table, rows_of
from pyspark.sql import functions as F

from gamelog.plans import matrix
from gamelog.sources import catalog, samples


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    """A store with two seasons landed, the event plays of one season empty."""
    root = str(tmp_path_factory.mktemp("store"))
    sources = {
        season: {name: df.where(F.col("Season") == season) for name, df in tables.items()}
        for season in (2023, 2024)
    }
    sources[2024]["quarter_data"] = box_table(spark, []).select("Season", "Gamecode")
    return root, catalog.land_seasons(spark, sources, root)


def test_landing_skips_empty_tables(store):
    root, manifest = store
    landed = {(r.Season, r.table_name) for r in manifest.collect()}
    assert landed == {(s, t) for s in (2023, 2024) for t in catalog.FEATURE_TABLES}
    assert not Path(root, "quarter_data").exists()


def test_manifest_file(store, tmp_path):
    _, manifest = store
    catalog.write_manifest(manifest, str(tmp_path / "manifest"))
    lines = [l for f in (tmp_path / "manifest").glob("*.json") for l in f.read_text().splitlines()]
    assert len(lines) == 6 and {"Season", "table_name", "path", "n_rows"} == set(json.loads(lines[0]))
    assert all(json.loads(line)["n_rows"] > 0 for line in lines)


def test_round_trip_of_a_table(spark, store, tables):
    root, _ = store
    for name, df in tables.items():
        assert_same(catalog.read_table(spark, root, name), df)


def test_seasons_prune_partitions(spark, store):
    root, _ = store
    df = catalog.read_table(spark, root, "shot_data", ["2024"])
    assert df.inputFiles() and all("/Season=2024/" in f for f in df.inputFiles())
    assert {r.Season for r in df.select("Season").distinct().collect()} == {2024}


def test_unknown_and_missing_tables(spark, store, tmp_path):
    root, _ = store
    with pytest.raises(ValueError, match="lineups"):
        catalog.read_table(spark, root, "lineups")
    with pytest.raises(FileNotFoundError, match="quarter_data"):
        catalog.read_table(spark, root, "quarter_data")
    with pytest.raises(FileNotFoundError):
        catalog.read_seasons(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="shot_data.*2031"):
        catalog.read_table(spark, root, "shot_data", [2024, 2031])
    with pytest.raises(FileNotFoundError, match="build it first"):
        catalog.read_features(spark, str(tmp_path / "features"))


def test_persisted_table(spark, store):
    root, _ = store
    kept = catalog.read_table(spark, root, "playbyplay", keep=True)
    assert kept.is_cached
    kept.unpersist()


def test_union_needs_the_same_columns(tables):
    box = tables["player_stats"]
    halves = [box.where("Season = 2023"), box.where("Season = 2024")]
    assert_same(catalog.union_seasons(halves), box)
    with pytest.raises(Exception, match="Team"):
        catalog.union_seasons([box, box.drop("Team")]).collect()


def test_build_writes_all_seasons(spark, store, tables, tmp_path):
    root, _ = store
    config = matrix.FeatureConfig(root, str(tmp_path), ["2023", "2024"])
    path = matrix.build_features(spark, config)
    built = catalog.read_features(spark, path)
    assert_same(built, matrix.feature_matrix(tables))
    assert {p.name for p in Path(path).glob("write=*/Season=*")} == {"Season=2023", "Season=2024"}

    # Building one season again replaces that season only.
    again = matrix.FeatureConfig(root, str(tmp_path), [2024], exclude_ids=["Total"])
    matrix.build_features(spark, again)
    totals = tables["player_stats"].where("Player_ID = 'Total' and Season = 2024").count()
    assert totals and catalog.read_features(spark, path).count() == tables["player_stats"].count() - totals

    fewer = matrix.FeatureConfig(root, str(tmp_path), [2024], ["combined_stats"])
    with pytest.raises(ValueError, match="columns differ"):
        matrix.build_features(spark, fewer)


def test_season_argument_equals_that_season(tables):
    both = matrix.feature_matrix(tables).where("Season = 2024")
    assert rows_of(matrix.feature_matrix(tables, season="2024")) == rows_of(both)


def test_listing_files_and_columns(spark, store):
    root, _ = store
    files = catalog.list_parquet_files(spark, root)
    assert files.count() >= 6 and files.where("length <= 0").count() == 0
    columns = catalog.table_columns(spark, {"shots": next(str(p) for p in Path(root, "shot_data").glob("write=*"))})
    got = [(r.column_name, r.column_type) for r in columns.orderBy("position").collect()]
    assert got[0] == ("ID_PLAYER", "string") and got[-1] == ("Season", "int")


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "name string, v double")
    assert catalog.write_report_files(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r.json")).collect()[0].v == 1.5
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == ["name", "v"]
    assert not catalog.write_report_files(df.where("v > 9"), str(tmp_path / "none"))
    assert not (tmp_path / "none.json").exists()


def test_counts_per_season(spark):
    tables = samples.game_tables(spark, TINY)
    rows = catalog.season_counts(tables).collect()
    assert sum(r.n_rows for r in rows if r.table_name == "shot_data") == 6000
