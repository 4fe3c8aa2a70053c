"""Tables of several seasons are computed once to be landed."""

from pyspark.sql import functions as F

from gamelog.operators.skew import key_hash
from gamelog.sources import catalog, versions

ROWS = [(2023, "a", 1, 5), (2023, "a", 2, 6), (2024, "b", 1, 7), (2025, "c", 1, 8), (None, "d", 1, 9)]


def test_a_table_is_computed_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            read.add(1)
            yield row

    plain = spark.sparkContext.parallelize(ROWS, 2).mapPartitions(count)
    box = spark.createDataFrame(plain, "Season int, Player_ID string, Gamecode int, Points int")
    manifest = catalog.land_tables(spark, {"player_stats": box}, str(tmp_path), [2023, 2024, 2026])
    assert read.value == len(ROWS)
    assert {(r.Season, r.table_name, r.n_rows) for r in manifest.collect()} == {(2023, "player_stats", 2), (2024, "player_stats", 1)}
    version, seasons = versions.current(spark, f"{tmp_path}/player_stats")
    assert version == 1 and set(seasons) == {2023, 2024}
    key = box.select(key_hash([F.lit(2023), F.lit("a")]).alias("k")).first().k
    assert seasons[2023].heavy["series"] == {key: 2} and sum(seasons[2024].heavy["series"].values()) == 1
    kept = catalog.read_table(spark, str(tmp_path), "player_stats")
    assert {(r.Season, r.Player_ID, r.Gamecode, r.Points) for r in kept.collect()} == set(ROWS[:3])


def test_seasons_without_rows_leave_the_store_as_it_was(spark, tmp_path):
    none = spark.createDataFrame(ROWS, "Season int, Player_ID string, Gamecode int, Points int").where("Season = 2030")
    assert catalog.land_tables(spark, {"player_stats": none}, str(tmp_path), [2023, 2024]).count() == 0
    assert versions.current(spark, f"{tmp_path}/player_stats") == (0, {})
