"""Versions of season tables, statistics kept while landing, bucketed parts, quarantine and sketches."""

import random

import pytest
from helpers import assert_same, box_table, shot_table
from pyspark.sql import functions as F

from gamelog.functions.scalars import clock_minutes
from gamelog.operators import quarantine, sketches
from gamelog.operators.skew import hot_keys, hot_keys_of
from gamelog.plans import boxscore, dataset, increment, matrix
from gamelog.plans.feature_set import KEYS, keyed
from gamelog.sources import catalog, versions


@pytest.fixture
def landed(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    for season in (2023, 2024):
        for name, df in tables.items():
            catalog.land_season(df.where(F.col("Season") == season), root, name, season)
    return root


def test_a_write_that_dies_leaves_the_old_season(spark, tables, landed, monkeypatch):
    box = tables["player_stats"]

    def die(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions, "commit", die)
        catalog.land_season(box.where("Season = 2024").limit(3), landed, "player_stats", 2024)
    assert_same(catalog.read_table(spark, landed, "player_stats"), box)
    broken = box.where("Season = 2024").withColumn("Points", F.raise_error(F.lit("bad row")).cast("long"))
    with pytest.raises(Exception, match="bad row"):
        catalog.land_season(broken, landed, "player_stats", 2024)
    assert_same(catalog.read_table(spark, landed, "player_stats"), box)


def test_a_season_landed_again_replaces_only_itself(spark, tables, landed):
    box = tables["player_stats"]
    before = versions.current(spark, f"{landed}/player_stats")[1]
    fewer = box.where("Season = 2024 and Player_ID <> 'Total'")
    catalog.land_season(fewer, landed, "player_stats", 2024)
    version, after = versions.current(spark, f"{landed}/player_stats")
    assert version == 3 and after[2023] == before[2023] and after[2024].path != before[2024].path
    assert_same(catalog.read_table(spark, landed, "player_stats"), box.where("Season = 2023").unionByName(fewer))


def test_only_one_writer_commits_a_version(spark, landed):
    root = f"{landed}/player_stats"
    version, seasons = versions.current(spark, root)
    with pytest.raises(Exception, match="(?i)exists"):
        versions.commit(spark, root, version, seasons)


def test_features_are_replaced_all_at_once(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "features")
    rows = boxscore.box_features(tables["player_stats"])
    catalog.write_features(rows, path)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
        catalog.write_features(rows.withColumn("PIR", F.lit(0).cast("long")), path)
    assert_same(catalog.read_features(spark, path), rows)


def test_hot_keys_of_landing_equal_a_detection(spark, tables, landed):
    share = 0.008
    found = catalog.landed_hot(spark, landed, share=share)
    stats = tables["player_stats"]
    want = hot_keys_of({"series": (stats, boxscore.SERIES_KEYS), "player": (stats, ["Player_ID"])}, share)
    assert {k: set(v) for k, v in found["player_stats"].items()} == {k: set(v) for k, v in want.items()}
    assert want["player"]
    for name in ("shot_data", "playbyplay"):
        assert set(found[name]["game"]) == set(hot_keys(keyed(tables[name], name), KEYS, share))


def test_building_from_landed_tables_looks_through_no_rows(spark, landed, tmp_path, tables, monkeypatch):
    monkeypatch.setattr(matrix, "hot_keys_of", lambda sets, *_: pytest.fail("a detection ran") if sets else {})
    path = matrix.build_features(spark, matrix.FeatureConfig(landed, str(tmp_path), [2023, 2024]))
    assert_same(catalog.read_features(spark, path), matrix.feature_matrix(tables))


def test_one_detection_serves_two_key_sets(spark, tables, monkeypatch):
    stats, collected = tables["player_stats"], []
    plain = type(stats).collect
    monkeypatch.setattr(type(stats), "collect", lambda df: collected.append(1) or plain(df))
    both = hot_keys_of({"a": (stats, boxscore.SERIES_KEYS), "b": (stats, ["Player_ID"])}, 0.005)
    assert len(collected) == 1
    monkeypatch.undo()
    assert both == {"a": hot_keys(stats, boxscore.SERIES_KEYS, 0.005), "b": hot_keys(stats, ["Player_ID"], 0.005)}


def test_bucketed_parts_join_without_an_exchange(spark, tables, tmp_path):
    parts = matrix.matrix_parts(tables)
    names = matrix.store_parts(parts, "plain_parts", str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = matrix.stored_matrix(spark, names)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == len(names) - 1 and "Exchange" not in plan
        assert_same(joined, matrix.feature_matrix(tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"drop table {name}")


def test_bad_cells_are_listed_and_become_null(spark, tmp_path):
    clocks = ["10:30", "", "DNP", None, "x:10", "10", "7:1y"]
    box = box_table(spark, [{"Gamecode": i, "Minutes": m} for i, m in enumerate(clocks)])
    parsed = {"minutes_played": ("Minutes", clock_minutes(F.col("Minutes"), strict=False))}
    good, bad = quarantine.write_checked(quarantine.checked(box, parsed), str(tmp_path / "q"), ["Gamecode"])
    got = {r.Gamecode: r.minutes_played for r in good.collect()}
    assert got == {0: 10.5, 1: 0.0, 2: 0.0, 3: 0.0, 4: None, 5: None, 6: None}
    assert {(r.Gamecode, r.column_name, r.text) for r in bad.collect()} == {(i, "Minutes", clocks[i]) for i in (4, 5, 6)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        boxscore.add_shooting(box).select("minutes_played").collect()


def test_lenient_casts_in_place(spark):
    rows = quarantine.checked(shot_table(spark, [{"f": "1"}, {"f": "no"}, {"f": None}]), quarantine.casts({"FASTBREAK": "int"}))
    assert sorted(r.FASTBREAK for r in quarantine.good_rows(rows).where("FASTBREAK is not null").collect()) == [1]
    assert [r.text for r in quarantine.bad_cells(rows, ["Player_ID"]).collect()] == ["no"]


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 500).alias("g"),
        F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("v"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6).alias("x"),
    )
    fine = sketches.sketched(df, ["g"], {"d": "v"}, {"q": "x"})
    row = sketches.merged(fine, [], ["d"], ["q"]).select(
        "n", sketches.distinct_estimate("d").alias("d"), *[sketches.quantile_estimate("q", p).alias(f"q{p}") for p in (0.1, 0.5, 0.9)]
    ).first()
    exact = df.select("v").distinct().count()
    assert row.n == 60_000 and abs(row.d - exact) <= 3 * 0.016 * exact
    for p in (0.1, 0.5, 0.9):
        rank = df.where(F.col("x") <= row[f"q{p}"]).count() / 60_000
        assert abs(rank - p) <= sketches.RANK_ERROR


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None)], "g int, v string, x double")
    row = sketches.sketched(df, ["g"], {"d": "v"}, {"q": "x"}).select(sketches.distinct_estimate("d").alias("d"), sketches.quantile_estimate("q", 0.5).alias("q")).first()
    assert row.d == 1 and row.q is None
    assert sketches.sketched(df.limit(0), ["g"], {"d": "v"}, {"q": "x"}).count() == 0


def test_target_uses_both_key_sets(tables):
    stats = tables["player_stats"]
    hot = hot_keys_of({"player_stats": (stats, boxscore.SERIES_KEYS), "player": (stats, ["Player_ID"])}, 0.0)
    split = dataset.with_next_game(matrix.feature_matrix({"player_stats": stats}, ["combined_stats"], hot=hot), hot=hot["player"])
    whole = dataset.with_next_game(matrix.feature_matrix({"player_stats": stats}, ["combined_stats"]))
    assert_same(split.select(*KEYS, "next_PIR"), whole.select(*KEYS, "next_PIR"))


def _box(spark, rng, players, rounds, keep):
    games = [
        {
            "Player_ID": p, "Round": r, "Gamecode": 100 * r + i, "Points": rng.choice([None, *range(30)]), "Steals": rng.randint(0, 4),
            "Minutes": f"{rng.randint(0, 39)}:{rng.randint(10, 59)}",
        }
        for i, p in enumerate(players)
        for r in rounds
        if keep(p, r)
    ]
    return box_table(spark, games)


def test_new_rounds_equal_a_full_rebuild(spark):
    """In steps: new rounds, a new player, a player without games, a late game, many games at once."""
    rng = random.Random(3)
    box = _box(spark, rng, ["P1", "P2", "P3", None], range(1, 31), lambda p, r: (p != "P3" or r > 20) and (p != "P2" or r % 3)).persist()
    arrives = F.when((F.col("Player_ID") == "P1") & (F.col("Round") == 7), 3).when(F.col("Round") <= 12, 0).when(F.col("Round") <= 22, 1)
    box = box.withColumn("_step", arrives.when(F.col("Round") <= 23, 2).otherwise(3)).persist()
    seen = lambda k: box.where(F.col("_step") <= k).drop("_step")
    stored, state = boxscore.add_box_features(seen(0)), increment.form_state(seen(0))
    for k in (2, 3):
        step = increment.advance(state, box.where(F.col("_step").between(k - 1 if k == 2 else k, k)).drop("_step"), seen(k))
        assert [r.Player_ID for r in step.replaced.collect()] == (["P1"] if k == 3 else [])
        if k < 3:
            assert step.features.count() == box.where(F.col("_step").between(1, 2)).count()
        stored, state = increment.merged(stored, step).persist(), step.state.persist()
        assert_same(stored, boxscore.add_box_features(seen(k)))
        assert state.count() == seen(k).select("Season", "Player_ID").distinct().count()
        assert state.agg(F.max(F.size("tail"))).first()[0] == increment.REACH


def test_only_late_series_are_read_again(spark):
    rng = random.Random(4)
    box = _box(spark, rng, ["P1", "P2"], range(1, 20), lambda p, r: True)
    old, new = box.where("Round <= 15"), box.where("Round > 15")
    history = box.withColumn("Steals", F.raise_error(F.lit("history was read")).cast("long"))
    step = increment.advance(increment.form_state(old), new, history)
    assert step.replaced.count() == 0 and step.features.count() == 8
    nothing = increment.advance(increment.form_state(old), new.limit(0), old)
    assert nothing.features.count() == 0 and nothing.state.count() == 2
    first = increment.advance(increment.form_state(old.limit(0)), old, old)
    assert_same(first.features, boxscore.add_box_features(old))
