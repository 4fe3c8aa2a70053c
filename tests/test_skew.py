"""Hot keys take another plan; the results must not differ."""

import random

import pytest
from helpers import assert_same, box_table, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from gamelog.functions.aggregates import distinct_with_null
from gamelog.operators.latest import latest_per_key
from gamelog.operators.ordering import global_row_index, with_sequences
from gamelog.operators.quantile import nearest_quantiles
from gamelog.operators.series import add_ewm_means, ewm_reach, lead_value
from gamelog.operators.skew import hot_keys, hot_keys_of, split_hot
from gamelog.plans import boxscore, dataset, plays, shots
from gamelog.plans.feature_set import KEYS, keyed


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; one key is NULL; values repeat and are missing."""
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else draw.choice(["a", "b", "c", None])
        value = None if draw.random() < 0.1 else float(draw.randrange(40))
        rows.append((key, draw.random(), i, value))
    schema = "k string, at double, id bigint, x double"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


def test_hot_keys_are_those_above_a_share(skewed):
    assert hot_keys(skewed, ["k"], 0.4) == []
    only = hot_keys(skewed, ["k"], 0.3)
    ordinary, apart = split_hot(skewed, ["k"], only)
    assert len(only) == 1 and {r.k for r in apart.select("k").distinct().collect()} == {"hot"}
    assert apart.count() == 500 and ordinary.count() == 1000
    ordinary, apart = split_hot(skewed, ["k"], hot_keys(skewed, ["k"], 0.0))
    assert ordinary.count() == 0 and apart.count() == 1500
    assert split_hot(skewed, ["k"], []) == (skewed, None)
    found = hot_keys_of({"a": (skewed, ["k"]), "none": (skewed.limit(0), ["k"])}, 0.3)
    assert found == {"a": only, "none": []}


def test_global_row_index_is_the_sorted_position(skewed):
    got = {r.id: r.row_index for r in global_row_index(skewed, ["at", "id"]).collect()}
    want = sorted(skewed.collect(), key=lambda r: (r.at, r.id))
    assert got == {r.id: i for i, r in enumerate(want)}


def test_global_row_index_on_few_and_no_rows(spark):
    two = spark.createDataFrame([(2,), (1,)], "v int")
    assert sorted(global_row_index(two, ["v"]).collect()) == [(1, 0), (2, 1)]
    assert global_row_index(two.where("v > 9"), ["v"]).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.3])
@pytest.mark.parametrize("before,after", [(0, 1), (2, 1), (30, 0), (200, 3)])
def test_sequences_match_plain_windows(skewed, share, before, after):
    def add(df, parts):
        w = Window.partitionBy(*parts).orderBy("at", "id")
        return df.withColumns(
            {
                "total": F.sum("x").over(w.rowsBetween(-before, after)),
                "n": F.count(F.lit(1)).over(w.rowsBetween(-before, after)),
            }
        )

    split = with_sequences(skewed, ["k"], ["at", "id"], add, before, after, hot=hot_keys(skewed, ["k"], share))
    assert_same(split, add(skewed, ["k"]))


def test_short_chunks_borrow_across_several(spark):
    """Eight chunks of a few rows each, frames longer than a chunk."""
    df = spark.createDataFrame([("k", i, float(i * i)) for i in range(40)], "k string, i int, x double")

    def add(rows, parts):
        w = Window.partitionBy(*parts).orderBy("i")
        return rows.withColumn("s", F.sum("x").over(w.rowsBetween(-17, 12)))

    split = with_sequences(df, ["k"], ["i"], add, 17, 12, hot=hot_keys(df, ["k"]))
    assert_same(split, add(df, ["k"]))


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_ewm_over_chunks(skewed, share):
    def add(df, parts):
        return add_ewm_means(df, parts, ["at", "id"], {"m": "x"}, 0.3)

    split = with_sequences(
        skewed, ["k"], ["at", "id"], add, ewm_reach(0.3), carry=["m"], hot=hot_keys(skewed, ["k"], share)
    )
    assert_same(split, add(skewed, ["k"]))


def test_ewm_carries_over_chunks_without_values(spark):
    """A gap of several chunks, far longer than the reach, and unknown first rows."""
    series = [None] * 50 + [float(i % 9) for i in range(100)] + [None] * 2500 + [3.0, 5.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v double")

    def add(rows, parts):
        return add_ewm_means(rows, parts, ["i"], {"m": "v"}, 0.3)

    reach = ewm_reach(0.3)
    split = with_sequences(df, ["k"], ["i"], add, reach, carry=["m"], hot=hot_keys(df, ["k"]))
    assert_same(split, add(df, ["k"]))
    assert split.where("m is null").count() == 50


def test_lead_over_chunks(skewed):
    for share in (0.0, 0.3):
        assert_same(
            lead_value(skewed, ["k"], ["at", "id"], "x", "next", hot_keys(skewed, ["k"], share)),
            lead_value(skewed, ["k"], ["at", "id"], "x", "next"),
        )


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_quantiles_of_hot_groups(skewed, share):
    unknown = skewed.limit(3).select(F.lit("none").alias("k"), "at", "id", F.lit(None).cast("double").alias("x"))
    df = skewed.unionByName(unknown)
    wanted = {"lo": 0.25, "mid": 0.5, "hi": 0.75}
    df = df.withColumn("z", F.when(F.col("id") % 4 != 0, F.col("id") % 7))
    extra, distinct = {"n": F.count(F.lit(1))}, {"kinds": "z", "values": "x"}
    plain = nearest_quantiles(df, ["k"], "x", wanted, extra, distinct)
    assert_same(nearest_quantiles(df, ["k"], "x", wanted, extra, distinct, hot_keys(df, ["k"], share)), plain)
    counted = df.groupBy("k").agg(
        distinct_with_null(F.col("z")).alias("kinds"), distinct_with_null(F.col("x")).alias("values")
    )
    assert_same(plain.select("k", "kinds", "values"), counted)
    assert_same(
        nearest_quantiles(df, ["k"], "x", wanted, hot=hot_keys(df, ["k"], share)),
        nearest_quantiles(df, ["k"], "x", wanted),
    )


def test_one_value_fills_a_hot_group(spark):
    """Half of a group is one value, the rest lies far apart."""
    rows = [("k", 3.0)] * 400 + [("k", float(10**i)) for i in range(12)] + [("k", None)] * 5 + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = {"least": 0.0, "lo": 0.25, "high": 0.98, "most": 1.0}
    assert_same(
        nearest_quantiles(df, ["k"], "x", wanted, hot=hot_keys(df, ["k"], 0.0)), nearest_quantiles(df, ["k"], "x", wanted)
    )


def test_box_features_of_hot_players(tables):
    box = tables["player_stats"]
    assert_same(boxscore.box_features(box, hot_keys(box, boxscore.SERIES_KEYS, 0.0)), boxscore.box_features(box))


def test_play_features_of_hot_games(tables):
    raw = keyed(tables["playbyplay"], "playbyplay")
    split = plays.make_play_set(hot=hot_keys(raw, KEYS, 0.0)).transform(raw)
    assert_same(split, plays.make_play_set().transform(raw))


def test_shot_features_of_hot_games(tables):
    raw = keyed(tables["shot_data"], "shot_data")
    assert_same(shots.make_set(hot=hot_keys(raw, KEYS, 0.0)).transform(raw), shots.make_set().transform(raw))


def test_targets_of_hot_players(tables):
    box = boxscore.box_features(tables["player_stats"])
    assert_same(dataset.with_next_game(box, hot=hot_keys(box, ["Player_ID"], 0.0)), dataset.with_next_game(box))


def test_team_totals_as_a_hot_key(spark):
    """Two total rows per game, a third of the table: the team breaks the tie."""
    games = []
    for g in range(40):
        for team in ("A", "B"):
            games.append({"Player_ID": "Total", "Team": team, "Gamecode": g, "Round": g, "Points": g * 2})
            games += [
                {"Player_ID": f"{team}{p}", "Team": team, "Gamecode": g, "Round": g, "Points": g + p}
                for p in (1, 2)
            ]
    box = box_table(spark, games)
    split = boxscore.box_features(box, hot_keys(box, boxscore.SERIES_KEYS, 0.3))
    assert split.count() == 240
    assert_same(split, boxscore.box_features(box))


def test_result_does_not_depend_on_partitioning(tables):
    box = tables["player_stats"]
    assert rows_of(boxscore.box_features(box.repartition(1))) == rows_of(
        boxscore.box_features(box.repartition(16))
    )


def test_latest_per_key_matches_sorting(skewed):
    got = {r.k: r.id for r in latest_per_key(skewed, ["k"], ["at", "id"]).collect()}
    want = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.at, r.id)):
        want[r.k] = r.id
    assert got == want
