"""Null, division, order and rule semantics on hand-made rows."""

import math

import pytest
from helpers import box_table, one, play_table, shot_table
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from gamelog.functions.aggregates import distinct_with_null, percent_of, share, total, total_where
from gamelog.functions.scalars import clock_minutes, first_match, floor_at, mentions, ratio
from gamelog.operators.columns import align_columns, find_column, require_columns
from gamelog.operators.quantile import nearest_quantiles
from gamelog.operators.series import add_ewm_means, rolling
from gamelog.plans import boxscore, dataset, matrix, plays, shots
from gamelog.plans.feature_set import FeatureRegistry, FeatureSet, transform_together


def values(spark, column, kind="double", rows=()):
    return spark.createDataFrame([(v,) for v in rows], f"{column} {kind}")


@pytest.mark.parametrize(
    "clock,minutes",
    [("12:30", 12.5), ("", 0.0), ("DNP", 0.0), (None, 0.0), ("0:06", 0.1), ("7", None)],
)
def test_clock(spark, clock, minutes):
    got = one(values(spark, "c", "string", [clock]).select(clock_minutes(F.col("c")).alias("m")))
    assert got["m"] == minutes or math.isclose(got["m"], minutes)


def test_bad_clock_fails(spark):
    with pytest.raises(NumberFormatException):
        values(spark, "c", "string", ["ab:cd"]).select(clock_minutes(F.col("c"))).collect()


def test_division_and_clipping(spark):
    df = spark.createDataFrame([(1, 0, None)], "a int, b int, n int")
    got = one(
        df.select(
            ratio(F.col("a"), F.col("b")).alias("zero"),
            ratio(F.col("a"), F.lit(4)).alias("quarter"),
            floor_at(F.col("n")).alias("filled"),
            floor_at(F.col("n"), keep_null=True).alias("kept"),
            floor_at(F.col("b")).alias("low"),
        )
    )
    assert got == {"zero": None, "quarter": 0.25, "filled": 1, "kept": None, "low": 1}


def test_aggregates_over_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x int, b boolean")
    got = one(
        df.agg(
            total(F.col("x")).alias("total"),
            total_where(F.col("x"), F.col("b")).alias("where"),
            F.count_if("b").alias("hits"),
            share(F.col("b")).alias("share"),
            percent_of(F.col("b"), F.col("x")).alias("percent"),
            distinct_with_null(F.col("x")).alias("kinds"),
        )
    )
    assert got == {"total": 0, "where": 0, "hits": 0, "share": None, "percent": 0.0, "kinds": 1}


def test_distinct_counts_null_once(spark):
    df = values(spark, "x", "string", ["a", None, "b", None])
    assert one(df.agg(distinct_with_null(F.col("x")).alias("n")))["n"] == 3
    assert one(df.na.drop().agg(distinct_with_null(F.col("x")).alias("n")))["n"] == 2


def test_first_match_and_mentions(spark):
    df = values(spark, "x", "string", ["AB", None])
    rows = df.select(
        mentions(F.col("x"), ("B", "Z")).alias("m"),
        first_match([(F.col("x").contains("A"), 1), (F.col("x").contains("B"), 2)], 0).alias("v"),
    ).collect()
    assert [(r.m, r.v) for r in rows] == [(True, 1), (None, 0)]


@pytest.mark.parametrize(
    "known,q25,q75",
    [([1, 2, 3, 4], 2, 3), ([5], 5, 5), ([1, 2], 1, 2), ([None, 4, None, 2, 9], 4, 9), ([None], None, None)],
)
def test_nearest_quantile(spark, known, q25, q75):
    rows = [("k", None if v is None else float(v)) for v in known]
    df = spark.createDataFrame(rows, "k string, v double")
    got = one(nearest_quantiles(df, ["k"], "v", {"lo": 0.25, "hi": 0.75}))
    assert (got["lo"], got["hi"]) == (q25, q75)


def ewm(spark, series, alpha=0.3, **options):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(series)], "k string, i int, v double")
    out = add_ewm_means(df, ["k"], ["i"], {"m": "v"}, alpha, **options)
    return [r.m for r in out.orderBy("i").collect()]


def direct_ewm(series, alpha):
    out = []
    for t in range(len(series)):
        top = bottom = 0.0
        for i in range(t + 1):
            if series[i] is not None:
                weight = (1 - alpha) ** (t - i)
                top, bottom = top + weight * series[i], bottom + weight
        out.append(top / bottom if bottom else None)
    return out


def test_ewm_with_a_gap(spark):
    got = ewm(spark, [10.0, 20.0, None, 5.0])
    second, fourth = (20 + 0.7 * 10) / 1.7, (5 + 0.49 * 20 + 0.343 * 10) / (1 + 0.49 + 0.343)
    assert got == pytest.approx([10, second, second, fourth])
    assert ewm(spark, [10.0, None, 5.0], null_rows="null")[1] is None
    assert ewm(spark, [None, 5.0]) == [None, 5.0]
    with pytest.raises(ValueError):
        ewm(spark, [1.0], null_rows="other")


@pytest.mark.parametrize("alpha", [0.3, 0.9, 0.05])
def test_ewm_over_many_blocks(spark, alpha):
    series = [None if i % 7 == 3 else float((i * 37) % 101 - 50) for i in range(700)]
    assert ewm(spark, series, alpha) == pytest.approx(direct_ewm(series, alpha), rel=1e-9, abs=1e-9)


def test_ewm_carries_over_a_long_gap(spark):
    got = ewm(spark, [4.0, 8.0] + [None] * 400 + [1.0])
    assert got[401] == pytest.approx(got[1])
    assert got[402] == pytest.approx(1.0)


def test_rolling_needs_full_windows(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([10.0, None, 20.0, 5.0, 7.0, 9.0])], "k string, i int, v double")
    w = Window.partitionBy("k").orderBy("i")
    out = df.select(
        "i",
        rolling(F.col("v"), w, 3, "mean").alias("strict"),
        rolling(F.col("v"), w, 3, "mean", min_periods=1).alias("loose"),
        rolling(F.col("v"), w, 3, "sum").alias("sum"),
        rolling(F.col("v"), w, 3, "std").alias("std"),
    ).orderBy("i").collect()
    assert [r.strict for r in out] == [None, None, None, None, pytest.approx(32 / 3), 7.0]
    assert [r.loose for r in out[:3]] == [10.0, 10.0, 15.0]
    assert out[5]["sum"] == 21.0 and out[5]["std"] == pytest.approx(2.0)


def test_short_series_is_zero_in_the_matrix(spark):
    box = box_table(spark, [{"Points": 3}, {"Points": 5}])
    empty_shots = shot_table(spark, []).withColumnRenamed("Player_ID", "ID_PLAYER")
    tables = {"player_stats": box, "shot_data": empty_shots, "playbyplay": play_table(spark, [])}
    rows = matrix.feature_matrix(tables).orderBy("Round").collect()
    assert [r.Points_ma3 for r in rows] == [0.0, 0.0]
    assert rows[1]["points_ewm"] == pytest.approx((5 + 0.7 * 3) / 1.7)
    assert all(rows[0][name] == 0 for name in shots.FEATURES + plays.PLAY_FEATURES)


def test_null_inside_the_window(spark):
    points = [10, None, 20, 5]
    rows = boxscore.box_features(box_table(spark, [{"Points": p} for p in points])).collect()
    assert [r.pir_ma3 for r in rows] == [None] * 4
    assert [r.PIR for r in sorted(rows, key=lambda r: r.Round)] == points


def test_unknown_attempts(spark):
    got = one(
        boxscore.box_features(
            box_table(spark, [{"FieldGoalsAttempted2": None, "FieldGoalsMade2": 2, "Points": 4}])
        )
    )
    assert got["fg_percentage_2pt"] == 2.0
    assert got["fg_percentage"] == 2.0
    assert got["true_shooting_percentage"] is None
    assert got["PIR"] is None


def test_rating(spark):
    game = {
        "Points": 20, "OffensiveRebounds": 1, "DefensiveRebounds": 2, "Assistances": 3, "Steals": 4,
        "BlocksFavour": 5, "FoulsReceived": 6, "FieldGoalsAttempted2": 10, "FieldGoalsMade2": 7,
        "FieldGoalsAttempted3": 4, "FieldGoalsMade3": 2, "FreeThrowsAttempted": 3, "FreeThrowsMade": 1,
        "Turnovers": 2, "BlocksAgainst": 1, "FoulsCommited": 3,
    }
    got = one(boxscore.box_features(box_table(spark, [game])))
    assert got["PIR"] == 41 - (3 + 2 + 2 + 2 + 1 + 3)
    assert got["true_shooting_percentage"] == pytest.approx(20 / (2 * (14 + 0.44 * 3)))
    assert got["fg_percentage"] == pytest.approx(9 / 14)


def test_games_are_ordered_within_a_season_only(spark):
    games = [{"Season": s, "Round": r, "Gamecode": r, "Points": s * 10 + r} for s in (2023, 2024) for r in (1, 2)]
    rows = boxscore.box_features(box_table(spark, games)).collect()
    assert all(r.Points_ma3 is None for r in rows)


def play_row(spark, kinds, exact=False):
    sets = [plays.make_play_set(plays.PlayRules(exact=exact)), plays.make_matchup_set(plays.PlayRules(exact=exact))]
    return one(transform_together(sets, play_table(spark, kinds)))


def test_zero_denominators(spark):
    got = play_row(spark, ["CM", "CM"])
    assert got["turnover_rate"] == 0.0 and got["scoring_efficiency"] == 0.0
    got = play_row(spark, [None])
    assert got["assist_rate"] == 0.0 and got["usage_rate"] == 0.0 and got["unique_play_types"] == 1


def test_unknown_score(spark):
    got = play_row(spark, [("2FGM", 1, 3, None, "4")] * 2)
    assert got["close_game_impact_plays"] == 0
    assert got["game_volatility"] == 0.0 and got["close_game_time_ratio"] == 0.0
    assert got["points_in_close_games"] == 0 and got["usage_rate"] == 200.0


def test_turnover_code_in_both_readings(spark):
    got = play_row(spark, ["TO"])
    assert got["offensive_rebound_rate"] == 100.0 and got["total_play_impact"] == pytest.approx(1.2)
    got = play_row(spark, ["TO"], exact=True)
    assert got["offensive_rebound_rate"] == 0.0 and got["total_play_impact"] == -1.5


def test_made_flag_in_both_readings(spark):
    late = [("2FGM", 4, 36, "70", "68")]
    assert play_row(spark, late)["clutch_scores"] == 0
    got = play_row(spark, late, exact=True)
    assert got["clutch_scores"] == 1 and got["clutch_points"] == 2 and got["super_clutch_plays"] == 0


def test_streaks(spark):
    got = play_row(spark, ["2FGM", "AS", "TO", "3FGM", "ST", None, "CM"])
    assert got["consecutive_positive_plays"] == 2
    assert got["best_impact_sequence"] == pytest.approx(1.2 + 4 + 2)
    assert got["worst_impact_sequence"] == pytest.approx(2.0)
    got = play_row(spark, ["2FGM", "AS"])
    assert got["best_impact_sequence"] == 0.0 and got["consecutive_positive_plays"] == 1


def shot_row(spark, *made):
    return one(shots.make_set().transform(shot_table(spark, made)))


def test_single_shot(spark):
    got = shot_row(spark, {"x": 3.0, "y": 4.0})
    assert got["avg_shot_distance"] == 5.0 and got["shot_distance_variation"] == 0.0
    assert got["long_range_percentage"] == 1.0 and got["mid_range_percentage"] == 0.0
    assert got["points_per_shot"] == 2.0 and got["effective_fg_percentage"] == 1.0


def test_shot_rules_in_order(spark):
    near, far = {"x": 1.0}, {"x": 9.0}
    assert shot_row(spark, {**near, "f": "1", "s": "1"})["shot_quality_index"] == 1.3
    assert shot_row(spark, {**far, "s": "1"})["shot_quality_index"] == 1.1
    assert shot_row(spark, near)["shot_quality_index"] == 1.2
    assert shot_row(spark, far)["shot_quality_index"] == 0.8
    assert shot_row(spark, {"x": 5.0})["shot_quality_index"] == 1.0


def test_unknown_action_and_zone(spark):
    got = shot_row(spark, {"a": None, "z": None}, {"a": "Missed Three Pointer", "z": "B"})
    assert got["unique_scoring_zones"] == 2
    assert got["three_point_attempt_rate"] == 1.0
    assert got["points_per_shot"] == 0.0 and got["close_shot_percentage"] == 0.0


def test_bad_flag_fails(spark):
    with pytest.raises(NumberFormatException):
        shot_row(spark, {"f": "yes"})


def test_other_thresholds(spark):
    rules = shots.ShotRules(close=300, long=500, far=700)
    got = one(shots.make_set(rules).transform(shot_table(spark, [{"x": 250.0}])))
    assert got["shot_quality_index"] == 1.2 and got["close_shot_percentage"] == 1.0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="ZONE"):
        shots.make_set().transform(shot_table(spark, []).drop("ZONE"))
    require_columns(shot_table(spark, []), ["ZONE"])


def test_find_column():
    assert find_column(["Points_ma3"], "points_ma3") == "Points_ma3"
    assert find_column(["freethrowrate"], "free_throw_rate") == "freethrowrate"
    assert find_column(["FreeThrowRate"], "free_throw_rate") == "FreeThrowRate"
    assert find_column(["other"], "free_throw_rate") is None


def test_align_columns_reports_constants(spark):
    df = spark.createDataFrame([(None, 2.0)], "Points_ma3 double, pir_ma3 double")
    aligned, made_up = align_columns(df, ["points_ma3", "pir_ma3", "game_score"])
    assert made_up == ["game_score"]
    assert one(aligned) == {"points_ma3": 0.0, "pir_ma3": 2.0, "game_score": 0.0}


def test_model_input_contract(tables):
    _, made_up = dataset.scoring_set(matrix.feature_matrix(tables))
    assert len(dataset.MODEL_FEATURES) == 63 and len(made_up) == 24
    assert "game_score" in made_up and "points_ma3" not in made_up


def test_target_scopes(spark):
    games = [
        {"Season": s, "Round": r, "Gamecode": r, "Points": p}
        for s, r, p in [(2023, 1, 1), (2023, 2, 2), (2024, 1, 3), (2024, 2, 4)]
    ]
    features = boxscore.box_features(box_table(spark, games))
    across = {(r.Season, r.Round): r.next_PIR for r in dataset.with_next_game(features).collect()}
    assert across == {(2023, 1): 2, (2023, 2): 3, (2024, 1): 4}
    inside = dataset.with_next_game(features, scope="season_player").collect()
    assert {(r.Season, r.Round): r.next_PIR for r in inside} == {(2023, 1): 2, (2024, 1): 4}


def test_registry(spark):
    registry = FeatureRegistry()
    double = FeatureSet(
        "scoring", "player_stats", ("Points",), ("double_points",),
        rows=lambda df: df.withColumn("double_points", F.col("Points") * 2),
    )
    registry.register(double)
    with pytest.raises(ValueError):
        registry.register(double)
    with pytest.raises(KeyError):
        registry.get("nothing")
    assert registry.names() == ["scoring"]
    tables = {"player_stats": box_table(spark, [{"Points": 4}])}
    got = one(matrix.feature_matrix(tables, ["scoring", "nothing"], registry))
    assert got["double_points"] == 8


def test_default_sets_and_their_size():
    registry = matrix.default_registry()
    assert registry.names() == ["combined_stats", "shot_patterns", "playbyplay", "position_matchups"]
    assert sum(len(registry.get(n).features) for n in registry.names()) == 71


def test_config_needs_its_fields():
    with pytest.raises(ValueError, match="seasons"):
        matrix.FeatureConfig.from_mapping({"data_dir": "a", "output_dir": "b"})
    config = matrix.FeatureConfig.from_mapping({"data_dir": "a", "output_dir": "b", "seasons": ["2023"]})
    assert config.sets is None


def test_feature_clash_is_reported(spark):
    box = box_table(spark, [{}]).withColumn("block_rate", F.lit(1.0))
    empty_shots = shot_table(spark, []).withColumnRenamed("Player_ID", "ID_PLAYER")
    tables = {"player_stats": box, "shot_data": empty_shots, "playbyplay": play_table(spark, [])}
    with pytest.raises(ValueError, match="block_rate"):
        matrix.feature_matrix(tables)
    assert matrix.feature_matrix(tables, ["shot_patterns"]).count() == 1


def test_excluding_team_totals(tables):
    whole = matrix.feature_matrix(tables, ["combined_stats"])
    rest = matrix.feature_matrix(tables, ["combined_stats"], exclude_ids=("Total",))
    totals = whole.where("Player_ID = 'Total'").count()
    assert totals > 0 and rest.count() == whole.count() - totals
