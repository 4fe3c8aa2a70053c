"""What the physical plans must look like."""

import pytest
from helpers import TINY
from pyspark.sql import functions as F

from gamelog.plans import boxscore, dataset, matrix, plays, predict, shots
from gamelog.plans.feature_set import transform_together
from gamelog.sources import catalog, samples


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    for season in (2023, 2024):
        for name, df in samples.game_tables(spark, TINY).items():
            catalog.land_season(df.where(F.col("Season") == season), root, name, season)
    return root


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plan as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, root, name, player):
    return catalog.read_table(spark, root, name).withColumnRenamed(player, "Player_ID")


def test_plays_and_matchups_are_one_pass(spark, landed):
    raw = read(spark, landed, "playbyplay", "PLAYER_ID")
    plan = plan_of(transform_together([plays.make_play_set(), plays.make_matchup_set()], raw))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1
    assert "SortMergeJoin" not in plan and "Python" not in plan


def test_shots_are_one_exchange(spark, landed):
    raw = read(spark, landed, "shot_data", "ID_PLAYER")
    plan = plan_of(shots.make_set().transform(raw))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    # One sort for the ranks, one for the zones; the aggregate is not grouped by zone.
    assert plan.count("Sort [") == 2 and plan.count("HashAggregate(") == 2
    assert "ID_ACTION" not in plan.split("FileScan")[1]


def test_box_score_is_one_exchange_and_two_sorts(spark, landed):
    raw = catalog.read_table(spark, landed, "player_stats")
    plan = plan_of(boxscore.box_features(raw))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2
    assert "collect_list" not in plan and "Python" not in plan


def test_matrix_scans_each_table_once(spark, landed):
    tables = catalog.read_seasons(spark, landed)
    plan = plan_of(matrix.feature_matrix(tables))
    assert plan.count("FileScan") == 3
    assert plan.count("SortMergeJoin") == 2
    # One exchange per table, and one of the box score from players to player-games.
    assert plan.count("Exchange") == 4
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_plans_run_no_job_but_one_detection(spark, landed):
    tables = catalog.read_seasons(spark, landed)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "")
    before = len(tracker.getJobIdsForGroup("plan"))
    dataset.training_set(matrix.feature_matrix(tables))
    assert len(tracker.getJobIdsForGroup("plan")) == before
    hot = matrix.find_hot(tables)
    after = len(tracker.getJobIdsForGroup("plan"))
    assert after > before and set(hot) == set(tables)
    matrix.feature_matrix(tables, hot={name: [] for name in hot})
    assert len(tracker.getJobIdsForGroup("plan")) == after


def test_unused_feature_sets_are_not_joined(spark, landed):
    tables = catalog.read_seasons(spark, landed)
    plan = plan_of(matrix.feature_matrix(tables).select("Player_ID", "PIR"))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_season_filter_reaches_every_scan(spark, landed):
    tables = catalog.read_seasons(spark, landed, [2024])
    features = matrix.feature_matrix(tables)
    assert plan_of(features).count("FileScan") == 3
    assert len({f.split("/write=")[0] for f in features.inputFiles()}) == 3
    assert all("/Season=2024/" in f for f in features.inputFiles())


def test_latest_rows_need_no_player_list(spark, landed):
    box = catalog.read_table(spark, landed, "player_stats")
    plan = plan_of(predict.latest_active_rows(box, 2024))
    assert "Join" not in plan and "Window" not in plan and "Subquery" in plan
    # The round is filtered below the grouping, at the scan.
    assert plan.index("Aggregate") < plan.index("Filter (") < plan.index("FileScan")


def test_adapter_reads_only_needed_columns(spark):
    plan = plan_of(samples.shot_data(spark, TINY).select("Gamecode", "COORD_X"))
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan
