"""Tables of known size are dealt out in as many tasks as their rows need."""

import re

import pytest
from helpers import TINY, assert_same

from gamelog import queries
from gamelog.operators import spread
from gamelog.operators.skew import hot_keys, rows_behind


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_and_uncounted_tables_are_left_alone(spark):
    df = spark.range(10)
    assert spread.spread(df, ["id"], None) is df and spread.spread(df, ["id"], 10) is df


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS_EACH", 5)
    rows = 100 * parts(spark)
    assert spread.spread(spark.range(rows), ["id"], rows).rdd.getNumPartitions() == spread.tasks_for(spark, rows) == rows // 5


def test_hot_keys_know_the_rows(spark):
    assert rows_behind(hot_keys(spark.range(7), ["id"])) == 7
    assert rows_behind(hot_keys(spark.range(0), ["id"])) == 0
    assert rows_behind([]) is None


@pytest.mark.parametrize(
    "name", ["shot_features", "shot_quantiles", "shot_zone_distinct", "box_features", "box_features_advanced", "feature_matrix", "feature_matrix_bucketed", "next_game_target"]
)
def test_a_table_dealt_out_gives_the_same_rows(spark, monkeypatch, name):
    run = queries.registered()[name]
    plain = run(spark, TINY).localCheckpoint()
    monkeypatch.setattr(spread, "ROWS_EACH", 100)
    dealt = run(spark, TINY)
    assert_same(dealt, plain)
    if name == "feature_matrix_bucketed":
        return
    tasks = [int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan_of(dealt))]
    assert tasks and min(tasks) > parts(spark)


def test_no_season_meets_in_one_task(spark):
    """The last rounds come from one row per season, not from a window over all of its rows."""
    plan = plan_of(queries.registered()["box_features_advanced"](spark, TINY))
    assert "windowspecdefinition(Season#" in plan
    assert not re.search(r"windowspecdefinition\(Season#\d+, specifiedwindowframe", plan)
