"""Forecasts and importances do no more work than their results need."""

from helpers import TINY, assert_same
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from gamelog import queries
from gamelog.plans import matrix, model, predict
from gamelog.plans.dataset import with_next_game
from gamelog.sources import samples

SEASON = queries.SEASON


def test_forecasts_form_only_active_players(spark):
    stats = samples.player_stats(spark, TINY).persist()
    games = predict.games_of_active(stats, SEASON)
    assert 0 < games.count() < predict.in_season(stats, SEASON).count()
    part, whole = [matrix.feature_matrix({"player_stats": rows}, ["combined_stats"]) for rows in (games, stats)]
    assert_same(predict.latest_active_rows(part, SEASON), predict.latest_active_rows(whole, SEASON))
    assert_same(predict.active_players(part, SEASON), predict.active_players(whole, SEASON))
    plan = queries.registered()["top_n_report"](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("Window [", 1)[1]
    stats.unpersist()


def test_unknown_rounds_are_active_as_in_the_matrix(spark):
    stats = samples.player_stats(spark, TINY).withColumn("Round", F.lit(None).cast("int"))
    features = matrix.feature_matrix({"player_stats": stats}, ["combined_stats"])
    games = predict.games_of_active(stats, SEASON)
    assert_same(games.select("Player_ID").distinct(), predict.active_players(features, SEASON))


def test_a_line_scores_no_shuffled_row(spark, monkeypatch):
    names = ["pir_ma3", "minutes_played", "Points"]
    features = matrix.feature_matrix({"player_stats": samples.player_stats(spark, TINY)}, ["combined_stats"])
    rows = with_next_game(features).select("Season", "Player_ID", "Gamecode", "Round", "Team", *names, "next_PIR").persist()
    fitted = model.fit_forecaster(rows, names=names, fit=model.fit_linear)
    n, scored, plain = rows.count(), [], LinearRegressionModel.transform

    def counted(self, frame, *others):
        scored.append(frame.count())
        return plain(self, frame, *others)

    monkeypatch.setattr(LinearRegressionModel, "transform", counted)
    shuffled = model.permutation_importance(fitted, rows, repeats=4)
    assert shuffled.count() == len(names) and set(scored) == {n}
    rows.unpersist()
