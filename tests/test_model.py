"""Folds, metrics, the fitted forecast, importance and the report."""

import math

import pytest
from helpers import assert_same, box_table, one
from pyspark.sql import functions as F

from gamelog.plans import boxscore, dataset, evaluation, matrix, model, predict, workflow
from gamelog.plans.dataset import TARGET
from gamelog.sources import catalog

NAMES = ("a", "b", "c")
SMALL = model.ForecastParams(max_iter=8, max_depth=3, n_splits=3, min_samples_leaf=5)


@pytest.fixture(scope="module")
def signal(spark):
    """The target follows ``a`` strongly and ``b`` weakly; ``c`` is constant."""
    df = spark.range(600).select(
        F.lit(2024).alias("Season"),
        (F.col("id") / 20).cast("int").alias("Round"),
        F.col("id").alias("Gamecode"),
        F.concat(F.lit("P"), F.col("id") % 20).alias("Player_ID"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0).alias("a"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 100.0).alias("b"),
        F.lit(3.0).alias("c"),
    )
    return df.withColumn(TARGET, F.col("a") * 3 + F.col("b") * 0.5).persist()


def test_fold_arithmetic(spark):
    for n in (12, 13, 17, 600):
        df = spark.range(n).select(
            F.lit(1).alias("Season"), F.lit(1).alias("Round"), F.col("id").alias("Gamecode"), F.lit("x").alias("Player_ID")
        )
        size = n // 6
        rows = evaluation.with_time_folds(df).collect()
        got = {r.Gamecode: r.test_fold for r in rows}
        want = {}
        for f in range(1, 6):
            for i in range(n - (6 - f) * size, n - (5 - f) * size):
                want[i] = f
        assert got == {i: want.get(i, 0) for i in range(n)}


def test_cut_points_are_sorted_rows(spark):
    df = spark.createDataFrame(
        [(s, r, g, p, t) for s in (1, 2) for r in (None, 3, 4) for g, p in ((5, "a"), (5, None), (6, "a")) for t in ("x", "y")],
        "Season int, Round int, Gamecode int, Player_ID string, Team string",
    )
    order = evaluation.time_order(df)
    rows = [tuple(r) for r in df.orderBy(*order).collect()]
    found = evaluation.rows_at(df.repartition(3), order, [0, 7, 13, 35, 36])
    assert found == {i: rows[i] for i in (0, 7, 13, 35)}
    before = df.where(evaluation.is_before(order, rows[13]))
    assert sorted(before.collect(), key=str) == sorted(df.orderBy(*order).limit(13).collect(), key=str)


def test_folds_move_no_rows(signal):
    plan = evaluation.with_time_folds(signal)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_folds_take_two_jobs(signal, monkeypatch):
    collected = []
    plain = type(signal).collect
    monkeypatch.setattr(type(signal), "collect", lambda df: collected.append(1) or plain(df))
    evaluation.with_time_folds(signal)
    assert len(collected) <= 2


def test_a_large_round_is_refined_column_by_column(signal, monkeypatch):
    order = evaluation.time_order(signal)
    whole = evaluation.rows_at(signal, order, [5, 99, 100, 599, 600])
    monkeypatch.setattr(evaluation, "REFINED_ROWS", 3)
    assert evaluation.rows_at(signal, order, [5, 99, 100, 599, 600]) == whole and 600 not in whole


def test_first_trees_equal_a_shorter_fit(signal):
    long, short = [
        model.fit_forecaster(signal, model.ForecastParams(max_iter=n, max_depth=3, early_stopping=False), NAMES) for n in (8, 5)
    ]
    cut = model.first_trees(long.stages[-1], 5)
    assert cut.getNumTrees == 5 and cut.treeWeights == short.stages[-1].treeWeights
    assert cut.toDebugString.split("\n", 1)[1] == short.stages[-1].toDebugString.split("\n", 1)[1]
    assert cut.featureImportances == short.stages[-1].featureImportances
    scored = [short.stages[1].transform(short.stages[0].transform(signal))]
    columns = ["Gamecode", "predicted"]
    assert_same(cut.transform(scored[0]).select(columns), short.transform(signal).select(columns))
    with pytest.raises(ValueError):
        model.first_trees(long.stages[-1], 9)


def test_early_stopping_keeps_the_first_trees(signal):
    params = model.ForecastParams(max_iter=12, max_depth=2, tolerance=5.0, patience=1)
    fitted = model.fit_forecaster(signal, params, NAMES).stages[-1]
    whole = model.fit_forecaster(signal, model.ForecastParams(max_iter=12, max_depth=2, tolerance=-1e9), NAMES).stages[-1]
    assert 1 <= fitted.getNumTrees < whole.getNumTrees == 12
    assert fitted.toDebugString.split("\n", 1)[1] in whole.toDebugString


def test_fits_together_equal_fits_in_a_row(signal):
    row = model.ForecastParams(**{**SMALL.__dict__, "parallel_fits": 1})
    assert_same(model.cross_validate(signal, SMALL, NAMES), model.cross_validate(signal, row, NAMES))
    curves = [model.learning_curve(signal, p, NAMES, fractions=(0.3, 1.0)) for p in (SMALL, row)]
    assert_same(*curves)


def test_a_failing_fit_is_reported(signal):
    def bad(rows, target):
        raise ValueError("no fit")

    with pytest.raises(ValueError, match="no fit"):
        model.cross_validate(signal, SMALL, NAMES, fit=bad)


@pytest.mark.parametrize("errors,keep", [([5, 4, 3, 2], 4), ([5, 4, 4, 4, 1], 4), ([3, 4, 2, 2, 2.0], 5), ([1, 2, 3], 3)])
def test_trees_until_the_error_stays(errors, keep):
    assert model.trees_to_keep(errors, 2, 1e-7) == keep


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (2, 5.0, 5.0)], "fold int, actual double, predicted double")
    got = {r.fold: r for r in evaluation.fold_metrics(df).collect()}
    assert got[1].rmse == pytest.approx(math.sqrt(0.5)) and got[1].mae == 0.5 and got[1].r2 == 0.5
    assert got[2].rmse == 0.0 and got[2].r2 is None
    record = one(evaluation.metrics_record(evaluation.fold_metrics(df)))
    assert record["mae"] == 0.25 and [f.fold for f in record["fold_metrics"]] == [1, 2]


def test_cross_validation_beats_the_mean(signal):
    forecasts = model.cross_validate(signal, SMALL, NAMES)
    rows = evaluation.fold_metrics(forecasts).orderBy("fold").collect()
    assert [r.fold for r in rows] == [1, 2, 3]
    assert all(r.r2 > 0.5 for r in rows)
    assert forecasts.count() == 3 * (600 // 4)


def test_same_seed_same_forecast(signal):
    first, second = [model.fit_forecaster(signal, SMALL, NAMES).transform(signal) for _ in range(2)]
    columns = ["Gamecode", "predicted"]
    assert_same(first.select(columns), second.select(columns))


def test_without_early_stopping(signal):
    params = model.ForecastParams(max_iter=3, early_stopping=False)
    fitted = model.fit_forecaster(signal, params, NAMES)
    assert fitted.stages[-1].getNumTrees == 3


def test_learning_curve(signal):
    curve = model.learning_curve(signal, SMALL, NAMES, fractions=(0.2, 1.0)).collect()
    assert len(curve) == 6
    assert {r.n_train for r in curve} == {30, 150}
    assert len({r.train_mse for r in curve if r.fraction == 1.0}) == 1
    assert all(r.val_mse > 0 for r in curve)


def _seen_fits(monkeypatch):
    """(trees, partitions of the rows) of every fit of trees from here on."""
    seen, learner = [], model._learner

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def setMaxIter(self, trees):
            return Watched(self.inner.setMaxIter(trees))

        def fit(self, rows):
            seen.append((self.inner.getMaxIter(), rows.rdd.getNumPartitions()))
            return self.inner.fit(rows)

    monkeypatch.setattr(model, "_learner", lambda params, target: Watched(learner(params, target)))
    return seen


def test_trees_are_grown_in_two_steps_at_most(signal, monkeypatch):
    """Early stopping that never ends the growth costs twice the patience, not the trees again and again."""
    seen = _seen_fits(monkeypatch)
    params = model.ForecastParams(max_iter=12, max_depth=2, patience=1, tolerance=-1e9)
    assert model.fit_forecaster(signal, params, NAMES).stages[-1].getNumTrees == 12
    assert [trees for trees, _ in seen] == [2, 12]


def test_a_fit_has_tasks_by_its_rows(signal, monkeypatch):
    seen = _seen_fits(monkeypatch)
    params = model.ForecastParams(max_iter=1, early_stopping=False)
    model.fit_forecaster(signal.repartition(9), params, NAMES)
    monkeypatch.setattr(model, "FIT_ROWS_EACH", 200)
    model.fit_forecaster(signal.repartition(9), params, NAMES)
    assert [parts for _, parts in seen] == [1, 3]


def test_shuffled_rows_are_kept_nowhere(signal, monkeypatch):
    kept, persist = [], type(signal).persist
    monkeypatch.setattr(type(signal), "persist", lambda df, *level: kept.append(df.columns) or persist(df, *level))
    fitted = model.fit_forecaster(signal, SMALL, NAMES)
    assert model.permutation_importance(fitted, signal, repeats=3).count() == len(NAMES)
    assert kept and not any("_repeat" in columns for columns in kept)


def test_importance_ranks_the_signal(signal):
    fitted = model.fit_forecaster(signal, SMALL, NAMES)
    rows = model.permutation_importance(fitted, signal, repeats=4).collect()
    assert [r.feature for r in rows][0] == "a"
    got = {r.feature: r.importance for r in rows}
    assert got["a"] > got["b"] >= 0 and got["c"] == 0.0
    again = model.permutation_importance(fitted, signal, repeats=4).collect()
    assert {r.feature: r.importance for r in again} == pytest.approx(got)


def test_importance_matches_brute_force(signal):
    """Against a plain re-scoring of the same shuffles."""
    fitted = model.fit_forecaster(signal, SMALL, NAMES)
    got = {r.feature: r.importance for r in model.permutation_importance(fitted, signal, repeats=2).collect()}
    import random

    key = F.md5(F.concat_ws("|", F.lit("42"), *[F.col(c).cast("string") for c in evaluation.TIME_ORDER]))
    rows = signal.withColumn("_k", key).orderBy("_k").collect()
    draw = random.Random(42)
    shifts = [1 + int(draw.random() * (len(rows) - 1)) for _ in range(2)]
    mean = sum(r[TARGET] for r in rows) / len(rows)
    spread = sum((r[TARGET] - mean) ** 2 for r in rows)

    def error(frame):
        scored = fitted.transform(signal.sparkSession.createDataFrame(frame, f"a double, b double, c double, {TARGET} double"))
        return scored.agg(F.sum((F.col(TARGET) - F.col("predicted")) ** 2)).first()[0]

    plain = error([(r.a, r.b, r.c, r[TARGET]) for r in rows])
    losses = []
    for s in shifts:
        moved = [(rows[(i + s) % len(rows)].a, r.b, r.c, r[TARGET]) for i, r in enumerate(rows)]
        losses.append((error(moved) - plain) / spread)
    assert got["a"] == pytest.approx(sum(losses) / 2, rel=1e-9)


def test_rescoring_by_tree_equals_rescoring_whole(signal):
    """Every feature and repeat against the whole model; untouched trees are not run again."""
    params = model.ForecastParams(max_iter=12, max_depth=2, min_samples_leaf=5, early_stopping=False)
    rows, fitted = signal, model.fit_forecaster(signal, params, NAMES)
    trees = fitted.stages[-1]
    touched = model.trees_by_slot(trees)
    assert 2 not in touched and sum(map(len, touched.values())) < 2 * 12
    got = {r.feature: (r.importance, r.deviation) for r in model.permutation_importance(fitted, rows, repeats=3).collect()}
    import random
    from pyspark.ml.linalg import Vectors

    key = F.md5(F.concat_ws("|", F.lit("42"), *[F.col(c).cast("string") for c in evaluation.TIME_ORDER]))
    listed = rows.withColumn("_k", key).orderBy("_k").collect()
    draw, n = random.Random(42), len(listed)
    shifts = [1 + int(draw.random() * (n - 1)) for _ in range(3)]
    scaler = fitted.stages[1]
    scale = lambda r: [(v - m) / s if s else 0.0 for v, m, s in zip(r, scaler.mean, scaler.std)]
    x = [scale([r.a, r.b, r.c]) for r in listed]
    y = [r[TARGET] for r in listed]
    mean = sum(y) / n
    spread = sum((v - mean) ** 2 for v in y)

    def errors(tables):
        frame = signal.sparkSession.createDataFrame([(k, yy, Vectors.dense(v)) for k, t in enumerate(tables) for yy, v in zip(y, t)], ["k", "y", "scaled"])
        scored = trees.transform(frame).groupBy("k").agg(F.sum((F.col("y") - F.col("predicted")) ** 2).alias("e"))
        return {r.k: r.e for r in scored.collect()}

    moved = [[[*r[:i], x[(at + s) % n][i], *r[i + 1 :]] for at, r in enumerate(x)] for i in range(2) for s in shifts]
    found = errors([x, *moved])
    for i, name in enumerate("ab"):
        losses = [(found[1 + 3 * i + k] - found[0]) / spread for k in range(3)]
        assert got[name][0] == pytest.approx(sum(losses) / 3, rel=1e-6, abs=1e-9)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    rows = model.standardize(df, ["x", "k"]).orderBy("x").collect()
    assert [(r.x, r.k) for r in rows] == [(pytest.approx(-1.0), 0.0), (pytest.approx(1.0), 0.0)]


def test_missing_model(tmp_path):
    with pytest.raises(FileNotFoundError):
        model.load_model(str(tmp_path / "none"))


def test_train_then_predict(spark, tables, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    for season in (2023, 2024):
        for name, df in tables.items():
            catalog.land_season(df.where(F.col("Season") == season), root, name, season)
    features = matrix.build_features(spark, matrix.FeatureConfig(root, out, [2023, 2024]))
    made_up = workflow.train(spark, features, out, model.ForecastParams(max_iter=2, max_depth=2, n_splits=2))
    assert len(made_up) == 24
    assert spark.read.json(f"{out}/metrics").columns == ["fold_metrics", "mae", "r2", "rmse"]
    assert spark.read.json(f"{out}/learning_curve.json").count() == 20
    report = workflow.predict(spark, features, root, f"{out}/model", 2024, f"{out}/predictions")
    assert "Players by Predicted PIR for Round" in report and "Predicted PIR: " in report
    table = spark.read.json(f"{out}/predictions/player_predictions.json")
    assert {"PredictedPIR", "CurrentPIR", "PIRTrend", "Player", "Team", "Round"} <= set(table.columns)
    assert table.count() > 0


@pytest.fixture(scope="module")
def season(spark):
    games = [
        {"Player_ID": p, "Player": p.lower(), "Round": r, "Gamecode": r, "Points": r + i, "Team": "A"}
        for i, (p, last) in enumerate([("P1", 5), ("P2", 5), ("P3", 4), ("Total", 6)])
        for r in range(1, last + 1)
    ]
    return box_table(spark, games)


def test_totals_set_the_round_but_are_no_players(spark, season):
    features = boxscore.box_features(season).fillna(0)
    assert one(predict.latest_round(features, 2024)) == {"latest_round": 6, "next_round": 7}
    assert predict.active_players(features, 2024).count() == 0
    players = features.where("Player_ID <> 'Total'")
    assert {r.Player_ID for r in predict.active_players(players, 2024).collect()} == {"P1", "P2"}
    rows = predict.latest_active_rows(players, 2024).collect()
    assert {(r.Player_ID, r.Round) for r in rows} == {("P1", 5), ("P2", 5)}


def test_report_lines(spark, season):
    players = season.where("Player_ID <> 'Total'")
    features = boxscore.box_features(players).fillna(0)
    rows = predict.latest_active_rows(features, 2024).withColumn("predicted", F.col("pir_ma3"))
    table = predict.ranked_predictions(rows, features, players, 2024)
    assert [r.Player_ID for r in table.collect()] == ["P2", "P1"]
    assert one(predict.top_lines(table, 1)) == {"rank": 1, "line": "p2 (A)", "forecast_line": "Predicted PIR: 5.0"}
    importance = spark.createDataFrame([("x", 0.25), ("y", 0.5)], "feature string, importance double")
    text = predict.report_text(table, importance, top_n=1)
    assert "for Round 6" in text and text.index("y: 0.500") < text.index("x: 0.250")
    with pytest.raises(ValueError):
        predict.report_text(table.where("Round = 0"))


def test_player_with_two_teams_keeps_both_rows(spark):
    games = [{"Round": r, "Gamecode": r, "Team": t} for r, t in [(1, "A"), (2, "B")]]
    box = box_table(spark, games)
    features = boxscore.box_features(box).fillna(0)
    rows = predict.latest_active_rows(features, 2024).withColumn("predicted", F.lit(1.0))
    table = predict.ranked_predictions(rows, features, box, 2024)
    assert sorted(r.Team for r in table.collect()) == ["A", "B"]


def test_scoring_set_columns(tables):
    rows, _ = dataset.scoring_set(matrix.feature_matrix(tables))
    assert rows.columns == [*dataset.MODEL_FEATURES, *dataset.ID_COLUMNS, "PIR"]
