"""Shuffled inputs are looked up in tables of leaf masks."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor

from gamelog.plans import model, tree_tables


@pytest.fixture(scope="module")
def fitted(spark):
    """Trees of up to 128 leaves, so with several words of bits, over two used inputs and a constant."""
    rng = np.random.default_rng(3)
    rows = [(float(3 * a + (b > 0.5) * a), Vectors.dense(a, 1.0, b)) for a, b in rng.random((900, 2)).round(2)]
    df = spark.createDataFrame(rows, ["y", "scaled"]).coalesce(1)
    return df, GBTRegressor(featuresCol="scaled", labelCol="y", predictionCol="predicted", maxIter=4, maxDepth=7).fit(df)


def test_errors_equal_those_of_whole_forecasts(spark, fitted):
    df, trees = fitted
    tables = tree_tables.tree_tables(trees)
    assert tables.slots == [0, 2] and max(len(t.values) for t in tables.trees) > 1
    x = np.array([r.scaled.toArray() for r in df.collect()])[:50]
    x[7, 2], x[8, 0] = float("nan"), tables.thresholds[0][3]  # goes right; equal to a threshold goes left
    y, known = np.arange(50.0), np.arange(50) % 7 != 0
    shifts = (1, 20, 49)
    tried = [x, *[np.column_stack([np.roll(x[:, c], -s) if c == slot else x[:, c] for c in range(3)]) for slot in (0, 2) for s in shifts]]
    wanted = []
    for values in tried:
        frame = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(values)], ["i", "scaled"])
        forecasts = np.array([r.predicted for r in trees.transform(frame).orderBy("i").collect()])
        wanted.append(float(np.sum((y - forecasts)[known] ** 2)))
    codes = tables.codes(x).T
    donors = np.stack([[np.roll(of, -s) for s in shifts] for of in codes])
    plain, moved = tree_tables.squared_errors(tables, y, known, codes, donors)
    assert [plain, *moved.ravel()] == pytest.approx(wanted, rel=1e-12)


def test_slices_of_blocks_give_every_row_its_donor(spark, fitted, monkeypatch):
    """Shuffles over block borders and the end, in blocks that do not divide the rows."""
    df, trees = fitted
    tables = tree_tables.tree_tables(trees)
    x = np.array([r.scaled.toArray() for r in df.collect()])[:50]
    y = [None if i % 7 == 0 else float(i) for i in range(50)]
    known = np.array([v is not None for v in y])
    rows = spark.createDataFrame([(i, y[i], v.tolist()) for i, v in enumerate(x)], "_at long, _y double, _x array<double>").repartition(3)
    shifts = (1, 8, 33, 49)
    codes = tables.codes(x).T
    donors = np.stack([[np.roll(of, -s) for s in shifts] for of in codes])
    plain, moved = tree_tables.squared_errors(tables, np.array([v or 0.0 for v in y]), known, codes, donors)
    monkeypatch.setattr(tree_tables, "BLOCK_ROWS", 8)
    found = tree_tables.errors_by_tree(tables, tree_tables.coded(rows, tables, "_x", "_codes"), 50, shifts)
    got = {(r["_repeat"], r["_slot"]): r["_squared"] for r in found.collect()}
    wanted = {(-1, -1): plain} | {(r, s): moved[k, r] for k, s in enumerate(tables.slots) for r in range(4)}
    assert got == pytest.approx(wanted, rel=1e-12)


def test_shuffled_rows_are_not_scored(spark, monkeypatch):
    """A shuffle costs no forecast of its own, and what is ordered and sent are codes."""
    rng = np.random.default_rng(4)
    table = [(1, 1, i, "x", float(a), float(b), float(2 * a + b)) for i, (a, b) in enumerate(rng.random((300, 2)))]
    rows = spark.createDataFrame(table, "Season int, Round int, Gamecode long, Player_ID string, a double, b double, next_PIR double")
    forecaster = model.fit_forecaster(rows, model.ForecastParams(max_iter=3, max_depth=2, early_stopping=False), ["a", "b"])
    scored, indexed = [], []
    plain, index = GBTRegressionModel.transform, model.global_row_index
    monkeypatch.setattr(GBTRegressionModel, "transform", lambda self, frame, *others: scored.append(1) or plain(self, frame, *others))
    monkeypatch.setattr(model, "global_row_index", lambda frame, *others: indexed.append(dict(frame.dtypes)) or index(frame, *others))
    assert model.permutation_importance(forecaster, rows, repeats=3).count() == 2
    assert not scored and indexed[0]["_codes"] == "binary" and "_x" not in indexed[0]
