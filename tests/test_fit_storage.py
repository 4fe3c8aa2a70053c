"""What fits keep besides the learner's own binned rows."""

import pytest
from helpers import TINY, assert_same

from gamelog import queries
from gamelog.plans import dataset, evaluation, matrix, model
from gamelog.sources import samples

NAMES = ["a", "b"]
SMALL = model.ForecastParams(max_iter=2, max_depth=2, n_splits=2, min_samples_leaf=5)


@pytest.fixture(scope="module")
def rows(spark):
    table = [(2024, i // 10, i, f"P{i % 10}", float(i % 17), float(i % 5), float(i % 17 + i % 3)) for i in range(300)]
    return spark.createDataFrame(table, f"Season int, Round int, Gamecode int, Player_ID string, a double, b double, {dataset.TARGET} double")


def test_training_rows_are_files_of_what_a_fit_reads(spark, monkeypatch):
    """Nothing is cached, and only the columns of the order, the inputs and the target are written."""
    monkeypatch.setattr(model, "FIT_ROWS_EACH", 1000)
    stored, names = queries._training(spark, TINY)
    whole, made_up = dataset.training_set(matrix.feature_matrix(samples.game_tables(spark, TINY)))
    wanted = [*evaluation.time_order(whole), *[c for c in dataset.MODEL_FEATURES if c not in made_up], dataset.TARGET]
    assert sorted(stored.columns) == sorted(set(wanted)) and set(names) <= set(stored.columns)
    assert stored.inputFiles() and not stored.storageLevel.useDisk and not stored.storageLevel.useMemory
    assert_same(stored.select(*wanted), whole.select(*wanted))


def test_scaled_rows_take_no_disk(rows, monkeypatch):
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda df, *level: kept.append(persist(df, *level).storageLevel) or df)
    model.fit_forecaster(rows, SMALL, NAMES)
    model.cross_validate(rows, SMALL, NAMES)
    model.learning_curve(rows, SMALL, NAMES, fractions=(0.5, 1.0))
    assert kept and not any(level.useDisk for level in kept)


def test_fits_that_fill_the_cores_run_one_at_a_time(rows, monkeypatch):
    """Each keeps its binned rows and errors for as long as it runs."""
    seen, together = [], model.fit_together
    monkeypatch.setattr(model, "fit_together", lambda fits, at_once: seen.append(at_once) or together(fits, at_once))
    few = model.cross_validate(rows, SMALL, NAMES)
    model.learning_curve(rows, SMALL, NAMES, fractions=(0.5, 1.0))
    assert seen == [SMALL.parallel_fits] * 2
    monkeypatch.setattr(model, "FIT_ROUNDS", 1)
    monkeypatch.setattr(model, "FIT_ROWS_EACH", 10)
    assert model.fits_at_once(SMALL, 20) > 1 and model.fits_at_once(SMALL, 0) == SMALL.parallel_fits
    assert model.cross_validate(rows, SMALL, NAMES).columns == few.columns and seen[2:] == [1]
