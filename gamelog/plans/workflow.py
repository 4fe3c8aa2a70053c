"""The entry points: train on a feature matrix, and forecast the next round from it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gamelog.plans.dataset import MODEL_FEATURES, training_set
from gamelog.plans.evaluation import fold_metrics, metric_quartiles, metrics_record, scatter_bins
from gamelog.plans.model import (
    ForecastParams,
    cross_validate,
    fit_forecaster,
    learning_curve,
    load_model,
    permutation_importance,
    save_model,
)
from gamelog.plans.predict import (
    latest_active_rows,
    next_predictions,
    report_text,
    save_predictions,
)
from gamelog.plans.dataset import scoring_set
from gamelog.sources.catalog import (
    read_features,
    read_table,
    write_report_files,
)


def train(
    spark: SparkSession,
    features_path: str,
    output: str,
    params: ForecastParams = ForecastParams(),
) -> list[str]:
    """Fit and save the model and write how good it is; returns the made-up columns."""
    rows, made_up = training_set(read_features(spark, features_path))
    rows = rows.persist()
    names = [c for c in MODEL_FEATURES if c not in made_up]  # a constant tells nothing
    model = fit_forecaster(rows, params, names)
    save_model(model, f"{output}/model")
    forecasts = cross_validate(rows, params, names).persist()
    per_fold = fold_metrics(forecasts).persist()
    metrics_record(per_fold).coalesce(1).write.mode("overwrite").json(f"{output}/metrics")
    write_report_files(metric_quartiles(per_fold), f"{output}/metric_quartiles")
    write_report_files(scatter_bins(forecasts), f"{output}/forecast_scatter")
    write_report_files(learning_curve(rows, params, names), f"{output}/learning_curve")
    importance = permutation_importance(model, rows, names=MODEL_FEATURES)
    write_report_files(importance, f"{output}/feature_importance")
    for kept in (per_fold, forecasts, rows):
        kept.unpersist()
    return made_up


def predict(
    spark: SparkSession, features_path: str, stats_root: str, model_path: str, season: int, output: str
) -> str:
    """Forecast the next round, write the table and the importances, return the report."""
    features = read_features(spark, features_path)
    stats = read_table(spark, stats_root, "player_stats", [season])
    model = load_model(model_path)
    predictions = next_predictions(model, features, stats, season).persist()
    current, _ = scoring_set(latest_active_rows(features, season), MODEL_FEATURES)
    importance = permutation_importance(model, current, target="PIR", names=MODEL_FEATURES)
    save_predictions(predictions, importance, output)
    report = report_text(predictions, importance)
    predictions.unpersist()
    return report
