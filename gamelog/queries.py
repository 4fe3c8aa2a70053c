"""Registered queries: every operator, run over whole tables of a source folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gamelog.functions.aggregates import distinct_with_null, success_rate
from gamelog.functions.scalars import clock_minutes, round_half_up
from gamelog.operators import quarantine, sketches
from gamelog.operators.quantile import nearest_quantiles
from gamelog.operators.series import add_ewm_means, ewm_reach, rolling
from gamelog.operators.ordering import global_row_index, with_sequences
from gamelog.operators.skew import hot_keys, hot_keys_of, rows_behind
from gamelog.operators.spread import spread, tasks_for
from gamelog.plans import boxscore, dataset, evaluation, increment, matrix, model, plays, predict, shots
from gamelog.plans.feature_set import KEYS, chain, keyed, series_order, transform_together
from gamelog.session import release_shuffles, scratch_path, stored
from gamelog.sources import catalog, samples

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

SEASON = 2024
GAME = ("Season", "Player_ID", "Gamecode")
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums of doubles differ in the last bits by summing order."""
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: round_half_up(F.col(c), DIGITS) for c in doubles}) if doubles else df


def query(build: Query) -> Query:
    """Register under the function's name, results rounded for comparison."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(build(spark, folder))

    _QUERIES[build.__name__] = run
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _shots(spark: SparkSession, folder: str) -> DataFrame:
    return shots.add_distance(keyed(samples.shot_data(spark, folder), "shot_data"))


def _plays(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(samples.playbyplay(spark, folder), "playbyplay")


def _matrix(spark: SparkSession, folder: str, season: int | None = None) -> DataFrame:
    tables = samples.game_tables(spark, folder)
    return matrix.feature_matrix(tables, season=season, hot=matrix.find_hot(tables))


def _box_matrix(spark: SparkSession, folder: str) -> DataFrame:
    tables = samples.game_tables(spark, folder)
    hot = matrix.find_hot(tables, ["player_stats"])
    return matrix.feature_matrix(tables, ["combined_stats"], hot=hot)


# The share of the rows from which the ``_split`` queries set a key apart: any, so that
# the plan for hot keys runs at every size.
ANY_SHARE = 0.0


# --- sources -----------------------------------------------------------------


@query
def scan_box(spark, folder):
    return samples.player_stats(spark, folder)


@query
def scan_shots(spark, folder):
    return samples.shot_data(spark, folder)


@query
def scan_plays(spark, folder):
    return samples.playbyplay(spark, folder)


@query
def raw_manifest(spark, folder):
    return catalog.season_counts(samples.game_tables(spark, folder))


SEASONS = (2023, 2024)


def _landed(spark, folder):
    """The sample tables landed in a new store, all seasons of a table at once; its path and
    manifest."""
    root = scratch_path(spark)
    return root, catalog.land_tables(spark, samples.game_tables(spark, folder), root, SEASONS)


@query
def landed_manifest(spark, folder):
    return _landed(spark, folder)[1].drop("path")


@query
def feature_matrix_landed(spark, folder):
    root, _ = _landed(spark, folder)
    return catalog.read_features(spark, matrix.build_features(spark, matrix.FeatureConfig(root, root, SEASONS)))


@query
def feature_matrix_bucketed(spark, folder):
    tables, name = samples.game_tables(spark, folder), f"features_{uuid.uuid4().hex}"
    hot = matrix.find_hot(tables)
    parts = matrix.matrix_parts(tables, hot=hot)
    buckets = tasks_for(spark, matrix.most_rows(hot))
    return matrix.stored_matrix(spark, matrix.store_parts(parts, name, scratch_path(spark), buckets))


# Bad cells at known places, for the lenient casts.


def _checked_clocks(spark, folder):
    box = samples.player_stats(spark, folder)
    clocks = F.when(F.col("Gamecode") % 29 == 0, F.concat(F.lit("x"), "Minutes")).otherwise(F.col("Minutes"))
    parsed = {"minutes_played": ("Minutes", clock_minutes(F.col("Minutes"), strict=False))}
    return quarantine.checked(box.withColumn("Minutes", clocks), parsed)


def _checked_flags(spark, folder):
    rows = samples.shot_data(spark, folder)
    flag = F.when(F.col("Gamecode") % 31 == 0, F.lit("n/a")).otherwise(F.col("FASTBREAK"))
    return quarantine.checked(rows.withColumn("FASTBREAK", flag), quarantine.casts({"FASTBREAK": "int", "SECOND_CHANCE": "int"}))


@query
def lenient_minutes(spark, folder):
    return quarantine.good_rows(_checked_clocks(spark, folder)).select("Gamecode", "Minutes", "minutes_played")


@query
def lenient_flags(spark, folder):
    rows = quarantine.good_rows(_checked_flags(spark, folder))
    return rows.groupBy("ID_PLAYER").agg(F.sum("FASTBREAK").alias("fastbreaks"), F.sum("SECOND_CHANCE").alias("second_chances"), F.count("FASTBREAK").alias("known"))


@query
def quarantined_cells(spark, folder):
    written = [quarantine.write_checked(_checked_clocks(spark, folder), scratch_path(spark), ["Gamecode"])]
    written.append(quarantine.write_checked(_checked_flags(spark, folder), scratch_path(spark), ["Gamecode"]))
    return written[0][1].unionByName(written[1][1])


# --- box score ---------------------------------------------------------------


@query
def clock_minutes_played(spark, folder):
    box = samples.player_stats(spark, folder)
    return box.select("Gamecode", "Minutes", clock_minutes(F.col("Minutes")).alias("minutes_played"))


@query
def shooting_percentages(spark, folder):
    return boxscore.add_shooting(samples.player_stats(spark, folder)).select(
        *GAME, "fg_percentage", "fg_percentage_2pt", "fg_percentage_3pt", "ft_percentage"
    )


@query
def true_shooting(spark, folder):
    return boxscore.add_shooting(samples.player_stats(spark, folder)).select(
        *GAME, "true_shooting_percentage"
    )


@query
def pir(spark, folder):
    return boxscore.add_shooting(samples.player_stats(spark, folder)).select(*GAME, "PIR")


def _rolled(spark, folder, how, columns, share=None):
    stats = samples.player_stats(spark, folder)
    hot = hot_keys(stats, boxscore.SERIES_KEYS, share)
    box = boxscore.add_shooting(stats)
    order = series_order(box)

    def add(rows, parts):
        series = Window.partitionBy(*parts).orderBy(*order)
        return rows.withColumns(
            {
                f"{name}_ma{n}": rolling(F.col(source), series, n, how)
                for n in boxscore.WINDOW_SIZES
                for name, source in columns.items()
            }
        )

    reach = max(boxscore.WINDOW_SIZES) - 1
    rolled = with_sequences(box, boxscore.SERIES_KEYS, order, add, before=reach, hot=hot)
    names = [f"{name}_ma{n}" for n in boxscore.WINDOW_SIZES for name in columns]
    return rolled.select(*GAME, *names)


MEANS = {"minutes": "minutes_played", "Points": "Points", "pir": "PIR"}


@query
def rolling_means(spark, folder):
    return _rolled(spark, folder, "mean", MEANS)


@query
def rolling_means_split(spark, folder):
    return _rolled(spark, folder, "mean", MEANS, ANY_SHARE)


@query
def rolling_std(spark, folder):
    return _rolled(spark, folder, "std", {"pir_std": "PIR"})


def _weighted(spark, folder, share=None):
    stats = samples.player_stats(spark, folder)
    hot = hot_keys(stats, boxscore.SERIES_KEYS, share)
    box = boxscore.add_shooting(stats)
    order, alpha = series_order(box), boxscore.EWM_ALPHA

    def add(rows, parts):
        weighted = {"pir_ewm": "PIR", "points_ewm": "Points"}
        return add_ewm_means(rows, parts, order, weighted, alpha)

    names, reach = ["pir_ewm", "points_ewm"], ewm_reach(alpha)
    weighted = with_sequences(box, boxscore.SERIES_KEYS, order, add, before=reach, carry=names, hot=hot)
    return weighted.select(*GAME, *names)


@query
def ewm_form(spark, folder):
    return _weighted(spark, folder)


@query
def ewm_form_split(spark, folder):
    return _weighted(spark, folder, ANY_SHARE)


@query
def recent_form(spark, folder):
    stats = samples.player_stats(spark, folder)
    hot = hot_keys(stats, boxscore.SERIES_KEYS)
    steps = (boxscore.add_shooting, partial(boxscore.add_form, hot=hot))
    return chain(steps, stats).select(
        *GAME, "pir_ma3", "pir_ma10", "recent_form"
    )


@query
def box_features(spark, folder):
    stats = samples.player_stats(spark, folder)
    return boxscore.box_features(stats, hot_keys(stats, boxscore.SERIES_KEYS))


# The last rounds of each season, and some games of earlier ones, arrive after the rest.
LAST_ROUNDS = 6


@query
def box_features_advanced(spark, folder):
    stats = samples.player_stats(spark, folder)
    # one row per season; a window would put a season into one task
    last = stats.groupBy(F.col("Season").alias("_season")).agg(F.max("Round").alias("_last"))
    late = (F.col("Round") > F.col("_last") - LAST_ROUNDS) | (F.col("Gamecode") % 997 == 0)
    dated = stats.join(F.broadcast(last), F.col("Season").eqNullSafe(F.col("_season")))
    rows = dated.withColumn("_late", F.coalesce(late, F.lit(False))).drop("_season", "_last")
    old, new = (rows.where(c).drop("_late") for c in (~F.col("_late"), F.col("_late")))
    columns = (*boxscore.PASSED_ON, *boxscore.FEATURES)
    hot = hot_keys(stats, boxscore.SERIES_KEYS)
    stored = boxscore.make_set(hot).transform(old)
    # the parts of a step are dealt out by their series, once each
    old, new, history = (spread(part, boxscore.SERIES_KEYS, rows_behind(hot)) for part in (old, new, stats))
    step = increment.advance(increment.form_state(old), new, history)
    return increment.merged(stored, step).select(*columns)


# --- shots -------------------------------------------------------------------


@query
def shot_geometry(spark, folder):
    return _shots(spark, folder).select(
        *KEYS, "COORD_X", "COORD_Y", "shot_distance", shots.shot_angle().alias("shot_angle")
    )


@query
def shot_quality_class(spark, folder):
    bands = [c.alias(f"is_{name}") for name, c in shots.distance_bands().items()]
    return _shots(spark, folder).select(
        *KEYS,
        shots.shot_quality().alias("shot_quality"),
        shots.shot_points().alias("points_scored"),
        *bands,
    )


def _shot_measures(spark, folder, *names):
    measures = shots.shot_measures()
    return _shots(spark, folder).groupBy(*KEYS).agg(*[measures[n].alias(n) for n in names])


@query
def shot_spread(spark, folder):
    names = ("shot_distance_variation", "court_coverage_area", "shot_angle_spread")
    return _shot_measures(spark, folder, *names)


def _quantiles(spark, folder, share=None):
    rows = _shots(spark, folder)
    return nearest_quantiles(rows, KEYS, "shot_distance", shots.QUARTILES, hot=hot_keys(rows, KEYS, share))


@query
def shot_quantiles(spark, folder):
    return _quantiles(spark, folder)


@query
def shot_quantiles_split(spark, folder):
    return _quantiles(spark, folder, ANY_SHARE)


@query
def shot_zone_distinct(spark, folder):
    zones = distinct_with_null(F.col("ZONE")).alias("unique_scoring_zones")
    return _shots(spark, folder).groupBy(*KEYS).agg(zones)


# Sketches are stored per player and game and merged to seasons; the queries give the exact
# figures and whether the estimates keep their bounds.


def _season_sketches(spark, folder):
    rows = _shots(spark, folder)
    fine = sketches.sketched(rows, KEYS, {"zones": "ZONE"}, {"distances": "shot_distance"})
    return rows, sketches.merged(fine, ["Season"], ["zones"], ["distances"])


@query
def approx_zones(spark, folder):
    rows, coarse = _season_sketches(spark, folder)
    exact = rows.groupBy("Season").agg(distinct_with_null(F.col("ZONE")).alias("zones_exact"))
    found = coarse.select("Season", "n", sketches.distinct_estimate("zones").alias("zones"))
    near = F.abs(F.col("zones") - F.col("zones_exact")) <= 3 * 0.016 * F.col("zones_exact")
    return found.join(exact, "Season").select("Season", "n", F.col("zones_exact").alias("zones"), near.alias("within_bound"))


@query
def approx_quartiles(spark, folder):
    rows, coarse = _season_sketches(spark, folder)
    estimates = {name: sketches.quantile_estimate("distances", q).alias(name) for name, q in shots.QUARTILES.items()}
    known = F.col("shot_distance").isNotNull()
    ranked = rows.join(coarse.select("Season", *estimates.values()), "Season").groupBy("Season").agg(
        F.count_if(known).alias("n"),
        *[F.count_if(F.col("shot_distance") < F.col(name)).alias(f"{name}_below") for name in estimates],
        *[F.count_if(F.col("shot_distance") <= F.col(name)).alias(f"{name}_upto") for name in estimates],
    )
    error = sketches.RANK_ERROR
    within = [
        ((F.col(f"{name}_below") / F.col("n") <= q + error) & (F.col(f"{name}_upto") / F.col("n") >= q - error)).alias(name)
        for name, q in shots.QUARTILES.items()
    ]
    return ranked.select("Season", "n", *within)


@query
def shot_success_by_distance(spark, folder):
    made = shots.is_made()
    rates = {f"{n}_percentage": success_rate(made, c) for n, c in shots.distance_bands().items()}
    return _shots(spark, folder).groupBy(*KEYS).agg(*[c.alias(n) for n, c in rates.items()])


@query
def effective_fg(spark, folder):
    names = (
        "effective_fg_percentage",
        "points_per_shot",
        "fastbreak_fg_percentage",
        "second_chance_fg_percentage",
    )
    return _shot_measures(spark, folder, *names)


@query
def shot_features(spark, folder):
    raw = keyed(samples.shot_data(spark, folder), "shot_data")
    return shots.make_set(hot=hot_keys(raw, KEYS)).transform(raw)


# --- plays -------------------------------------------------------------------


@query
def play_flags(spark, folder):
    rules = plays.PlayRules()
    kinds = [k for k in plays.TOKENS if k not in ("scoring_attempt", "disruption")]
    return _plays(spark, folder).select(
        *KEYS,
        "NUMBEROFPLAY",
        *[rules.kind(k).alias(f"is_{k}") for k in kinds],
        plays.is_positive().alias("is_positive"),
        rules.clutch(rules.clutch_minute).alias("is_clutch"),
        rules.clutch(rules.super_clutch_minute).alias("is_super_clutch"),
        plays.score_margin().alias("score_diff"),
        (F.abs(plays.score_margin()) <= rules.close_margin).alias("is_close"),
        rules.impact().alias("play_impact"),
    )


def _play_measures(spark, folder, *names):
    rules = plays.PlayRules()
    rows = _plays(spark, folder).withColumn("play_impact", rules.impact())
    measures = plays.play_measures(rules)
    chosen = rows.groupBy(*KEYS).agg(*[measures[n].alias(n) for n in names])
    return chosen.fillna(0, subset=list(names))


@query
def play_counts(spark, folder):
    return _play_measures(spark, folder, *plays.PLAY_FEATURES[:8])


@query
def play_rates(spark, folder):
    return _play_measures(spark, folder, *plays.PLAY_FEATURES[8:16])


@query
def play_impact(spark, folder):
    names = ("avg_play_impact", "total_play_impact", "clutch_play_impact")
    return _play_measures(spark, folder, *names)


@query
def score_volatility(spark, folder):
    return _play_measures(spark, folder, "game_volatility", "close_game_time_ratio")


def _play_set(spark, folder, rules=plays.PlayRules(), share=None):
    rows = _plays(spark, folder)
    return plays.make_play_set(rules, hot_keys(rows, KEYS, share)).transform(rows)


@query
def play_streaks(spark, folder):
    return _play_set(spark, folder).select(*KEYS, *plays.PLAY_FEATURES[-3:])


@query
def play_streaks_split(spark, folder):
    return _play_set(spark, folder, share=ANY_SHARE).select(*KEYS, *plays.PLAY_FEATURES[-3:])


@query
def play_features(spark, folder):
    return _play_set(spark, folder)


@query
def play_features_exact(spark, folder):
    return _play_set(spark, folder, plays.PlayRules(exact=True))


@query
def matchup_features(spark, folder):
    return plays.make_matchup_set().transform(_plays(spark, folder))


@query
def play_and_matchup_features(spark, folder):
    rows = _plays(spark, folder)
    sets = [plays.make_play_set(hot=hot_keys(rows, KEYS)), plays.make_matchup_set()]
    return transform_together(sets, rows)


# --- feature matrix ----------------------------------------------------------


@query
def feature_matrix(spark, folder):
    return _matrix(spark, folder)


@query
def feature_matrix_season(spark, folder):
    return _matrix(spark, folder, SEASON)


@query
def season_union(spark, folder):
    box = samples.player_stats(spark, folder)
    seasons = [box.where(F.col("Season") == s) for s in (2023, 2024)]
    return catalog.union_seasons(seasons)


@query
def feature_summary(spark, folder):
    return matrix.feature_summary(_matrix(spark, folder))


# --- model input -------------------------------------------------------------


def _next_games(spark, folder, share=None):
    stats = samples.player_stats(spark, folder)
    sets = {"player_stats": (stats, boxscore.SERIES_KEYS), "player": (stats, ["Player_ID"])}
    hot = hot_keys_of(sets, share)
    features = matrix.feature_matrix({"player_stats": stats}, ["combined_stats"], hot=hot)
    return dataset.with_next_game(features, hot=hot["player"])


@query
def next_game_target(spark, folder):
    return _next_games(spark, folder).select(*GAME, "PIR", "next_PIR")


@query
def next_game_target_split(spark, folder):
    return _next_games(spark, folder, ANY_SHARE).select(*GAME, "PIR", "next_PIR")


@query
def next_game_target_in_season(spark, folder):
    led = dataset.with_next_game(_box_matrix(spark, folder), scope="season_player")
    return led.select(*GAME, "PIR", "next_PIR")


@query
def aligned_training_set(spark, folder):
    rows, _ = dataset.training_set(_matrix(spark, folder))
    return rows.select(*GAME, *dataset.MODEL_FEATURES, dataset.TARGET)


@query
def scoring_set(spark, folder):
    return dataset.scoring_set(_matrix(spark, folder))[0]


@query
def scaled_features(spark, folder):
    rows, _ = dataset.training_set(_matrix(spark, folder))
    scaled = model.standardize(rows, dataset.MODEL_FEATURES)
    return scaled.select(*GAME, *dataset.MODEL_FEATURES)


# --- evaluation; the forecast is the three-game mean, so SQL can repeat it ----


def _timed(spark, folder):
    rows = _next_games(spark, folder)
    return rows.select(*GAME, "Round", "Team", "pir_ma3", "next_PIR").persist()


def _folded(spark, folder):
    return evaluation.with_time_folds(_timed(spark, folder))


def _trend_forecasts(spark, folder):
    return (
        _folded(spark, folder)
        .where(F.col("test_fold") > 0)
        .select(
            F.col("test_fold").alias("fold"),
            F.col("next_PIR").cast("double").alias("actual"),
            F.col("pir_ma3").alias("predicted"),
        )
    )


@query
def time_split_folds(spark, folder):
    folded = _folded(spark, folder)
    numbered = global_row_index(folded, evaluation.time_order(folded))
    return numbered.select(*GAME, "Round", "row_index", "test_fold")


@query
def forecast_metrics(spark, folder):
    return evaluation.fold_metrics(_trend_forecasts(spark, folder))


@query
def mean_forecast_metrics(spark, folder):
    return evaluation.mean_metrics(evaluation.fold_metrics(_trend_forecasts(spark, folder)))


@query
def metrics_record(spark, folder):
    return evaluation.flat_metrics_record(evaluation.fold_metrics(_trend_forecasts(spark, folder)))


@query
def metric_quartiles(spark, folder):
    return evaluation.metric_quartiles(evaluation.fold_metrics(_trend_forecasts(spark, folder)))


@query
def oof_scatter_bins(spark, folder):
    return evaluation.scatter_bins(_trend_forecasts(spark, folder), width=5.0)


# --- prediction --------------------------------------------------------------


@query
def latest_round(spark, folder):
    return predict.latest_round(samples.player_stats(spark, folder), SEASON)


@query
def active_players(spark, folder):
    return predict.active_players(_box_matrix(spark, folder), SEASON)


@query
def latest_per_player(spark, folder):
    rows = predict.latest_active_rows(_box_matrix(spark, folder), SEASON)
    return rows.select("Player_ID", "Round", "Gamecode", "PIR", "pir_ma3", "minutes_played", "Points")


@query
def player_meta(spark, folder):
    stats = samples.player_stats(spark, folder)
    return predict.player_meta(stats, predict.active_players(stats, SEASON), SEASON)


def _trend_predictions(spark, folder):
    stats = samples.player_stats(spark, folder)
    games = {"player_stats": predict.games_of_active(stats, SEASON)}
    features = matrix.feature_matrix(games, ["combined_stats"], hot=matrix.find_hot(games))
    rows = predict.latest_active_rows(features, SEASON).withColumn("predicted", F.col("pir_ma3"))
    return predict.ranked_predictions(rows, features, stats, SEASON)


@query
def prediction_table(spark, folder):
    return _trend_predictions(spark, folder)


@query
def top_n_report(spark, folder):
    return predict.top_lines(_trend_predictions(spark, folder), top_n=20)


# --- fitted models -----------------------------------------------------------
# A least-squares line on the three-game mean is what SQL can repeat; the boosted trees run
# the same code with the default learner.

LINE = ["pir_ma3"]


@query
def linear_cv_metrics(spark, folder):
    forecasts = model.cross_validate(_timed(spark, folder), names=LINE, fit=model.fit_linear)
    return evaluation.fold_metrics(forecasts)


@query
def linear_learning_curve(spark, folder):
    return model.learning_curve(_timed(spark, folder), names=LINE, fit=model.fit_linear)


@query
def linear_importance(spark, folder):
    rows = _timed(spark, folder)
    return model.permutation_importance(model.fit_forecaster(rows, names=LINE, fit=model.fit_linear), rows)


LINES = ["pir_ma3", "minutes_played", "Points"]


@query
def linear_importances(spark, folder):
    rows = _next_games(spark, folder).select(*GAME, "Round", "Team", *LINES, "next_PIR").persist()
    return model.permutation_importance(model.fit_forecaster(rows, names=LINES, fit=model.fit_linear), rows)


def _training(spark, folder):
    """The training rows, kept, and the model inputs that some feature set provides.

    A fit reads its rows many times. They are cached if they are few enough for one task of it.
    Others are kept as files of the columns that it reads, and what was shuffled to make them
    goes before the fit begins.
    """
    kept = _kept_training(spark, folder)
    release_shuffles(spark)
    return kept


def _kept_training(spark, folder):
    tables = samples.game_tables(spark, folder)
    sets = {name: (keyed(tables[name], name), keys) for name, keys in matrix.SEQUENCE_KEYS.items()}
    hot = hot_keys_of(sets | {"player": (sets["player_stats"][0], ["Player_ID"])})
    rows, made_up = dataset.training_set(matrix.feature_matrix(tables, hot=hot), hot=hot["player"])
    names = [c for c in dataset.MODEL_FEATURES if c not in made_up]
    known = rows_behind(hot["player"])
    if known is not None and known <= model.FIT_ROWS_EACH:
        return rows.persist(), names
    return stored(rows.select(*dict.fromkeys([*evaluation.time_order(rows), *names, dataset.TARGET]))), names


@query
def gbt_cv_metrics(spark, folder):
    rows, names = _training(spark, folder)
    return evaluation.fold_metrics(model.cross_validate(rows, names=names))


@query
def learning_curve(spark, folder):
    rows, names = _training(spark, folder)
    return model.learning_curve(rows, names=names)


@query
def permutation_importance(spark, folder):
    rows, names = _training(spark, folder)
    fitted = model.fit_forecaster(rows, names=names)
    return model.permutation_importance(fitted, rows, names=dataset.MODEL_FEATURES)


@query
def next_predictions(spark, folder):
    rows, names = _training(spark, folder)
    fitted = model.fit_forecaster(rows, names=names)
    stats = samples.player_stats(spark, folder)
    return predict.next_predictions(fitted, _matrix(spark, folder), stats, SEASON)
