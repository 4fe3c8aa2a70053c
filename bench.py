"""Wall-clock of the headline queries, as one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is built, planned and run in full (its rows go to the no-op sink). One
untimed query first starts the session. The fitted models come last.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gamelog.queries import registered  # noqa: E402
from gamelog.session import local_session  # noqa: E402

HEADLINE = (
    "scan_box",
    "scan_shots",
    "scan_plays",
    "rolling_means",
    "ewm_form",
    "box_features",
    "shot_quantiles",
    "shot_zone_distinct",
    "shot_features",
    "play_streaks",
    "play_and_matchup_features",
    "feature_matrix",
    "feature_matrix_season",
    "next_game_target",
    "aligned_training_set",
    "time_split_folds",
    "forecast_metrics",
    "prediction_table",
    "linear_cv_metrics",
    "next_predictions",
    "permutation_importance",
    "gbt_cv_metrics",
    "learning_curve",
)

# No query starts after so many seconds; those left out are named in the result.
LONGEST = float(os.environ.get("BENCH_SECONDS", "1500"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8 if cpus == "*" else int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered(), {}
    run_fully(queries["scan_box"](spark, folder))
    began, left_out = time.perf_counter(), []
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        if start - began > LONGEST:
            left_out.append(name)
            continue
        run_fully(queries[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "not_started": left_out,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


def run_fully(df) -> None:
    df.write.format("noop").mode("overwrite").save()


if __name__ == "__main__":
    main()
