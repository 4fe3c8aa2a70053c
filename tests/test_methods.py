"""Generated methods must stay short enough to be compiled, and rounding exact."""

import re

import pytest
from helpers import TINY
from pyspark.sql import functions as F

from gamelog import queries
from gamelog.functions.scalars import round_half_up

# HotSpot interprets longer methods for ever.
COMPILED_BYTES = 8000


@pytest.mark.parametrize("name", ["scoring_set", "scaled_features", "feature_matrix", "aligned_training_set"])
def test_methods_of_wide_tables_are_compiled(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        planned = queries.registered()[name](spark, TINY)._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", planned.explainString(mode))]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sizes and max(sizes) <= COMPILED_BYTES


def test_quick_rounding_is_round_bit_for_bit(spark):
    ties = [k / 128 for k in range(-400, 400)] + [k / 1e7 + 5e-7 for k in range(-300, 300)]
    near = [x * (1 + e) for x in ties for e in (-3e-16, 3e-16, 1e-9)]
    odd = [0.0, -0.0, -1e-9, 1e6, 999999.9999995, -999999.9999995, 1e12 + 0.3, 1e300, -1e18, 5e-324, 0.1 + 0.2, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(x,) for x in [*ties, *near, *odd]], "x double")
    spread_out = spark.range(200_000).select(((F.xxhash64("id") % 10**9) / F.lit(12347.0)).alias("x"))
    for rows in (df, spread_out):
        quick, plain = round_half_up(F.col("x"), 6), F.round("x", 6)
        assert rows.where(~quick.eqNullSafe(plain)).count() == 0
        # also the sign of zero
        assert rows.where(quick.cast("string") != plain.cast("string")).count() == 0


def test_unknown_keys_match_nothing(spark):
    from gamelog.plans import matrix

    base = spark.createDataFrame([(2024, "a", None, 1.5), (2024, "a", 0, None)], "Season int, Player_ID string, Gamecode bigint, x double")
    part = spark.createDataFrame([(2024, "a", 0, 7)], "Season int, Player_ID string, Gamecode bigint, y bigint")
    rows = sorted(tuple(r) for r in matrix.joined_parts(base, [part]).select("Gamecode", "x", "y").collect())
    assert rows == [(0, 0.0, 7), (0, 1.5, 0)]
