"""Rolling, lead and exponentially weighted measures over an ordered series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gamelog.functions.scalars import ratio
from gamelog.operators.ordering import with_sequences

_AGGREGATES = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}


def rolling(
    value: Column, window: WindowSpec, size: int, how: str, min_periods: int | None = None
) -> Column:
    """Trailing aggregate of ``size`` rows; NULL with fewer than ``min_periods`` known values.

    ``min_periods`` is ``size`` unless given, so a NULL inside the frame blanks it.
    """
    frame = window.rowsBetween(-(size - 1), 0)
    needed = size if min_periods is None else min_periods
    return F.when(F.count(value).over(frame) >= needed, _AGGREGATES[how](value).over(frame))


def ewm_horizon(alpha: float) -> int:
    """Rows after which a weight is below 1e-19, i.e. invisible in a double.

    ``alpha`` lies between 0 and 1; at 1 only the row itself counts.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be above 0 and at most 1, not {alpha}")
    if alpha == 1:
        return 1
    return math.ceil(math.log(1e-19) / math.log(1.0 - alpha))


def ewm_reach(alpha: float) -> int:
    """How far back :func:`add_ewm_means` looks."""
    return 2 * ewm_horizon(alpha)


def add_ewm_means(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    alpha: float,
    null_rows: str = "carry",
) -> DataFrame:
    """Adjusted exponentially weighted means, ``{new column: value column}``.

    Weights decay by row position, also across NULLs. At a NULL row the result is the
    mean so far (``null_rows="carry"``) or NULL (``"null"``).

    The series is cut into blocks of :func:`ewm_horizon` rows. A row needs the running
    sum of its own block and the total of the block before it; older blocks weigh less
    than rounding. Each is one accumulator per row, where a frame of past values would
    cost a whole frame per row. Inside a block the terms are scaled by growing powers,
    at most 1e19, so nothing overflows.
    """
    if null_rows not in ("carry", "null"):
        raise ValueError(f"null_rows must be 'carry' or 'null', not {null_rows!r}")
    size = ewm_horizon(alpha)
    if alpha == 1:  # a weight of 0 for every earlier row
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = (lambda c: F.last(c, True).over(so_far)) if null_rows == "carry" else F.col
        return df.withColumns({name: last(source).cast("double") for name, source in columns.items()})
    decay = F.lit(1.0 - alpha)
    series = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(series) - 1).withColumns(
        {"_block": F.floor(F.col("_n") / size), "_j": F.col("_n") % size}
    )
    running = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_n")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    block_before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)

    # Ordered as the block sums leave the rows, so no further sort.
    so_far = Window.partitionBy(*keys).orderBy("_block", "_n")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    growth = F.pow(decay, -F.col("_j"))
    terms, here, past, means = {}, {}, {}, {}
    for name, source in columns.items():
        terms[f"_x_{name}"] = F.col(source).cast("double") * growth
        terms[f"_w_{name}"] = F.when(F.col(source).isNotNull(), growth)
    for term in terms:
        here[f"_here{term}"] = F.sum(term).over(running)
        # A block that has a successor is full, so its last running sum is its total.
        block_total = F.when(F.col("_j") == size - 1, F.col(f"_here{term}"))
        past[f"_past{term}"] = F.sum(block_total).over(block_before)

    def decayed(term: str) -> Column:
        carried = F.pow(decay, F.lit(size)) * F.col(f"_past{term}")
        sums = F.coalesce(F.col(f"_here{term}"), F.lit(0.0)) + F.coalesce(carried, F.lit(0.0))
        return F.pow(decay, F.col("_j")) * sums

    for name, source in columns.items():
        mean = ratio(decayed(f"_x_{name}"), decayed(f"_w_{name}"))
        if null_rows == "carry":
            means[name] = F.coalesce(mean, F.last(mean, True).over(so_far))
        else:
            means[name] = F.when(F.col(source).isNotNull(), mean)
    # Built on the running sums, the block totals reuse their sort.
    summed = numbered.withColumns(terms).withColumns(here).withColumns(past)
    return summed.withColumns(means).drop("_n", "_block", "_j", *terms, *here, *past)


def lead_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    hot: Sequence[int] = (),
) -> DataFrame:
    """The value of the next row of the same series, NULL on the last one."""

    def add(rows: DataFrame, parts: list[str]) -> DataFrame:
        return rows.withColumn(name, F.lead(value).over(Window.partitionBy(*parts).orderBy(*order)))

    return with_sequences(df, keys, order, add, after=1, hot=hot)
