"""Ordered operators that never need a whole group, or the whole table, in one task.

A plain window sends each partition-by group to one task. That is the plan used
for ordinary groups. Groups that the caller names as hot (:mod:`gamelog.operators.skew`) are cut
into range chunks along the ordering, and each chunk borrows the few neighbouring
rows its frames can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.operators.skew import rows_behind, split_hot
from gamelog.operators.spread import spread
from gamelog.session import require_checkpoint_dir

CHUNK = "_chunk"


def range_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_chunk``: increasing along ``order``, one value per range partition.

    There are as many chunks as the session has shuffle partitions.

    Range bounds come from a sample, so a second planning of the same query may cut
    elsewhere. The result is checkpointed: every later reader, and every retried
    task, sees the same cut.
    """
    require_checkpoint_dir(df.sparkSession)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(partitions, *[F.col(c) for c in order])
    return cut.withColumn(CHUNK, F.spark_partition_id()).checkpoint()


def global_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based row number over the whole table in ``order``, without a one-task sort.

    ``order`` should be a total order; NULLs come first. Rows are numbered inside
    each range chunk and shifted by the rows of the chunks before it. Only the chunk
    sizes, one row per chunk, meet in one place.
    """
    chunks = range_chunks(df, order)
    earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        chunks.groupBy(CHUNK)
        .count()
        .select(CHUNK, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    return (
        chunks.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(shifts), CHUNK)
        .withColumn(name, F.col("_shift") + F.col("_inside") - 1)
        .drop(CHUNK, "_shift", "_inside")
    )


def with_sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    add: Callable[[DataFrame, list[str]], DataFrame],
    before: int = 0,
    after: int = 0,
    carry: Sequence[str] = (),
    hot: Sequence[int] = (),
) -> DataFrame:
    """Apply ``add(df, partition_columns)``, which adds window columns over ``order``.

    ``add`` may look at most ``before`` rows back and ``after`` rows ahead of each
    row. Only the columns in ``carry`` reach further: where NULL, they take their last
    known value. The keys in ``hot`` (see :func:`gamelog.operators.skew.hot_keys`) are
    processed in chunks; the result is the same as one window per key. Without them no
    job runs here. Where ``hot`` knows the table's rows, the others are dealt out in as many
    tasks as they need.
    """
    ordinary, apart = split_hot(df, keys, hot)
    result = add(spread(ordinary, keys, rows_behind(hot)), list(keys))
    if apart is None:
        return result
    keys, order = list(keys), list(order)
    chunks = range_chunks(apart, [*keys, *order])
    padded = _with_neighbours(chunks, keys, order, before, after)
    done = add(padded, [*keys, CHUNK]).where(~F.col("_borrowed")).drop("_borrowed")
    if carry:
        done = _carried(done, keys, order, carry)
    return result.unionByName(done.drop(CHUNK))


def _join_chunks(
    rows: DataFrame, listed: DataFrame, keys: list[str], chunk: str, how: str
) -> DataFrame:
    """Join rows with a list of chunks on the (null-safe) keys and ``_chunk`` = ``chunk``."""
    listed = listed.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = F.col(CHUNK) == F.col(chunk)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(listed, match, how).drop(*[f"_of_{k}" for k in keys])


def _with_neighbours(
    chunks: DataFrame, keys: list[str], order: list[str], before: int, after: int
) -> DataFrame:
    """Every chunk plus copies, marked ``_borrowed``, of the rows just outside it.

    Which chunks are near enough to borrow from is worked out on the list of chunk
    sizes: mostly the adjacent one, further ones if those between are short. A row's
    distance to a chunk is the rows between plus its distance to its own chunk's edge.
    """
    own = chunks.withColumn("_borrowed", F.lit(False))
    reach = max(before, after)
    if not reach:
        return own
    columns = [c for c in chunks.columns if c != CHUNK]
    sequence = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = F.collect_list(F.struct(F.col(CHUNK).alias("left"), F.col("_end").alias("end")))
    links = (
        chunks.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_end", F.sum("_size").over(sequence))
        .withColumn("_start", F.col("_end") - F.col("_size"))
        # Chunks have at least one row, so nothing further back is in reach.
        .withColumn("_earlier", earlier.over(sequence.rowsBetween(-reach, -1)))
        .select(*keys, F.col(CHUNK).alias("_right"), "_start", F.explode("_earlier").alias("_at"))
        .withColumns({"_left": F.col("_at.left"), "_gap": F.col("_start") - F.col("_at.end")})
        .where(F.col("_gap") < reach)
        .select(*keys, "_left", "_right", "_gap")
    )
    inside = Window.partitionBy(*keys, CHUNK)
    edges = (
        chunks.withColumn("_from_start", F.row_number().over(inside.orderBy(*order)))
        .withColumn("_to_end", F.count(F.lit(1)).over(inside) - F.col("_from_start") + 1)
        .where((F.col("_from_start") <= reach) | (F.col("_to_end") <= reach))
    )
    borrowed = []
    for use, distance, source, target in (
        (before, "_to_end", "_left", "_right"),
        (after, "_from_start", "_right", "_left"),
    ):
        if use:
            near = edges.where(F.col(distance) <= use)
            pairs = _join_chunks(near, links, keys, source, "inner")
            borrowed.append(
                pairs.where(F.col("_gap") + F.col(distance) <= use).select(
                    *columns, F.col(target).alias(CHUNK), F.lit(True).alias("_borrowed")
                )
            )
    for rows in borrowed:
        own = own.unionByName(rows)
    return own


def _carried(
    done: DataFrame, keys: list[str], order: list[str], names: Sequence[str]
) -> DataFrame:
    """Fill leading NULLs of each chunk with the last known value of the chunks before."""
    position = F.struct(*order)
    ends = done.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in names]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(
        *keys,
        F.col(CHUNK).alias("_at"),
        *[F.last(c, True).over(earlier).alias(f"_{c}") for c in names],
    )
    joined = _join_chunks(done, known, keys, "_at", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in names}
    return joined.withColumns(filled).select(*done.columns)
