"""Exact top-k inner products by a vector-approximation file.

The file holds one byte per component, the quantised cell, apart from the exact vectors. For
a block of queries all cells are scanned for lower and upper bounds of the scores. The kth
best lower bound over the whole file bars every vector whose upper bound is less. Exact
vectors of the rest are then read in the order of their bounds: the most promising ones
first, and after them only those whose bound still reaches the kth exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.tables import find_package, shuffle_partitions, stored

#: A cell spans at least so many bits of an integer; more where a byte could not hold it.
CELL_BITS = 1
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Vectors of each query that are read first, in multiples of k.
FIRST_READS = 4
#: Sums of products up to this are exact in doubles; larger ones get slack on both sides.
EXACT_DOUBLE = 2.0**53
SLACK = 2.0**-40


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, values): floor(scale * x) of vectors whose components are all finite
    numbers, without repeated rows."""
    x = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    values = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.filter(usable).select(F.col("vec_id").cast("long"), F.size(x).alias("dim"), values.alias("values")).distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def cell_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, dim, shift, ids, cells): the approximation file, a byte per component."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        dim, parts = table["dim"][0].as_py(), []
        for low in range(0, len(table), BLOCK_ROWS):
            piece = table.slice(low, BLOCK_ROWS).combine_chunks()
            values = _matrix(piece["values"].combine_chunks(), dim)
            widest = max(int(values.max(initial=0)), -int(values.min(initial=0)), 1).bit_length()
            shift = max(CELL_BITS, widest - 7)
            parts.append((dim, shift, piece["vec_id"].to_numpy().tobytes(), (values >> shift).astype(np.int8).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["dim", "shift", "ids", "cells"])

    placed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return placed.groupBy("block", "dim").applyInArrow(pack, "dim int, shift int, ids binary, cells binary")


def query_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """(dim, queries, values): exact query vectors side by side."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        dim, parts = table["dim"][0].as_py(), []
        for low in range(0, len(table), QUERY_ROWS):
            piece = table.slice(low, QUERY_ROWS).combine_chunks()
            parts.append((dim, piece["vec_id"].to_numpy().tobytes(), _matrix(piece["values"].combine_chunks(), dim).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["dim", "query_ids", "queries"])

    placed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return placed.groupBy("block", "dim").applyInArrow(pack, "dim int, query_ids binary, queries binary")


def score_bounds(queries: np.ndarray, cells: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with vectors in these cells."""
    q, edges = queries.astype(np.float64), cells.astype(np.float64) * 2.0**shift
    base, width = q @ edges.T, 2.0**shift - 1
    lower = base + width * np.minimum(q, 0).sum(1)[:, None]
    upper = base + width * np.maximum(q, 0).sum(1)[:, None]
    largest = np.abs(q).sum(1).max(initial=0) * (np.abs(edges).max(initial=0) + width)
    if largest >= EXACT_DOUBLE:
        lower, upper = lower - largest * SLACK, upper + largest * SLACK
    return lower, upper


def likely_pairs(cells: DataFrame, queries: DataFrame, shares: int, k: int) -> DataFrame:
    """(query_id, vec_id, lower, upper) of the pairs that the file does not rule out within a
    share of it. Every query block meets every share; a task holds one block of each. Spark
    takes the sent blocks for a few rows, however large, so nothing is left to it to broadcast."""
    sent = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = cells.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int"))
    pairs = sent.hint("merge").join(dealt, ["share", "dim"]).repartition(shuffle_partitions(cells.sparkSession), "share", "dim", "query_ids")
    pairs = pairs.sortWithinPartitions("share", "dim", "query_ids").select("share", "dim", "shift", "ids", "cells", "query_ids", "queries")

    def kept(query_ids, best: np.ndarray, found: list) -> Iterator[pa.RecordBatch]:
        """The pairs of one query block and share whose upper bounds reach its kth lower bound."""
        if found:
            at, ids, lower, upper = (np.concatenate(x) for x in zip(*found))
            stay = upper >= best[at, 0]
            yield pa.record_batch([query_ids[at[stay]], ids[stay], lower[stay], upper[stay]], names=["query_id", "vec_id", "lower", "upper"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, query_ids, best, found = None, None, None, []
        for batch in batches:
            for row in range(len(batch)):
                share, dim, shift, ids, raw, names, values = (c[row].as_py() for c in batch.columns)
                if (share, dim, names) != group:
                    yield from kept(query_ids, best, found)
                    group, query_ids, found = (share, dim, names), np.frombuffer(names, "<i8"), []
                    exact = np.frombuffer(values, "<i8").reshape(len(query_ids), dim)
                    best = np.full((len(query_ids), k), -np.inf)  # rising lower bounds
                ids = np.frombuffer(ids, "<i8")
                lower, upper = score_bounds(exact, np.frombuffer(raw, np.int8).reshape(len(ids), dim), shift)
                own = query_ids[:, None] == ids
                lower[own], upper[own] = -np.inf, -np.inf
                top = np.partition(lower, -k, axis=1)[:, -k:] if len(ids) > k else lower
                best = np.sort(np.concatenate([best, top], axis=1), axis=1)[:, -k:]
                at, of = np.nonzero((upper >= best[:, :1]) & ~own)
                found.append((at, ids[of], lower[at, of], upper[at, of]))
        yield from kept(query_ids, best, found)

    return pairs.mapInArrow(run, "query_id long, vec_id long, lower double, upper double")


def best_lower_bounds(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): the kth best lower bound over the whole file, -infinity with fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    ranked = pairs.select("query_id", "lower", F.row_number().over(order).alias("place")).filter(F.col("place") <= k)
    bar = F.max(F.when(F.col("place") == k, F.col("lower")))
    return ranked.groupBy("query_id").agg(F.coalesce(bar, F.lit(float("-inf"))).alias("bar"))


def exact_scores(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of the pairs: the only place where exact vectors are read.

    Files of pairs and vectors are several times smaller than their rows, so no side is
    broadcast for the size of its file."""
    of = lambda name, values: whole.select(F.col("vec_id").alias(name), F.col("values").alias(values), F.col("dim").alias(f"{name}_dim")).hint("merge")
    met = pairs.join(of("query_id", "q"), "query_id").join(of("vec_id", "v"), "vec_id").filter(F.col("query_id_dim") == F.col("vec_id_dim"))
    products = F.zip_with("q", "v", lambda a, b: a * b)
    return met.select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int, every: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k rows of every query vector.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows of the
    same length but those with the query's own vec_id. Vectors that are NULL, hold NULL or a
    non-finite component, or have a NULL vec_id take no part; rows equal in id and vector
    count once; vectors of different ids that are equal are ties, and ties go to the smaller
    vec_id. Different vectors of one id are scored each. Fewer than k candidates are all
    returned; a query without candidates has no rows. Scores are 64-bit integers; where a
    component or a score does not fit, the job fails. Other columns are not read.
    """
    spark = vectors.sparkSession
    find_package(spark)
    whole = stored(integer_vectors(vectors, scale))
    is_query = F.col("vec_id") % every == 0
    count, wanted = whole.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks = max(1, -(-count // BLOCK_ROWS))
    cells = stored(cell_blocks(whole, blocks))
    chosen = query_blocks(whole.filter(is_query), max(1, -(-wanted // QUERY_ROWS)))
    likely = stored(likely_pairs(cells, chosen, min(blocks, 4 * shuffle_partitions(spark)), k))
    open_pairs = likely.join(best_lower_bounds(likely, k).hint("merge"), "query_id").filter(F.col("upper") >= F.col("bar"))
    open_pairs = open_pairs.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    open_pairs = stored(open_pairs.withColumn("turn", F.row_number().over(by_bound)).select("query_id", "vec_id", "upper", "turn"))
    first = stored(exact_scores(open_pairs.filter(F.col("turn") <= FIRST_READS * k), whole))
    certain = ranked(first, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    rest = open_pairs.filter(F.col("turn") > FIRST_READS * k).join(certain.hint("merge"), "query_id", "left")
    rest = rest.filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("query_id", "vec_id")
    return ranked(first.unionByName(exact_scores(rest, whole)), k).select("query_id", "rank", "vec_id", "score")
