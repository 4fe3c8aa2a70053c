"""Centroid clustering with progressive nearest-centroid search in the Walsh-Hadamard domain.

The transform of integers is exact and keeps squared distances up to a factor, so distances
can be summed coefficient by coefficient. Coarse coefficients come first: after a few of
them most centroids already lie further off than one whole distance, and only the rest are
summed on. Vectors never move: a round sends centroids out and gets one row of sums per
cluster back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import find_package

DIMENSIONS = 64
#: Ends of the coefficient ranges, summed one after another.
LEVELS = (1, 2, 4, 8, 16, 32, 64)
#: After these many coefficients the closest centroid so far is summed to the end: its
#: distance bars the others.
TRIAL = 4
#: Vectors searched at a time; bounds a task's memory.
ROWS = 2048
#: Integers below this keep all sums of squares of a search inside 64 bits; others are
#: Python integers.
SMALL = 1 << 21
LIMB = 60
LONGEST = (1 << 63) - 1


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows with 64 components, all finite numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) == DIMENSIONS) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")
    )


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as Python integers where 64 bits could not hold the search."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64)
    exact = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        exact[at] = int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale))
    return exact


def _sequency() -> np.ndarray:
    """The order of the transform's rows by their number of sign changes: coarse to fine."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < DIMENSIONS:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


COARSE_FIRST = _sequency()


def transformed(rows: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of every row, coarse coefficients first."""
    width = 1
    while width < DIMENSIONS:
        pairs = rows.reshape(len(rows), -1, 2, width)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), DIMENSIONS)
        width *= 2
    return rows[:, COARSE_FIRST]


def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest center, squared distance) of each transformed row, the smaller number on
    ties, and the number of coefficient differences that were summed."""
    count, kinds = len(rows), len(centers)
    row, center = np.repeat(np.arange(count), kinds), np.tile(np.arange(kinds), count)
    so_far = np.zeros(count * kinds, rows.dtype)
    bar, summed, low = None, 0, 0
    for high in LEVELS:
        apart = rows[row, low:high] - centers[center, low:high]
        so_far = so_far + (apart * apart).sum(1)
        summed += apart.size
        if high == TRIAL:
            first = so_far.reshape(count, kinds).argmin(1)
            rest = rows[:, high:] - centers[first, high:]
            bar = so_far.reshape(count, kinds)[np.arange(count), first] + (rest * rest).sum(1)
            summed += rest.size
        if bar is not None:
            stay = np.flatnonzero(so_far <= bar[row])  # a tie may still win by its number
            row, center, so_far = row[stay], center[stay], so_far[stay]
        low = high
    # rows keep their order, centers rise within a row
    ends = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    best = np.minimum.reduceat(so_far, starts)
    hit = np.flatnonzero(so_far == best[row])
    hit = hit[np.searchsorted(row[hit], np.arange(count))]
    return center[hit], best // DIMENSIONS, summed


def _searched(batches: Iterator[pa.RecordBatch], centers: np.ndarray, scale: int):
    """(ids, whole numbers, cluster, distance) of some vectors at a time."""
    coded = transformed(centers)
    coded_wide = coded.astype(object)
    narrow = np.abs(centers).max(initial=0) < SMALL
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), DIMENSIONS)
        for low in range(0, len(batch), ROWS):
            x = flat[low : low + ROWS]
            big = np.abs(x).max(1) * scale >= SMALL - 1
            for which in (np.flatnonzero(~big), np.flatnonzero(big)):
                if not len(which):
                    continue
                values = whole_numbers(x[which], scale)
                exact = narrow and values.dtype != object
                cluster, distance, _ = nearest(
                    transformed(values if exact else values.astype(object)), coded.astype(np.int64) if exact else coded_wide
                )
                yield batch.column(0).take(pa.array(which + low)), values, cluster, distance


CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
SUMS = "cluster int, rows long, low array<decimal(38,0)>, high array<decimal(38,0)>, inertia decimal(38,0)"


def cluster_sums(vectors: DataFrame, centers: list[list[int]], scale: int) -> dict[int, tuple[int, list[int], int]]:
    """By cluster: its rows, the exact sum of their vectors, and the sum of their distances
    (exact while it fits 64 bits).

    Tasks add up their own rows; what reaches the driver is one row per cluster. Sums travel
    as two limbs, so they may pass 64 bits.
    """
    table = np.array(centers, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        inertia: dict[int, int] = {}
        for _, values, cluster, distance in _searched(batches, table, scale):
            for c in np.unique(cluster).tolist():
                mine = np.flatnonzero(cluster == c)
                rows[c] = rows.get(c, 0) + len(mine)
                total[c] = total.get(c, np.zeros(DIMENSIONS, object)) + values[mine].sum(0).astype(object)
                inertia[c] = inertia.get(c, 0) + sum(distance[mine].tolist())
        found = sorted(rows)
        mask = (1 << LIMB) - 1
        wide = pa.decimal128(38, 0)
        columns = [
            pa.array(found, pa.int32()),
            pa.array([rows[c] for c in found], pa.int64()),
            pa.array([[int(v) & mask for v in total[c]] for c in found], pa.list_(wide)),
            pa.array([[int(v) >> LIMB for v in total[c]] for c in found], pa.list_(wide)),
            pa.array([min(inertia[c], 2 * LONGEST) for c in found], wide),  # given as LONGEST from there on
        ]
        yield pa.record_batch(columns, names=["cluster", "rows", "low", "high", "inertia"])

    parts = vectors.mapInArrow(run, SUMS)
    limbs = [F.sum(F.col(name)[k]).alias(f"{name}{k}") for name in ("low", "high") for k in range(DIMENSIONS)]
    found = {}
    for r in parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.sum("inertia").alias("inertia"), *limbs).collect():
        total = [int(r[f"low{k}"]) + (int(r[f"high{k}"]) << LIMB) for k in range(DIMENSIONS)]
        found[r["cluster"]] = (r["rows"], total, int(r["inertia"]))
    return found


def first_centroids(vectors: DataFrame, count: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of ``seed:vec_id``, in hash order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "embedding").limit(count)
    rows = [r["embedding"] for r in chosen.select("embedding").collect()]
    return [[int(v) for v in whole_numbers(np.array([r]), scale)[0]] for r in rows]


def fitted_centroids(vectors: DataFrame, count: int, rounds: int, seed: int, scale: int) -> list[list[int]]:
    """Centroids after the rounds; empty clusters keep theirs."""
    centers = first_centroids(vectors, count, seed, scale)
    for _ in range(rounds if centers else 0):
        for cluster, (rows, total, _) in cluster_sums(vectors, centers, scale).items():
            centers[cluster] = [v // rows for v in total]
    return centers


def cluster_vectors(table: DataFrame, count: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    Vectors that are NULL, do not have 64 components or hold a NULL or non-finite one take
    no part. Components become floor(scale * x). Ties go to the smaller centroid; repeated
    rows are all kept and all count; rows equal in id are ordered by their vectors where
    they start centroids; a NULL id is kept, but starts a centroid only after all others.
    With fewer vectors than ``count`` each starts a centroid; an empty table has no rows.
    Assignments and sums are exact for all 32-bit floats (components up to 1e50; sums of
    larger ones fail); a distance or sum of distances beyond 64 bits is given as 2**63 - 1.
    Other columns are not read.
    """
    find_package(table.sparkSession)
    vectors = usable_vectors(table)
    centers = fitted_centroids(vectors, count, rounds, seed, scale)
    if not centers:
        return table.sparkSession.createDataFrame([], CLUSTERED)
    sums = cluster_sums(vectors, centers, scale)
    by_cluster = [min(sums[c][2], LONGEST) if c in sums else 0 for c in range(len(centers))]
    inertia = min(sum(s[2] for s in sums.values()), LONGEST)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    final = np.array(centers, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _searched(batches, final, scale):
            yield pa.record_batch(
                [
                    ids,
                    pa.array(cluster.astype(np.int32)),
                    pa.array([min(d, LONGEST) for d in distance.tolist()], pa.int64()),
                    pa.array([by_cluster[c] for c in cluster], pa.int64()),
                    pa.array(np.full(len(cluster), inertia)),
                    pa.array([names[c] for c in cluster]),
                ],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return vectors.mapInArrow(run, CLUSTERED)
