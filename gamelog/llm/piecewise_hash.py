"""Context-triggered piecewise hashing of documents, and the likeness of two fingerprints.

A rolling hash over seven bytes cuts a text into pieces wherever it meets the block size's
residue; each piece gives one character. A fingerprint holds the signatures at a block size
and at its double, so texts whose block sizes are equal or differ by that factor compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import shuffle_partitions
from gamelog.llm.textbytes import BYTE_CODE, U64, mix, room, row_slices, span_codes, utf8, windows

REACH = 7  # bytes that the rolling hash sees
MOST = 64  # characters of a signature
LEVELS = 48
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Two signatures must share a run of this many characters (or the shorter one whole).
SHARED_RUN = 4


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """``block size:signature:signature at the double`` of every row of bytes.

    The block size is 3 * 2**k for the least k whose cuts leave at most 64 pieces; the
    pieces cover the whole text. An empty text is ``3::``.
    """
    out: list[str] = []
    for low, high in row_slices(offsets):
        out += _slice_fingerprints(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
    return out


def _slice_fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    rows = len(offsets) - 1
    start, count = room(offsets, REACH)
    residue = mix(windows(BYTE_CODE[data], REACH)[start] if len(start) else np.empty(0, U64))
    third, left = np.divmod(residue, U64(3))
    hit = np.flatnonzero(left == 2)
    cut = start[hit] + REACH  # the piece ends after the window
    row = np.repeat(np.arange(rows), count)[hit]
    third = third[hit]
    ones = ~third & (third + U64(1))  # the lowest bit of ``third`` that is 0
    level = np.minimum(np.log2(ones.astype(np.float64)).astype(np.int64), LEVELS - 1)
    at_level = np.bincount(row * LEVELS + level, minlength=rows * LEVELS).reshape(rows, LEVELS)
    at_least = at_level[:, ::-1].cumsum(1)[:, ::-1]
    k = (at_least >= MOST).sum(1)  # counts fall with the level
    first = [_signatures(data, offsets, cut[keep := level >= k[row] + more], row[keep]) for more in (0, 1)]
    return [f"{3 << int(x)}:{a}:{b}" for x, a, b in zip(k, *first)]


def _signatures(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray, row: np.ndarray) -> list[str]:
    """One character per piece, by row; the rest after the last cut is a piece too."""
    size = np.diff(offsets)
    last = np.zeros(len(size), np.int64)
    last[row] = cut  # cuts ascend, so the last one stays
    open_end = np.flatnonzero((size > 0) & (last < offsets[1:]))
    end = np.concatenate([cut, offsets[1:][open_end]])
    row = np.concatenate([row, open_end])
    order = np.argsort(end, kind="stable")
    end, row = end[order], row[order]
    begin = np.concatenate([[0], end[:-1]])
    begin = np.maximum(begin, offsets[row])
    letters = ALPHABET[(span_codes(data, begin, end) >> U64(58)).astype(np.int64)].tobytes().decode()
    ends = np.searchsorted(row, np.arange(len(size) + 1)).tolist()
    return [letters[a:b] for a, b in zip(ends, ends[1:])]


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; equal fingerprints have 1.

    Signatures of one block size are compared by edit distance over the longer length;
    0 where no block sizes agree or no run of characters is shared.
    """
    best = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for n, (a, b) in enumerate(zip(left, right)):
        if a == b:
            best[n] = 1.0
            continue
        size_a, one_a, two_a = a.split(":")
        size_b, one_b, two_b = b.split(":")
        size_a, size_b = int(size_a), int(size_b)
        if size_a == size_b:
            pairs += [(n, one_a, one_b), (n, two_a, two_b)]
        elif size_a == 2 * size_b:
            pairs.append((n, one_a, two_b))
        elif size_b == 2 * size_a:
            pairs.append((n, two_a, one_b))
    pairs = [p for p in pairs if p[1] and p[2]]
    for low in range(0, len(pairs), 4096):
        part = pairs[low : low + 4096]
        value = _similarity([p[1] for p in part], [p[2] for p in part])
        np.maximum.at(best, [p[0] for p in part], value)
    return best


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(int(size.max()), SHARED_RUN)), fill, np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode(), np.uint8)
    return out, size


def _similarity(left: list[str], right: list[str]) -> np.ndarray:
    a, size_a = _padded(left, 0)
    b, size_b = _padded(right, 1)
    run = np.minimum(np.minimum(size_a, size_b), SHARED_RUN)
    alike = np.zeros(len(a), bool)
    for length in np.unique(run):
        at = np.flatnonzero(run == length)
        x, y = (_runs(m[at], length) for m in (a, b))
        seen = np.zeros(len(at), bool)
        for k in range(x.shape[1]):  # padding differs on the two sides, so it never matches
            seen |= (y == x[:, k : k + 1]).any(1)
        alike[at] = seen
    out = np.zeros(len(a))
    if alike.any():
        at = np.flatnonzero(alike)
        far = _edit_distance(a[at], size_a[at], b[at], size_b[at])
        out[at] = 1 - far / np.maximum(size_a[at], size_b[at])
    return out


def _runs(m: np.ndarray, length: int) -> np.ndarray:
    columns = m.shape[1] - length + 1
    return reduce(lambda x, k: (x << 8) | m[:, k : k + columns], range(length), np.zeros((len(m), columns), np.uint32))


def _edit_distance(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each row of ``a`` to that of ``b``, all rows at once."""
    column = np.arange(b.shape[1] + 1, dtype=np.int16)
    row = np.tile(column, (len(a), 1))
    out = np.where(size_a == 0, size_b, 0)
    for i in range(a.shape[1]):
        step = row + np.int16(1)
        np.minimum(step[:, 1:], row[:, :-1] + (b != a[:, i : i + 1]), out=step[:, 1:])
        row = (np.minimum.accumulate(step - column, axis=1) + column).astype(np.int16)
        done = np.flatnonzero(size_a == i + 1)
        out[done] = row[done, size_b[done]]
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """(bucket, after, doc_id, text): buckets of descending id, each with its successor.

    Bucket borders are quantiles of the ids. The rows of the first id of the next bucket
    that has rows (after the last: of the first) come once more, marked ``after``; there
    is one such id per bucket, so their list is as long as there are buckets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = 4 * shuffle_partitions(spark)
    share = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", share, 0.2 / buckets)))
    # a NULL id comes last, after the smallest
    place = F.lit(0.0)
    if cuts:
        borders = [-float("inf"), *cuts, float("inf")]
        bins = Bucketizer(splits=borders, inputCol="_id", outputCol="_bin", handleInvalid="keep")
        docs, place = bins.transform(docs.withColumn("_id", F.col("doc_id").cast("double"))), len(cuts) - F.col("_bin")
    bucket = F.when(F.col("doc_id").isNotNull(), place).otherwise(len(cuts) + 1)
    docs = docs.select(bucket.cast("int").alias("bucket"), "doc_id", "text")
    heads = docs.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    before = [heads[-1].bucket, *[h.bucket for h in heads]] if heads else []
    head_rows = [(b, h.bucket, h.doc_id) for b, h in zip(before, heads)]
    schema = "target int, bucket int, doc_id long"
    chosen = F.broadcast(spark.createDataFrame(head_rows, schema).withColumnRenamed("bucket", "own"))
    after = docs.join(
        chosen.withColumnRenamed("doc_id", "head_id"),
        (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head_id")),
    ).select(F.col("target").alias("bucket"), F.lit(True).alias("after"), "doc_id", "text")
    own = docs.select("bucket", F.lit(False).alias("after"), "doc_id", "text")
    return (
        own.unionByName(after)
        .repartition(shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "after", F.col("doc_id").desc_nulls_last(), "text")
    )


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it: its edited text, fingerprints and likenesses."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        _, offsets = utf8(batch.column(3))
        for low, high in row_slices(offsets, 4 << 20):
            part = batch.slice(low, high - low)
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            held = part.slice(len(part) - 1)
            if len(part) > 1:
                yield _edited(part)


def _edited(part: pa.RecordBatch) -> pa.RecordBatch:
    """All rows but the last, which has no successor here; ``after`` rows only lend theirs."""
    own = np.flatnonzero(~part.column(1).to_numpy(zero_copy_only=False)[:-1])
    texts = part.column(3).to_pylist()
    prints = fingerprints(*utf8(part.column(3)))
    sizes = [len(texts[i]) for i in own]
    edited = [texts[i][: n - n // 2] + texts[i + 1][: n // 2] for i, n in zip(own, sizes)]
    edited_array = pa.array(edited, pa.string())
    edited_prints = fingerprints(*utf8(edited_array))
    mine = [prints[i] for i in own]
    return pa.record_batch(
        [
            part.column(2).take(pa.array(own)),
            pa.array(sizes, pa.int64()),
            edited_array,
            pa.array(mine, pa.string()),
            pa.array(edited_prints, pa.string()),
            pa.array(likeness(mine, edited_prints)),
            pa.array(likeness(mine, [prints[i + 1] for i in own])),
        ],
        names=[f.name for f in _EDITED],
    )


_EDITED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_text", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, repeated rows repeated; no shuffle.

    The whole text counts; a NULL text is empty (fingerprint ``3::``); a NULL doc_id stays
    NULL; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            sizes = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())
            prints = pa.array(fingerprints(*utf8(batch.column(1))), pa.string())
            yield pa.record_batch([batch.column(0), sizes, prints], names=["doc_id", "n_chars", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and two likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next row in descending doc_id; the last row is followed by the
    first, a single row by itself. Rows of one doc_id follow each other by text; NULL ids
    come last; a NULL text is empty. Other columns are not read; an empty table gives no
    rows. The texts move once, into buckets of neighbouring ids.
    """
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ordered(docs).mapInArrow(_edit_rows, schema)
