"""A toxicity score from character n-grams scaled by naive Bayes log-count ratios.

Spark counts, over all labelled rows, how many texts of each label hold each hashed
n-gram; the log of the ratio of the two shares scales the n-gram's feature. A logistic
regression on the scaled features is fitted on a bounded sample of labelled rows, and its
weights, one number per hash bucket, score every text where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.textbytes import U64, mix, row_slices, utf8, windows

ORDERS = (3, 4, 5)
BUCKET_BITS = 19
#: Labelled rows that the regression is fitted on, at most; the ratios use all of them.
FIT_ROWS = 2500
SMOOTHING = 1.0
#: Ratios nearer to 0 than this many standard errors are taken as 0.
LEAST_Z = 2.0
PENALTY = 1e-3
STEPS = 150
SHARES = 16  # parts of the count vectors, summed apart


class NGrams:
    """Distinct hashed n-grams of texts; the scratch space is kept between texts."""

    def __init__(self, bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS):
        self.bits, self.orders = bits, orders
        self.last = np.zeros(1 << bits, np.int32)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The bucket numbers of each text, in no order; the whole text counts, in lower case."""
        framed = [f"\n{text.lower()}\n" if text else "" for text in texts]
        sizes = [len(t) for t in framed]
        codes = mix(np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(U64) + U64(1))
        grams = [(mix(windows(codes, n) + U64(n)) >> U64(64 - self.bits)).astype(np.int32) for n in self.orders]
        start = 0
        for size in sizes:
            rows = [g[start : start + max(0, size - n + 1)] for g, n in zip(grams, self.orders)]
            found = np.concatenate(rows)
            place = np.arange(len(found), dtype=np.int32)
            self.last[found] = place
            yield found[self.last[found] == place]
            start += size


@dataclass
class Model:
    """A score is the logistic function of bias plus the weights of a text's n-grams."""

    weights: np.ndarray
    bias: float

    def scores(self, grams: NGrams, texts: list[str | None]) -> np.ndarray:
        sums = [float(self.weights[found].sum(dtype=np.float64)) for found in grams.of(texts)]
        return 1 / (1 + np.exp(-np.clip(np.array(sums) + self.bias, -500, 500)))


def count_grams(labelled: DataFrame, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each n-gram and all texts, by label, over all rows of (text, label)."""
    share_size = (1 << bits) // SHARES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, texts = NGrams(bits, orders), np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                for found, label in zip(grams.of(part.column(0).to_pylist()), part.column(1).to_pylist()):
                    seen[label][found] += 1
                    texts[label] += 1
        packed = [_pack(seen[:, k * share_size : (k + 1) * share_size]) for k in range(SHARES)]
        yield pa.record_batch(
            [pa.array(range(SHARES), pa.int32()), pa.array(packed, pa.binary()), *(pa.array([int(n) if k == 0 else 0 for k in range(SHARES)], pa.int64()) for n in texts)],
            names=["share", "counts", "n0", "n1"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpack(x, share_size) for x in table["counts"].to_pylist())
        n0, n1 = (sum(table[c].to_pylist()) for c in ("n0", "n1"))
        return pa.table({"share": [table["share"][0].as_py()], "counts": [_pack(total)], "n0": [n0], "n1": [n1]}, schema=_COUNTS)

    parts = labelled.mapInArrow(count, "share int, counts binary, n0 long, n1 long")
    summed = parts.groupBy("share").applyInArrow(add, "share int, counts binary, n0 long, n1 long").collect()
    seen = np.zeros((2, 1 << bits), np.int64)
    for row in summed:  # SHARES rows, together as long as the hash table
        seen[:, row.share * share_size : (row.share + 1) * share_size] = _unpack(row.counts, share_size)
    return seen, np.array([sum(r.n0 for r in summed), sum(r.n1 for r in summed)])


_COUNTS = pa.schema([("share", pa.int32()), ("counts", pa.binary()), ("n0", pa.int64()), ("n1", pa.int64())])


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts, "<i8").tobytes(), 1)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), "<i8").reshape(2, size)


def log_count_ratios(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """log of each n-gram's smoothed share in label-1 texts over that in label-0 texts."""
    zero, one = seen + SMOOTHING
    ratio = np.log(one / (texts[1] + 2 * SMOOTHING)) - np.log(zero / (texts[0] + 2 * SMOOTHING))
    error = np.sqrt(1 / one + 1 / zero)
    return np.where(np.abs(ratio) / error >= LEAST_Z, ratio, 0.0)


def fit_regression(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times their ratios, by accelerated gradient."""
    used, column = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    scale = ratios[used][column]
    norm = np.bincount(row, scale**2, minlength=len(rows)).max(initial=0) + 1
    step = 4 / norm / 1.0
    w, b = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    back_w, back_b = w, b
    n = len(labels)
    rate = step
    for t in range(STEPS):
        momentum = t / (t + 3)
        look_w, look_b = w + momentum * (w - back_w), b + momentum * (b - back_b)
        margin = np.bincount(row, scale * look_w[column], minlength=n) + look_b
        miss = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels
        grad = np.bincount(column, scale * miss[row], minlength=len(used)) / n + PENALTY * look_w
        back_w, back_b = w, b
        w, b = look_w - rate * grad, look_b - rate * miss.mean()
    weights = np.zeros(len(ratios), np.float32)
    weights[used] = w * ratios[used]
    return weights, b


def fit(labelled: DataFrame, sample: DataFrame, bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """The model of (text, label) rows; ``sample`` holds at most FIT_ROWS of them.

    Without rows of both labels no n-gram counts, and every score is the share of label 1
    among n + 2 rows.
    """
    seen, texts = count_grams(labelled, bits, orders)
    if not texts.all():
        share = max(float(texts[1]) / (texts.sum() + 2), 1e-9)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    ratios = log_count_ratios(seen, texts)
    shared = labelled.sparkSession.sparkContext.broadcast(ratios != 0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(bits, orders)
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                found = [np.sort(x[shared.value[x]]).astype("<i4").tobytes() for x in grams.of(part.column(0).to_pylist())]
                yield pa.record_batch([pa.array(found, pa.binary()), part.column(1)], names=["found", "label"])

    rows = sample.mapInArrow(pick, "found binary, label int").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.found)))  # the fit must not depend on row order
    found = [np.frombuffer(r.found, "<i4") for r in rows]
    return Model(*fit_regression(found, np.array([r.label for r in rows], float), ratios))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of all documents that have a toxicity label and are not held out.

    A doc_id with several labels has the greatest; NULL ids and labels are left out; the
    regression sees the ``fit_rows`` rows that come first by a hash of their id.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    texts = texts.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    first = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # labels grow with the documents, so they are never broadcast
    return fit(texts.join(known.hint("merge"), "doc_id").select("text", "label"), texts.join(first, "doc_id").select("text", "label"))


def score_documents(docs: DataFrame, model: Model, bits: int = BUCKET_BITS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """The rows of ``docs`` with a ``toxicity`` between 0 and 1, higher for label 1 likelier.

    Only the text counts; a NULL or empty one scores by the model's bias. Repeated rows
    repeat; the other columns pass through unread. An existing ``toxicity`` column is
    replaced. The model is as large as its hash table, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(bits, orders)
        for batch in batches:
            place = batch.schema.get_field_index("text")
            _, offsets = utf8(batch.column(place))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                score = shared.value.scores(grams, part.column(place).to_pylist())
                yield pa.record_batch([*part.columns, pa.array(score)], names=[*part.schema.names, "toxicity"])

    docs = docs.drop("toxicity")
    schema = docs.schema
    return docs.mapInArrow(run, type(schema)([*schema.fields]).add("toxicity", "double"))
