"""Byte-level BPE encoding and decoding with a given vocabulary.

Each distinct piece of a batch is encoded once. Pieces lie in padded matrices by length;
in every round each row merges its leftmost pair of least rank, and rows without a
mergeable pair leave the matrix. No shuffle: rows are encoded where they are read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import find_package
from gamelog.llm.textbytes import U64, mix, ranges, row_slices, utf8

NO_PAIR = np.int32(2**31 - 1)
#: Pieces longer than this merge by a heap: a matrix round costs the row's length.
MATRIX_WIDTH = 512
#: Pieces remembered between batches by one worker; beyond it the memory starts anew.
REMEMBERED = 400_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [base64.b64decode(token) for token, _ in pairs]
    if [int(rank) for _, rank in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks of {path} are not consecutive")
    return tokens


class PairTable:
    """Open addressing from (left id, right id) to the merged id."""

    EMPTY = U64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(merged) * 2.5).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY, U64)
        self.values = np.full(1 << bits, NO_PAIR, np.int32)
        todo = (left.astype(U64) << U64(32)) | right.astype(U64)
        slot = mix(todo) & self.mask
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = todo[free]  # of several for one slot the last one stays
            done = self.keys[slot] == todo
            self.values[slot[done]] = merged[done]
            todo, merged, slot = todo[~done], merged[~done], (slot[~done] + U64(1)) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NO_PAIR where the pair does not merge (or an id is -1)."""
        out = np.full(len(left), NO_PAIR, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[at].astype(U64) << U64(32)) | right[at].astype(U64)
        slot = mix(key) & self.mask
        while len(at):
            found = self.keys[slot]
            hit = found == key
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != self.EMPTY)
            at, key, slot = at[on], key[on], (slot[on] + U64(1)) & self.mask
        return out


class Encoder:
    """A vocabulary with its pair table, and the pieces met so far."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_end = np.cumsum([0, *map(len, tokens)])
        rank, splits = self.rank, []
        for merged, token in enumerate(tokens):
            for k in range(1, len(token)):
                a, b = rank.get(token[:k]), rank.get(token[k:])
                if a is not None and b is not None:
                    splits.append((a, b, merged))
        self.pairs = PairTable(*np.array(splits, np.int32).reshape(-1, 3).T)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        done: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for at, piece in enumerate(pieces):
            raw = piece.encode()
            if (whole := self.rank.get(raw)) is not None:
                done[at] = np.array([whole], np.int32)
            elif len(raw) > MATRIX_WIDTH:
                done[at] = self.merge_long(raw)
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((at, raw))
        for bits, group in by_width.items():
            step = max(1, (1 << 20) >> bits)
            for low in range(0, len(group), step):
                part = group[low : low + step]
                for (at, _), ids in zip(part, self.merge_matrix([raw for _, raw in part])):
                    done[at] = ids
        start = len(self.known)
        self.known.update(zip(pieces, range(start, start + len(pieces))))
        self.ids = np.concatenate([self.ids, *done])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in done])])

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Merge all rows of one padded matrix, a pair per row and round."""
        size = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), size.max() + 1), -1, np.int32)
        filled = np.arange(ids.shape[1]) < size[:, None]
        ids[filled] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rows, out = np.arange(len(ids)), [None] * len(ids)
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of the least
            here = np.arange(len(rows))
            best = ranks[here, at]
            if (stuck := best == NO_PAIR).any():
                for k in np.flatnonzero(stuck):
                    out[rows[k]] = ids[k][ids[k] >= 0].copy()
                go = ~stuck
                width = max(2, int((ids[go] >= 0).sum(1).max(initial=0)) + 1)
                rows, at, best = rows[go], at[go], best[go]
                ids, ranks = ids[go, :width], ranks[go, : width - 1]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            ids[here, at] = best
            column = np.arange(ids.shape[1])
            moved = column > at[:, None]
            ids[:, :-1] = np.where(moved[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(moved[:, : ranks.shape[1] - 1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_PAIR
            ranks[here, at] = self.pairs.get(ids[here, at], ids[here, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def merge_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(raw, np.uint8)]
        merged = self.pairs.get(ids[:-1], ids[1:])
        heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(merged) if r != NO_PAIR]
        heapq.heapify(heap)
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        one = lambda a, b: int(self.pairs.get(np.array([a]), np.array([b]))[0])
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue  # a neighbour has merged since
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (r := one(ids[x], ids[y])) != NO_PAIR:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the offsets of the texts."""
        pieces = [self.find(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = set().union(*pieces).difference(self.known)
        if new:
            self.learn(sorted(new))
        known = self.known
        number = np.array([known[p] for row in pieces for p in row], np.int64)
        size = np.diff(self.ends)[number]
        ends = np.cumsum([0, *map(len, pieces)])
        return self.ids[ranges(self.ends[number], size)], np.concatenate([[0], np.cumsum(size)])[ends]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (plus the total)."""
        start = self.token_end[ids]
        size = self.token_end[ids + 1] - start
        return self.token_data[ranges(start, size)], np.concatenate([[0], np.cumsum(size)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_for(tokens: list[bytes], pattern: str) -> Encoder:
    """This worker's encoder for the vocabulary, built at its first use."""
    key = (pattern, len(tokens), zlib.crc32(b"\0".join(tokens)))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokens, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``, repeated rows repeated.

    ``ids`` are those of the whole text, each match of ``pattern`` merged on its own and
    no special token known; ``decoded`` are the bytes that these ids stand for. A NULL or
    empty text has no ids and no bytes; a NULL doc_id stays NULL; other columns are not
    read. ``tokens`` (see ``load_ranks``) is read once on the driver and broadcast: it is
    as large as the vocabulary, whatever the number of documents.
    """
    spark = docs.sparkSession
    find_package(spark)
    shared = spark.sparkContext.broadcast((tokens, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(*shared.value)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for low, high in row_slices(offsets, 4 << 20):
                part = batch.slice(low, high - low)
                ids, ends = encoder.encode(part.column(1).to_pylist())
                raw, starts = encoder.decode(ids)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                        binary_rows(raw, starts[ends]),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
        .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
    )


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte rows from one buffer and its row offsets."""
    offsets = np.ascontiguousarray(offsets, np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)
