"""Positions in documents, exchanged between tasks in packed form.

Billions of (hash, document, position) entries are too wide as rows. A task gathers the
entries of many documents, deals them by hash into buckets, and ships one binary row per
bucket; a bucket's rows meet in one group. Marks go back as one array per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.byte_bpe import binary_rows
from gamelog.llm.textbytes import U64, mix

#: Entries gathered before they are dealt out; bounds a task's memory.
GATHERED = 400_000
#: Entries of a bucket judged at a time, by key; bounds what sorting them takes.
JUDGED = 400_000
#: Bytes of the two hashes that name a whole window, beside the bits of the bucket number.
STRING_BYTES = (5, 4)
PACKED = "bucket int, meta binary, keys binary"
MARKS = "doc long, tag long, kind int, marks binary"


@dataclass
class Entries:
    """Arrays of equal length: one entry is a hash at a position of a document."""

    doc: np.ndarray  # int64
    tag: np.ndarray  # int64
    at: np.ndarray  # int64: what the position is is up to the operator
    keys: tuple[np.ndarray, ...]  # one or more hash columns

    def __len__(self) -> int:
        return len(self.at)

    def take(self, which: np.ndarray) -> Entries:
        return Entries(self.doc[which], self.tag[which], self.at[which], tuple(k[which] for k in self.keys))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(
            *(np.concatenate([getattr(p, n) for p in parts]) for n in ("doc", "tag", "at")),
            tuple(np.concatenate(k) for k in zip(*(p.keys for p in parts))),
        )

    def place(self) -> tuple[np.ndarray, ...]:
        """Sort keys of the order (document, position), the last the most important."""
        return self.at, self.tag, self.doc

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The order that puts a document's entries together, and where each begins."""
        order = np.lexsort(self.place())
        doc, tag = self.doc[order], self.tag[order]
        return order, np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else np.empty(0, bool))


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where any sorted column differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _planes(at: np.ndarray) -> bytes:
    """The steps from each number to the next, all lowest bytes first: small steps pack well."""
    steps = np.diff(at, prepend=0).astype("<i8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, size: int, at: int) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<i8").ravel(), dtype=np.int64)


def _meta(entries: Entries) -> bytes:
    """Documents once, with the number of their entries, then the steps between positions."""
    new = changes(entries.doc, entries.tag)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(entries)))
    raw = b"".join(
        [
            np.array([len(first), len(entries)], "<i8").tobytes(),
            _planes(entries.doc[first]),
            entries.tag[first].astype("<i8").tobytes(),
            count.astype("<u4").tobytes(),
            _planes(entries.at),
        ]
    )
    return zstandard.compress(raw, 1)


def unpack(meta: bytes, keys: bytes | None, widths: tuple[int, ...]) -> Entries:
    raw = zstandard.decompress(meta)
    documents, size = np.frombuffer(raw, "<i8", 2)
    at = 16
    doc = _numbers(raw, documents, at)
    tag = np.frombuffer(raw, "<i8", documents, at := at + 8 * documents)
    count = np.frombuffer(raw, "<u4", documents, at := at + 8 * documents)
    place = _numbers(raw, size, at + 4 * documents)
    columns, start = [], 0
    for width in widths if keys is not None else ():
        part = np.zeros((size, 8), np.uint8)
        part[:, :width] = np.frombuffer(keys, np.uint8, size * width, start).reshape(size, width)
        columns.append(part.view("<u8").ravel())
        start += size * width
    return Entries(np.repeat(doc, count), np.repeat(tag, count), place, tuple(columns))


def deal(entries: Entries, buckets: int, widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """One packed row per bucket of the first key; of each key the lowest bytes travel.

    The bucket comes from the highest bits, so bucket and lowest bytes together tell keys
    apart. Entries must lie together by document.
    """
    bucket = ((entries.keys[0] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))
    rows = []
    for b in np.flatnonzero(np.diff(ends)):
        part = entries.take(order[ends[b] : ends[b + 1]])
        keys = b"".join(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].tobytes() for k, w in zip(part.keys, widths))
        rows.append((int(b), _meta(part), keys))
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "meta", "keys"])


def forwarded(entries: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Marks that are certain already: they pass through a bucket without keys."""
    if len(entries):
        bucket = int(entries.doc[0]) % buckets
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([_meta(entries)], pa.binary()), pa.array([None], pa.binary())], names=["bucket", "meta", "keys"])


def mark_rows(entries: Entries, kind: int) -> list[pa.Array]:
    """(doc, tag, kind, marks): the positions of each document as one array of 64-bit numbers."""
    order, first = entries.documents()
    ends = np.append(first, len(entries))
    return [
        pa.array(entries.doc[order][first]),
        pa.array(entries.tag[order][first]),
        pa.array(np.full(len(first), kind, np.int32)),
        binary_rows(entries.at[order].astype("<i8").view(np.uint8), ends * 8),
    ]


PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("meta", pa.binary()), ("keys", pa.binary())])
_MARKS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("kind", pa.int32()), ("marks", pa.binary())])


def exchange(
    source: DataFrame,
    scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    judge: Callable[[Entries], list[tuple[int, Entries]]],
    widths: tuple[int, ...],
    forward_kind: int,
    buckets: int,
) -> DataFrame:
    """Marks that ``judge`` finds among all entries of a bucket, and the forwarded ones.

    Returns (doc, tag, kind, marks), a row per document and kind (0 or 1). The marks
    themselves travel packed, dealt by document.
    """

    def meet(table: pa.Table) -> pa.Table:
        found, parts = [], []
        for meta, keys in zip(table["meta"], table["keys"]):
            if keys.is_valid:
                parts.append(unpack(meta.as_py(), keys.as_py(), widths))
            else:
                found.append((forward_kind, unpack(meta.as_py(), None, ())))
        if parts:
            entries = Entries.joined(parts)
            parts.clear()
            pieces = len(entries) // JUDGED + 1
            piece = (entries.keys[0] & U64(0xFFFF)) * U64(pieces) >> U64(16)
            for k in range(pieces):
                found += judge(entries.take(np.flatnonzero(piece == k)))
        if not sum(len(e) for _, e in found):
            return PACKED_ARROW.empty_table()
        e = together(Entries.joined([Entries(e.doc, e.tag, 2 * e.at + kind, ()) for kind, e in found]))
        e.keys = (mix(e.doc.view(U64) + mix(e.tag.view(U64))),)
        return pa.Table.from_batches(deal(e, buckets, ()))

    def gather(table: pa.Table) -> pa.Table:
        e = Entries.joined([unpack(meta.as_py(), None, ()) for meta in table["meta"]])
        rows = []
        for kind in (0, 1):
            part = e.take(np.flatnonzero((e.at & 1) == kind))
            part.at = part.at >> 1
            rows.append(mark_rows(part, kind))
        return pa.Table.from_arrays([pa.chunked_array(c) for c in zip(*rows)], schema=_MARKS)

    packed = source.mapInArrow(scan, PACKED).groupBy("bucket").applyInArrow(meet, PACKED)
    return packed.groupBy("bucket").applyInArrow(gather, MARKS)


def by_document(marks: DataFrame) -> DataFrame:
    """(doc, tag, marks): all arrays of a document; as many numbers as it has marked places."""
    return marks.groupBy("doc", "tag").agg(F.collect_list("marks").alias("marks"))


def marked(arrays) -> np.ndarray:
    """The positions in a document's list of arrays, sorted."""
    return np.sort(np.frombuffer(b"".join(arrays or ()), "<i8"))


def first_places(entries: Entries) -> tuple[Entries, Entries]:
    """The first entry of every key in document order, and all that start later.

    An entry that repeats the first one's place (a repeated row) is neither.
    """
    order = np.lexsort((*entries.place(), *entries.keys))
    e = entries.take(order)
    new = changes(*e.keys)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    later = (e.doc != e.doc[head]) | (e.tag != e.tag[head]) | (e.at != e.at[head])
    return e.take(np.flatnonzero(new)), e.take(np.flatnonzero(later))


def together(entries: Entries) -> Entries:
    """The entries in document order, as ``deal`` wants them."""
    return entries.take(np.lexsort(entries.place()))


def later_windows(
    docs_with_marks: DataFrame, window_entries: Callable[[pa.RecordBatch], Iterator[Entries]], buckets: int, kind: int
) -> DataFrame:
    """Marks of all windows whose content also starts earlier, by their full hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in gathered(batches, window_entries):
            first, later = first_places(entries)
            yield from deal(together(first), buckets, STRING_BYTES)
            yield from forwarded(together(later), buckets)

    def judge(entries: Entries) -> list[tuple[int, Entries]]:
        return [(kind, first_places(entries)[1])]

    return exchange(docs_with_marks, scan, judge, STRING_BYTES, kind, buckets)


def gathered(batches: Iterator[pa.RecordBatch], entries_of: Callable[[pa.RecordBatch], Iterator[Entries]]) -> Iterator[Entries]:
    """Entries of many batches at a time."""
    parts, size = [], 0
    for batch in batches:
        for entries in entries_of(batch):
            parts.append(entries)
            size += len(entries)
            if size >= GATHERED:
                yield Entries.joined(parts)
                parts, size = [], 0
    if size:
        yield Entries.joined(parts)
