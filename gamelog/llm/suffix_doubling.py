"""Removing repeated byte strings by prefix doubling over sampled suffixes.

Names of prefixes double in length: 1, 2, 4, ... 32 bytes inside each task (a name is a hash
of two names), then Spark brings equal names together. Only suffixes that can still be
repeated go on: of every 100-byte string the suffix with the least 32-byte name stands for
it, so one whose name is unique ends the matter for all strings it stands for. The rest are
ranked by the span they stand for, and, where spans differ, by pairs of names that reach
past the threshold, one suffix per string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.byte_bpe import binary_rows
from gamelog.llm.marks import (
    Entries, by_document, changes, deal, exchange, first_places, forwarded, gathered, later_windows, marked, together,
)
from gamelog.llm.tables import text_buckets
from gamelog.llm.textbytes import BYTE_CODE, U64, mix, ranges, room, row_slices, sliding_min, utf8, windows

REPEATED, OPEN = 0, 1
LENGTH_BITS = 20  # a mark is start << LENGTH_BITS | number of strings
LOW = U64(2**32 - 1)


def _first_length(length: int) -> int:
    """The longest doubled prefix whose double still fits the threshold with room to sample."""
    size = 1
    while size * 3 <= length:
        size *= 2
    return size


def _rows(batch: pa.RecordBatch):
    doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    data, offsets = utf8(batch.column(2))
    for low, high in row_slices(offsets):
        yield low, high, doc[low:high], tag[low:high], offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]]


def _string_names(names: np.ndarray, size: int, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``length``-byte strings at ``at``, from the names of their prefixes
    of ``size`` bytes: pairs of names at growing offsets, the last one overlapping."""
    code, other, offset = names[at], mix(names[at] + U64(1)), 0
    while offset + size < length:
        offset = min(offset + size, length - size)
        step = names[at + offset]
        code, other = mix(code) + step, mix(other ^ step)
    return mix(code), other


def _span_entries(length: int):
    size = _first_length(length)

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        """Runs of strings that one suffix stands for: its name, and the name of the run."""
        for *_, doc, tag, offsets, data in _rows(batch):
            start, count = room(offsets, length)
            if not len(start):
                continue
            names = windows(BYTE_CODE[data], size)
            rank = (mix(names) & ~LOW) | np.arange(len(names), dtype=U64)  # the leftmost of equals
            least = sliding_min(rank, length - size + 1)[start] & LOW
            row = np.repeat(np.arange(len(count)), count)
            head = np.flatnonzero(changes(least, row))
            tail = np.append(head[1:], len(start)) - 1
            first, last = start[head], start[tail]
            run = (last - first + 1).astype(np.int64)
            begin = _string_names(names, size, first, length)
            stop = _string_names(names, size, last, length)
            span = mix(begin[0] + mix(stop[0] + run.astype(U64)))
            check = mix(begin[1] ^ mix(stop[1]))
            # named apart from the rank, which is low for all that were chosen
            anchor = names[least[head].astype(np.int64)]
            row = row[head]
            at = (first - offsets[row]) << LENGTH_BITS | run
            yield Entries(doc[row], tag[row], at, (mix(mix(anchor) + U64(1)), span ^ (check << U64(1))))

    return entries


def repeated_spans(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Marks of runs of strings: REPEATED ones also start earlier as a whole; OPEN ones are
    the first of their kind, but share their suffix with another kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in gathered(batches, _span_entries(length)):
            first, later = first_places(entries)
            yield from deal(together(first), buckets, (4, 8))
            yield from forwarded(together(later), buckets)

    def judge(entries: Entries) -> list[tuple[int, Entries]]:
        first, later = first_places(entries)
        first = first.take(np.argsort(first.keys[0], kind="stable"))
        head = np.flatnonzero(changes(first.keys[0]))
        kinds = np.diff(np.append(head, len(first)))
        return [(REPEATED, later), (OPEN, first.take(np.flatnonzero(np.repeat(kinds > 1, kinds))))]

    return exchange(docs, scan, judge, (4, 8), REPEATED, buckets)


def _expanded(marks: np.ndarray) -> np.ndarray:
    return ranges(marks >> LENGTH_BITS, marks & ((1 << LENGTH_BITS) - 1))


def _open_strings(length: int):
    size = _first_length(length)

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        lists = batch.column(3).to_pylist()
        for low, high, doc, tag, offsets, data in _rows(batch):
            places = [_expanded(marked(lists[k])) for k in range(low, high)]
            row = np.repeat(np.arange(high - low), [len(p) for p in places])
            place = np.concatenate(places)
            if len(place):
                names = windows(BYTE_CODE[data], size)
                yield Entries(doc[row], tag[row], place << LENGTH_BITS | 1, _string_names(names, size, offsets[row] + place, length))

    return entries


def dedup_bytes(docs: DataFrame, length: int = 100, whole_characters: bool = False) -> DataFrame:
    """(doc, tag, n_bytes, n_removed, n_spans, gone, kept): each row of ``docs``
    (``tables.keyed_texts``) without the bytes of strings that also start earlier.

    Texts are UTF-8 bytes, NULL is empty; a string is ``length`` bytes of one document;
    earlier is a smaller (doc, tag), or the same document and an earlier byte, overlaps
    included; strings are judged on the input. ``gone`` lists the maximal removed runs as
    (start, end), ``kept`` has the other bytes; with ``whole_characters`` a character goes
    only if all of its bytes do, so ``kept`` is UTF-8. Texts shorter than ``length`` lose nothing.
    Rows equal in id and text are one document and give equal results; rows that share an
    id only are ordered by their checksum; a NULL id comes first.
    """
    buckets = text_buckets(docs)
    spans = repeated_spans(docs, length, buckets)
    of_open = by_document(spans.filter(F.col("kind") == OPEN))
    near = docs.join(of_open, ["doc", "tag"]).select("doc", "tag", "text", "marks")
    strings = later_windows(near, _open_strings(length), buckets, REPEATED)
    repeated = by_document(spans.filter(F.col("kind") == REPEATED).unionByName(strings))
    judged = docs.join(repeated, ["doc", "tag"], "left").select("doc", "tag", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3).to_pylist()
            for low, high, doc, tag, offsets, data in _rows(batch):
                depth = np.zeros(len(data) + 1, np.int64)
                for k in range(low, high):
                    if lists[k]:
                        marks = marked(lists[k])
                        start = offsets[k - low] + (marks >> LENGTH_BITS)
                        np.add.at(depth, start, 1)
                        np.add.at(depth, start + (marks & ((1 << LENGTH_BITS) - 1)) - 1 + length, -1)
                stay = np.cumsum(depth)[:-1] == 0
                if whole_characters and len(data):
                    head = (data & 0xC0) != 0x80
                    stay = np.maximum.reduceat(stay, np.flatnonzero(head))[np.cumsum(head) - 1]
                kept = np.concatenate([[0], np.cumsum(stay)])[offsets]
                row = np.repeat(np.arange(high - low), np.diff(offsets))
                begin = np.flatnonzero(~stay & changes(row, stay))
                last = np.flatnonzero(~stay & np.append(changes(row, stay)[1:], True)[: len(stay)]) + 1
                spans = np.bincount(row[begin], minlength=high - low)
                own = offsets[row[begin]]
                gone = pa.StructArray.from_arrays([pa.array(begin - own), pa.array(last - own)], ["start", "end"])
                ends = np.concatenate([[0], np.cumsum(spans)])
                size = np.diff(offsets)
                yield pa.record_batch(
                    [
                        pa.array(doc), pa.array(tag), pa.array(size), pa.array(size - np.diff(kept)), pa.array(spans),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), gone), binary_rows(data[stay], kept),
                    ],
                    names=["doc", "tag", "n_bytes", "n_removed", "n_spans", "gone", "kept"],
                )

    schema = "doc long, tag long, n_bytes long, n_removed long, n_spans long, gone array<struct<start: long, end: long>>, kept binary"
    return judged.mapInArrow(cut, schema)
