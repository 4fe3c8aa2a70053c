"""Removing repeated word windows, with non-overlapping reference blocks as anchors.

Every document is cut into blocks of half a window. A window of 20 words always holds a
whole block of 10, so each repeat of it shows where some rolling 10-word window equals an
indexed block. Around these hits the full windows are compared, and the windows that also
start earlier cover the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.marks import (
    Entries, by_document, changes, deal, exchange, forwarded, gathered, later_windows, marked, together,
)
from gamelog.llm.tables import text_buckets
from gamelog.llm.textbytes import NOT_SPACE, mix, ranges, room, row_slices, span_codes, utf8, windows, word_spans

HITS, LATER = 0, 1


def _rows(batch: pa.RecordBatch):
    """Of every slice: documents, checksums, first word of each row and the word hashes."""
    doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    data, offsets = utf8(batch.column(2))
    for low, high in row_slices(offsets):
        text = data[offsets[low] : offsets[high]]
        start, end, first = word_spans(text, offsets[low : high + 1] - offsets[low], NOT_SPACE)
        yield low, high, doc[low:high], tag[low:high], first, span_codes(text, start, end)


def _block_entries(block: int):
    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        """Every rolling window of one block's length; ``at`` is twice its word, plus 1 for a block."""
        for *_, doc, tag, first, codes in _rows(batch):
            at, count = room(first, block)
            if len(at):
                word = at - np.repeat(first[:-1], count)
                key = mix(windows(codes, block)[at])
                yield Entries(np.repeat(doc, count), np.repeat(tag, count), 2 * word + (word % block == 0), (key,))

    return entries


def _matches(entries: Entries) -> tuple[Entries, Entries]:
    """One entry of each hash, an indexed block if there is one, and all entries of hashes
    met twice of which one is a block."""
    order = np.lexsort((-(entries.at & 1), entries.keys[0]))
    e = entries.take(order)
    new = changes(e.keys[0])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(e)))
    hit = (size > 1) & ((e.at[head] & 1) == 1)
    return e.take(head), e.take(np.flatnonzero(np.repeat(hit, size)))


def block_hits(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Marks of the word positions where a rolling window equals an indexed block elsewhere."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in gathered(batches, _block_entries(block)):
            order = np.argsort(entries.keys[0], kind="stable")
            e = entries.take(order)
            head = np.flatnonzero(changes(e.keys[0]))
            size = np.diff(np.append(head, len(e)))
            # met twice in this task: taken as hits at once (the full windows decide later)
            yield from forwarded(together(e.take(np.flatnonzero(np.repeat(size > 1, size)))), buckets)
            block_of = np.maximum.reduceat(e.at & 1, head) if len(head) else np.empty(0, np.int64)
            one = e.take(head)
            one.at = (one.at & ~np.int64(1)) | block_of
            yield from deal(together(one), buckets, (4,))

    return exchange(docs, scan, lambda e: [(HITS, _matches(e)[1])], (4,), HITS, buckets)


def _window_entries(window: int, block: int):
    reach = window - block + 1  # windows that hold a block at a given word

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        lists = batch.column(3).to_pylist()
        for low, high, doc, tag, first, codes in _rows(batch):
            at, count = room(first, window)
            if not len(at):
                continue
            near = np.zeros(len(codes) + reach + 1, np.int32)
            for k in range(low, high):
                near[first[k - low] + (marked(lists[k]) >> 1)] = 1
            total = np.concatenate([[0], np.cumsum(near)])
            keep = np.flatnonzero(total[at + reach] > total[at])
            row = np.repeat(np.arange(len(count)), count)[keep]
            at = at[keep]
            whole = windows(codes, window)[at]
            yield Entries(doc[row], tag[row], at - first[row], (mix(whole), whole * (windows(codes, block)[at] | 1)))

    return entries


def dedup_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc, tag, n_words, n_removed, kept): each row of ``docs`` (``tables.keyed_texts``)
    without the words of windows that also start earlier.

    Words are runs of bytes other than the six ASCII white spaces, unchanged. A window is
    ``window`` consecutive words of one document; earlier is a smaller (doc, tag), or the
    same document and an earlier word; windows are judged on the input. ``kept`` has the
    other words, joined by one space. Texts that are NULL, empty or shorter than a window
    lose nothing. Rows equal in id and text are one document and give equal results; rows
    that share an id only are ordered by their checksum; a NULL id comes first.
    """
    if window < 2 or window % 2:
        raise ValueError("a window has an even number of words")
    block, buckets = window // 2, text_buckets(docs)
    hits = by_document(block_hits(docs, block, buckets))
    near = docs.join(hits, ["doc", "tag"]).select("doc", "tag", "text", "marks")
    later = by_document(later_windows(near, _window_entries(window, block), buckets, LATER))
    judged = docs.join(later, ["doc", "tag"], "left").select("doc", "tag", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                words, kept = [], []
                for text, arrays in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist()):
                    found = text.split()
                    words.append(len(found))
                    if arrays:
                        gone = np.zeros(len(found), bool)
                        gone[ranges(starts := marked(arrays), np.full(len(starts), window))] = True
                        found = list(compress(found, (~gone).tolist()))
                    kept.append((len(found), b" ".join(found)))
                removed = [n - k for n, (k, _) in zip(words, kept)]
                yield pa.record_batch(
                    [*part.columns[:2], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array([k for _, k in kept], pa.binary()).cast(pa.string())],
                    names=["doc", "tag", "n_words", "n_removed", "kept"],
                )

    return judged.mapInArrow(cut, "doc long, tag long, n_words long, n_removed long, kept string")
