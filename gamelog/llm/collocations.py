"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from frequent prefixes. The counts of the parts of a phrase bound
its own count and its score from above, and those of everything grown from it, before it is
counted. The frontier with bounds above a high bar is grown first; a language whose last
wanted surviving score reaches the bar is settled, as nothing left below can enter or tie.
Only the others are grown on, below the bar.

Tasks count phrases by 64-bit hashes in numpy and exchange them packed. What the next level
needs of the counts, a bound for any phrase, fits a table of bounded size: slots hold the
least and the greatest count of the phrases hashed to them. Fuller slots only loosen bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.marks import changes
from gamelog.llm.tables import find_package, shuffle_partitions, stored, text_buckets
from gamelog.llm.textbytes import LOWER, U64, mix, row_slices, span_codes, utf8, windows, word_spans

LONGEST = 4
#: All frequent phrases up to this length are counted, whatever the bar: any pair of words
#: can be part of a phrase of the best score.
WHOLE = 2
#: Scores are in these many parts of twice the perfect one.
SCALE = 2_000_000
#: Bars of the score, highest first; the last one must be 0.
BARS = (50_000, 0)
#: A phrase is dropped if a longer one holds it and has this share of its count.
HELD = 80
#: Slots of a table of bounds for each phrase in it, and their greatest number (64 MB).
SLOTS_EACH, MOST_BITS = 32, 24
#: Steps of the logarithm that a slot keeps of a count.
LOG_STEP = 0.0005
#: Occurrences gathered before they are counted and sent, and names before they are sent;
#: both bound a task's memory.
GATHERED, NAMED = 4_000_000, 60_000

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
WORD = ~SEPARATOR
WORD[[0x20, 0x09]] = False

COUNTS = "bucket int, entries binary"
NAMES = "lang string, k int, phrase string, key long, lefts array<long>, rights array<long>, words long"


@dataclass
class Bounds:
    """Least and greatest count of the frequent phrases of one length, by slot of their hash."""

    low: np.ndarray
    high: np.ndarray

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A lower and an upper bound of each phrase's count; 0 and 0 if it is not frequent."""
        slot = (keys >> U64(64 - (len(self.low).bit_length() - 1))).astype(np.int64)
        return _LOWER[self.low[slot]], _UPPER[self.high[slot]]


_LOWER = np.concatenate([[0.0], np.exp(LOG_STEP * np.arange(0, 65535)) * (1 - 1e-9)])
_UPPER = np.concatenate([[0.0], np.exp(LOG_STEP * np.arange(0, 65535)) * (1 + 1e-9)])


@lru_cache(maxsize=None)
def _language(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little")


@dataclass
class Words:
    """The words of some rows, and the hashes of the phrases that start at each of them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    keys: list[np.ndarray]  # by length - 1; a phrase that leaves its piece is hashed, too

    def inside(self, size: int) -> np.ndarray:
        """Whether the phrase of ``size`` words from each place lies in one piece."""
        return self.piece[size - 1 :] == self.piece[: len(self.piece) - size + 1]


def _words(data: np.ndarray, offsets: np.ndarray, languages: np.ndarray, most: int) -> Words:
    folded = LOWER[data]
    start, end, first = word_spans(folded, offsets, WORD)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    codes = mix(span_codes(folded, start, end) ^ languages[row])
    piece = np.cumsum(SEPARATOR[folded])[start] + row if len(start) else start
    keys = [mix(windows(codes, k) + U64(k)) for k in range(1, most + 1)]
    return Words(folded, start, end, row, piece, keys)


def _read(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[str], Words]]:
    """(language of each row, words) of slices of (lang, text)."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        names = batch.column(0).to_pylist()
        languages = np.array([_language(n) for n in names], U64)
        for low, high in row_slices(offsets):
            part = data[offsets[low] : offsets[high]]
            yield names[low:high], _words(part, offsets[low : high + 1] - offsets[low], languages[low:high], most)


def _wanted(words: Words, tables: list[Bounds], size: int, least: int, bar: float) -> np.ndarray:
    """Starts of the phrases of ``size`` words that may matter at the bar.

    A phrase matters if it or one grown from it (to the right or to the left) can score as
    much as the bar, or if it can hold one word less with ``HELD`` per cent of a count that
    scores as much. ``tables`` bound the counts of all shorter phrases.
    """
    places = np.flatnonzero(words.inside(size))
    if not tables or not len(places):
        return places
    parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def bound(offset: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        if (offset, length) not in parts:
            parts[offset, length] = tables[length - 1].of(words.keys[length - 1][places + offset])
        return parts[offset, length]

    def cuts(offset: int, length: int) -> np.ndarray:
        """A lower bound of l + r, over all cuts of a part."""
        sums = [bound(offset, k)[0] + bound(offset + k, length - k)[0] for k in range(1, length)]
        return reduce(np.maximum, sums)

    def possible(offset: int) -> np.ndarray:
        """An upper bound of the count of a part of one word less, be it counted or left out
        (then its slot may hold others with smaller counts)."""
        if not bar or size <= WHOLE + 1:
            return bound(offset, size - 1)[1]
        return np.minimum(bound(offset, size - 2)[1], bound(offset + 1, size - 2)[1])

    loose = np.minimum(possible(0), possible(1))
    alive = loose >= least
    places, loose, parts = places[alive], loose[alive], {key: (low[alive], high[alive]) for key, (low, high) in parts.items()}
    if not bar or size <= WHOLE or not len(places):
        return places
    # what can score as much has counted parts only
    most = np.minimum(bound(0, size - 1)[1], bound(1, size - 1)[1])
    if size < LONGEST:
        below = np.minimum(bound(0, 1)[0], bound(size - 1, 1)[0]) + most
    else:
        below = cuts(0, size)
    matters = (most >= least) & (SCALE * most >= bar * below)
    for offset in (0, 1):
        low, high = bound(offset, size - 1)
        scores = (high > 0) & (SCALE * high >= bar * cuts(offset, size - 1))
        matters |= scores & (100 * loose >= HELD * low)
    return places[matters]


def _telling(words: Words, tables: list[Bounds], size: int, places: np.ndarray, least: int, bar: float) -> np.ndarray:
    """Those of ``places`` whose phrases must be named at the bar: frequent ones that can score
    as much, or hold one word less with ``HELD`` per cent of a count that scores as much.

    ``tables`` bound the counts of these phrases, too. What scores as much has counted parts
    only, so a part that was left out (its slot may hold others) loses nothing here.
    """
    upper = lambda at: tables[size - 1].of(words.keys[size - 1][at])[1]
    places = places[upper(places) >= least]
    if not bar or not len(places):
        return places

    def low(offset: int, length: int) -> np.ndarray:
        return tables[length - 1].of(words.keys[length - 1][places + offset])[0]

    def can_score(most: np.ndarray, offset: int, length: int) -> np.ndarray:
        sums = [low(offset, k) + low(offset + k, length - k) for k in range(1, length)]
        return SCALE * most >= bar * reduce(np.maximum, sums)

    most = upper(places)
    told = can_score(most, 0, size)
    if size > 2:
        for offset in (0, 1):
            least_held, most_held = tables[size - 2].of(words.keys[size - 2][places + offset])
            told |= (100 * most >= HELD * least_held) & can_score(most_held, offset, size - 1)
    return places[told]


def _packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted keys and counts, a row per bucket: steps between keys by byte plane."""
    ends = np.searchsorted((keys >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))
    rows = []
    for b in np.flatnonzero(np.diff(ends)):
        mine = slice(ends[b], ends[b + 1])
        steps = np.diff(keys[mine], prepend=U64(0)).view(np.uint8).reshape(-1, 8)
        raw = np.ascontiguousarray(steps.T).tobytes() + counts[mine].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        rows.append((int(b), zstandard.compress(raw, 1)))
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.binary())], names=["bucket", "entries"])


def _unpacked(entries: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(entries), np.uint8)
    size = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(U64).ravel()
    counts = np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=U64), counts.astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(changes(keys))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def phrase_counts(docs: DataFrame, size: int, tables, least: int, bar: float, buckets: int) -> DataFrame:
    """(key, f) of the phrases of ``size`` words that may matter and occur ``least`` times."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, gathered = [], 0
        bounds = tables.value
        for _, words in _read(batches, size):
            if len(words.start) >= size:
                parts.append(words.keys[size - 1][_wanted(words, bounds, size, least, bar)])
                gathered += len(parts[-1])
            if gathered >= GATHERED:
                yield _packed(*np.unique(np.concatenate(parts), return_counts=True), buckets)
                parts, gathered = [], 0
        if gathered:
            yield _packed(*np.unique(np.concatenate(parts), return_counts=True), buckets)

    def meet(table: pa.Table) -> pa.Table:
        keys, counts = zip(*(_unpacked(e.as_py()) for e in table["entries"]))
        keys, counts = _added(np.concatenate(keys), np.concatenate(counts))
        often = np.flatnonzero(counts >= least)
        return pa.table({"key": keys[often].view(np.int64), "f": counts[often]})

    return docs.mapInArrow(scan, COUNTS).groupBy("bucket").applyInArrow(meet, "key long, f long")


def bounds_of(counts: DataFrame) -> Bounds:
    """The table of bounds of counted phrases: bounded, whatever their number."""
    size = counts.count()
    bits = min(MOST_BITS, max(8, (SLOTS_EACH * size - 1).bit_length()))
    shares = 1 << max(0, bits - 16)  # slots of a share lie together

    def fill(table: pa.Table) -> pa.Table:
        keys = table["key"].to_numpy().view(U64)
        steps = np.log(table["f"].to_numpy()) / LOG_STEP
        slot = (keys >> U64(64 - bits)).astype(np.int64)
        share = slot[0] // ((1 << bits) // shares)
        slot -= share * ((1 << bits) // shares)
        low = np.full((1 << bits) // shares, 65535, np.uint16)
        high = np.zeros((1 << bits) // shares, np.uint16)
        np.minimum.at(low, slot, (np.minimum(np.floor(steps), 65533) + 1).astype(np.uint16))
        np.maximum.at(high, slot, (np.minimum(np.ceil(steps), 65534) + 1).astype(np.uint16))
        low[high == 0] = 0
        return pa.table({"share": [int(share)], "low": [low.tobytes()], "high": [high.tobytes()]})

    top_bits = shares.bit_length() - 1
    share = F.shiftrightunsigned("key", 64 - top_bits) if top_bits else F.lit(0).cast("long")
    rows = counts.withColumn("share", share).groupBy("share").applyInArrow(fill, "share long, low binary, high binary").collect()
    low, high = np.zeros((2, 1 << bits), np.uint16)
    width = (1 << bits) // shares
    for r in rows:
        at = r["share"] * width
        low[at : at + width] = np.frombuffer(r["low"], np.uint16)
        high[at : at + width] = np.frombuffer(r["high"], np.uint16)
    return Bounds(low, high)


def phrase_names(docs: DataFrame, tables, least: int, bar: float) -> DataFrame:
    """Every phrase that can reach the bar or hold one that does, with the hashes of the parts
    of each cut; and the number of words of each language (k = 0)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = tables.value
        seen: dict[int, tuple] = {}
        totals: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*seen.values())] or [[] for _ in range(6)]
            for name, count in totals.items():
                for column, value in zip(columns, (name, 0, None, None, None, None)):
                    column.append(value)
            words = [None] * len(seen) + list(totals.values())
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(words, pa.int64())]
            return pa.record_batch(arrays, names=["lang", "k", "phrase", "key", "lefts", "rights", "words"])

        for names, words in _read(batches, LONGEST):
            for row, count in zip(*np.unique(words.row, return_counts=True)):
                totals[names[row]] = totals.get(names[row], 0) + int(count)
            signed = [k.view(np.int64) for k in words.keys]
            for size in range(2, LONGEST + 1):
                if len(words.start) < size:
                    break
                places = _wanted(words, bounds[: size - 1], size, least, bar)
                places = _telling(words, bounds[:size], size, places, least, bar)
                fresh, first = np.unique(signed[size - 1][places], return_index=True)
                for key, at in zip(fresh.tolist(), places[first].tolist()):
                    if key not in seen:
                        raw = words.data[words.start[at] : words.end[at + size - 1]].tobytes()
                        lefts = [int(signed[k - 1][at]) for k in range(1, size)]
                        rights = [int(signed[size - k - 1][at + k]) for k in range(1, size)]
                        phrase = b" ".join(raw.split()).decode("utf-8", "replace")
                        seen[key] = (names[words.row[at]], size, phrase, key, lefts, rights)
            if len(seen) >= NAMED:
                yield rows()
                seen, totals = {}, {}
        yield rows()

    return docs.mapInArrow(scan, NAMES)


def _exact(column):
    return column.cast("decimal(38,0)")


def scored_phrases(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, key, k, a, l, r, score, most) of counted phrases: their lowest cut, and
    the count of the longest-lived phrase that is one word longer and holds them."""
    known = names.filter("k > 0").dropDuplicates(["key"]).join(counts.withColumnRenamed("f", "a"), "key")
    part = lambda side, value: counts.select(F.col("key").alias(side), F.col("f").alias(value))
    cuts = known.select("key", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "parts"))
    cuts = cuts.select("key", "a", "cut", F.col("parts.lefts").alias("left"), F.col("parts.rights").alias("right"))
    counted = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    counted = counted.withColumn("parts", _exact(F.lit(SCALE)) * _exact(F.col("a"))).withColumn("both", _exact(F.col("l") + F.col("r")))
    lowest = (
        counted.groupBy("key")
        .agg(F.min(F.struct(F.expr("parts div both").alias("score"), "cut", "l", "r")).alias("lowest"), F.count("*").alias("found"))
        .select("key", "found", "lowest.score", "lowest.l", "lowest.r")
    )
    longer = known.filter("k > 2").select("a", F.explode(F.array(F.element_at("lefts", -1), F.element_at("rights", 1))).alias("key"))
    held = longer.groupBy("key").agg(F.max("a").alias("most"))
    # a part that was left out as below the bar takes its phrase below the bar
    whole = known.select("lang", "phrase", "key", "k", "a").join(lowest, "key").filter("found = k - 1")
    return whole.join(held, "key", "left")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 4 words.

    Letters A-Z are folded; texts are cut at ``.,;:!?`` and line ends into pieces and those
    at blanks into words; a NULL text is empty, a NULL lang is ``und``. Everything is counted
    per language, repeated rows as often as they are there. A phrase needs ``least``
    occurrences ``a``; its score is 2000000 a / (l + r), floored, for the cut where that is
    lowest (the first such cut). Phrases that lie in a longer one with 80 per cent of their
    count are left out. Order: score, count, then phrase by bytes. Products are decimals of
    38 digits. A table without frequent phrases gives no rows. Other columns are not read;
    ids are not needed. Phrases are told apart by 64-bit hashes of their words and language.

    The driver keeps the tables of bounds and one name per language that is not settled.
    """
    spark = docs.sparkSession
    find_package(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.col("text").isNotNull())
    buckets = text_buckets(texts)

    def level(rows: DataFrame, counted: list[DataFrame], tables: list[Bounds], bar: float) -> None:
        """Count the next longer phrases and add their bounds."""
        sent = spark.sparkContext.broadcast(list(tables))
        counted.append(stored(phrase_counts(rows, len(counted) + 1, sent, least, bar, buckets)))
        tables.append(bounds_of(counted[-1]))

    shared: tuple[list[DataFrame], list[Bounds]] = [], []
    for _ in range(WHOLE):
        level(texts, *shared, 0)
    totals, results = None, []
    for bar in BARS:
        counted, tables = list(shared[0]), list(shared[1])
        while len(counted) < LONGEST:
            level(texts, counted, tables, bar)
        names = stored(phrase_names(texts, spark.sparkContext.broadcast(tables), least, bar))
        if totals is None:
            totals = names.filter("k = 0").groupBy("lang").agg(F.sum("words").alias("n"))
        scored = scored_phrases(names, reduce(DataFrame.union, counted))
        alone = F.col("most").isNull() | (_exact(F.lit(100)) * _exact(F.col("most")) < _exact(F.lit(HELD)) * _exact(F.col("a")))
        order = (F.desc("score"), F.desc("a"), "phrase")
        # shares of a language are ranked apart, so that few rows of it meet in one task
        share = Window.partitionBy("lang", F.pmod("key", F.lit(shuffle_partitions(spark)))).orderBy(*order)
        ahead = scored.filter(alone & (F.col("score") >= bar)).withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
        ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        best = stored(ranked.filter(F.col("rank") <= top))
        if not bar:
            results.append(best)
            break
        full = best.groupBy("lang").count().filter(F.col("count") >= top).select("lang")
        results.append(best.join(full, "lang", "left_semi"))
        settled = [r["lang"] for r in full.collect()]
        if not names.filter((F.col("k") == 0) & ~F.col("lang").isin(settled)).limit(1).count():
            break
        texts = texts.filter(~F.col("lang").isin(settled))
    found = reduce(DataFrame.unionByName, results).join(totals, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
