"""Near-duplicate components by b-bit MinHash.

Every shingle set gets ``BANDS * ROWS`` minima. Bands of whole minima make candidates; of
each minimum only ``BITS`` bits are kept, packed, and bit counts estimate the similarity of
candidates, corrected for minima that agree in these bits by chance. What the estimate does
not rule out is confirmed on the full sets.

Documents of equal sets are one set. A band that many sets share is never paired off whole:
first its sets are compared with its most central one, and once links have joined them into
few components, only sets of different components are compared, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.byte_bpe import binary_rows
from gamelog.llm.components import connected
from gamelog.llm.jaccard_join import overlap, shingle_sets
from gamelog.llm.tables import checkpointed, join_hot, row_count, shuffle_partitions, stored
from gamelog.llm.textbytes import U64, mix, row_slices, utf8

#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 5e-7 at 0.8.
BANDS, ROWS = 48, 6
#: Bits kept of every minimum: 72 bytes a set.
BITS = 2
HASHES = BANDS * ROWS
#: Estimates this many standard deviations below the threshold are ruled out (3e-7).
DEVIATIONS = 5.0
#: Sets on either side of a block of comparisons; bounds a task's memory.
BLOCK = 2048
U32 = np.uint32
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(U32) | U32(1)
FACTORS, OTHERS = _SEEDS[:HASHES], _SEEDS[HASHES:]

SKETCH = "doc long, tag long, id long, n long, bits binary, bands array<long>"


def minima(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """The least of each hash function over each row's shingles (``row`` is sorted)."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    low, high = key.astype(U32), (key >> U64(32)).astype(U32)
    out = np.full((HASHES, rows), U32(0xFFFFFFFF))
    filled = row[first]
    for k in range(HASHES if len(first) else 0):
        out[k, filled] = np.minimum.reduceat(low * FACTORS[k] + high * OTHERS[k], first)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """(rows, bytes): the low bits of every remixed minimum, one bit plane after another."""
    mixed = (least ^ (least >> U32(15))) * U32(0x2C1B3C6D)
    mixed ^= mixed >> U32(12)
    planes = [np.packbits((mixed >> U32(b)).astype(np.uint8) & 1, axis=0) for b in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes).T)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(bands, rows): a 64-bit name of the minima in each band, different for each band."""
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=U64)[:, None], least.shape[1], axis=1)
    for r in range(ROWS):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + least[r::ROWS].astype(U64))
    return keys


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates from packed bits, all rows of ``a`` with all rows of ``b`` or row by row.

    Minima that differ agree in their bits with probability 2**-BITS; that part is taken out.
    """
    differ = reduce(np.bitwise_or, np.split(a ^ b, BITS, axis=-1))
    same = HASHES - np.bitwise_count(differ).sum(-1, dtype=np.int32)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate below which a pair at the threshold lies with probability 3e-7."""
    chance = 2.0**-BITS
    agree = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - DEVIATIONS * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc, tag, id, n, bits, bands) of every row: the name and size of its set, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for low, high in row_slices(offsets):
                part = batch.slice(low, high - low)
                row, key = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                count = np.bincount(row, minlength=high - low)
                least = minima(row, key, high - low)
                keys = band_keys(least).T.copy().view(np.int64)
                bits = packed_bits(least)
                ends = np.arange(high - low + 1)
                yield pa.record_batch(
                    [
                        *part.columns[:2],
                        pa.array(set_names(row, key, count)),
                        pa.array(count),
                        binary_rows(bits.ravel(), ends * bits.shape[1]),
                        pa.ListArray.from_arrays(pa.array(ends * BANDS, pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["doc", "tag", "id", "n", "bits", "bands"],
                )

    return docs.mapInArrow(run, SKETCH)


def set_names(row: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set, from its shingles in any order."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(key ^ U64(0xA5A5A5A5)), dtype=U64)])
    ends = np.concatenate([[0], np.cumsum(count)])
    return mix(total[ends[1:]] - total[ends[:-1]] + mix(count.astype(U64))).view(np.int64)


def full_sets(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(id, tokens): the sorted shingles of the sets whose first rows are (doc, tag, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in row_slices(offsets):
                row, key = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                ends = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.record_batch([batch.column(1).slice(low, high - low), binary_rows(key.view(np.uint8), ends * 8)], names=["id", "tokens"])

    texts = docs.join(rows, ["doc", "tag"]).select("text", "id")
    return texts.mapInArrow(run, "id long, tokens binary").dropDuplicates(["id"])


def estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) that sizes and estimates do not rule out."""
    of = lambda name: sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c)) for c in ("bits_a", "bits_b"))
            yield batch.select(["a", "b"]).filter(pa.array(similarity(a, b) >= least))

    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    met = join_hot(join_hot(pairs, of("a"), ["a"]), of("b"), ["b"], rows=pairs).filter(near)
    return met.mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def confirmed(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose full sets reach the threshold."""
    of = lambda name: tokens.select(F.col("id").alias(name), F.col("tokens").alias(f"tokens_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                x, y = (np.frombuffer(raw.as_buffer(), "<u8") for raw in (x, y))
                both = overlap(x, y)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    met = join_hot(join_hot(pairs, of("a"), ["a"]), of("b"), ["b"], rows=pairs)
    return met.mapInArrow(run, "a long, b long")


def star_pairs(met: DataFrame) -> DataFrame:
    """(a, b): every set with the most central set of each of its bands."""
    leader = F.max(F.struct(F.round("weight", 6).alias("rank"), F.col("id").alias("leader"))).alias("top")
    tops = met.groupBy("key").agg(leader).select("key", "top.leader")
    pairs = join_hot(met, tops, ["key"]).filter(F.col("id") != F.col("leader"))
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _laid_out(met: DataFrame, columns: DataFrame) -> DataFrame:
    """The sets of every band in blocks, with ``columns`` by id, and beside each block the
    sets that it must be compared with (``minor``), in chunks.

    The sets of a band's largest label need no comparison with each other: all others, the
    minor ones, go to every block of the band.
    """
    labels = met.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = labels.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"))
    spans = largest.select(
        "key",
        F.col("top.label").alias("main"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("chunks"),
    ).filter("chunks > 0")
    dealt = join_hot(met.select("key", "id", "label"), spans, ["key"])
    dealt = join_hot(dealt, columns, ["id"], rows=met)
    place = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    minor = dealt.filter(F.col("label") != F.col("main")).withColumn("chunk", place(1, "chunks")).withColumn("block", upto("blocks"))
    whole = dealt.withColumn("block", place(2, "blocks")).withColumn("chunk", upto("chunks"))
    names = ["key", "block", "chunk", "minor", "label", *columns.columns]
    sides = [df.withColumn("minor", F.lit(m)).select(names) for df, m in ((minor, 1), (whole, 0))]
    rows = sides[0].union(sides[1]).repartition(shuffle_partitions(met.sparkSession), "key", "block", "chunk")
    return rows.sortWithinPartitions("key", "block", "chunk", F.desc("minor"), "id")


@dataclass
class Side:
    """Sets of a block or a chunk, column by column."""

    label: np.ndarray
    id: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    bands: np.ndarray
    tokens: list

    @staticmethod
    def of(rows: list[tuple]) -> Side:
        label, ids, n, bits, bands, *tokens = zip(*rows)
        packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(rows), -1)
        return Side(np.array(label), np.array(ids), np.array(n), packed, np.array(bands), [np.frombuffer(t, "<u8") for t in tokens[0]] if tokens else [])


def _candidates(few: Side, k: int, many: Side, key: int, percent: int) -> np.ndarray:
    """Sets of other labels that the estimate does not rule out beside set ``k`` of ``few``,
    the likeliest first; a pair is met in the first band that it shares."""
    likely = similarity(few.bits[k], many.bits)
    band = int((few.bands[k] == key).argmax())
    ruled_out = (many.label == few.label[k]) | (many.bands[:, :band] == few.bands[k, :band]).any(1)
    ruled_out |= 100 * np.minimum(few.n[k], many.n) < percent * np.maximum(few.n[k], many.n)
    hits = np.flatnonzero(~ruled_out & (likely >= least_estimate(percent)))
    return hits[np.lexsort((many.id[hits], -likely[hits]))]


def _over_blocks(rows: DataFrame, judge: Callable[[Side, Side, int], set], schema: str) -> DataFrame:
    """What ``judge`` finds in every block beside its minor sets; at most BLOCK rows of a
    block and one batch are held besides."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, few, many, found = None, [], [], set()

        def judged() -> set:
            return judge(Side.of(few), Side.of(many), group[0]) if few and many else set()

        for batch in batches:
            for key, block, chunk, is_minor, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block, chunk) != group:
                    found |= judged()
                    group, few, many = (key, block, chunk), [], []
                (few if is_minor else many).append(row)
            if len(many) >= BLOCK:
                found |= judged()
                many = []
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*sorted(found))], names=names)
                found = set()
        found |= judged()
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*sorted(found))], names=names)

    return rows.mapInArrow(run, schema).distinct()


def block_links(met: DataFrame, sets: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets of different labels, at least one for each set and label
    that it is linked to.

    First the packed bits tell which sets have a likely partner; only these meet again with
    their full sets. Of each set only its first confirmed link to a label is given.
    """

    def near(few: Side, many: Side, key: int) -> set:
        found = set()
        for k in range(len(few.id)):
            hits = _candidates(few, k, many, key, percent)
            if len(hits):
                found.add((key, int(few.id[k])))
                found.update((key, i) for i in many.id[hits].tolist())
        return found

    def linked(few: Side, many: Side, key: int) -> set:
        found = set()
        for k in range(len(few.id)):
            known = set()
            for h in _candidates(few, k, many, key, percent).tolist():
                if many.label[h] in known:
                    continue
                both = overlap(few.tokens[k], many.tokens[h])
                if 100 * both >= percent * (few.n[k] + many.n[h] - both):
                    known.add(many.label[h])
                    found.add((int(min(few.id[k], many.id[h])), int(max(few.id[k], many.id[h]))))
        return found

    columns = sets.select("id", "n", "bits", "bands")
    likely = _over_blocks(_laid_out(met, columns), near, "key long, id long")
    met = checkpointed(met.join(likely, ["key", "id"], "left_semi"))
    return _over_blocks(_laid_out(met, columns.join(tokens, "id")), linked, "a long, b long")


def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a ``label``, replaced by what it is connected to in (node, root)."""
    known = join_hot(rows, roots.select(F.col("node").alias("label"), "root"), ["label"], "left")
    return known.withColumn("label", F.coalesce("root", "label")).select(rows.columns)


def open_bands(met: DataFrame) -> DataFrame:
    """The rows of the bands whose sets are in more than one component."""
    several = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return checkpointed(join_hot(met, several, ["key"]).select(met.columns))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc, tag, n_shingles, component_doc, component_tag) of every row of ``docs``
    (``tables.keyed_texts``), repeated rows repeated.

    Words are runs of bytes other than the six ASCII white spaces, A-Z folded; a document's
    set are its distinct ``size``-word shingles, its whole sequence if it has fewer words,
    and empty without words. Documents are linked if their sets' intersection has at least
    ``percent`` per cent of their union; empty sets are linked with nothing, so they are
    components of their own. A component is named by its smallest (doc, tag); the key of a
    NULL id comes first. Equal sets are one set. No false link is made; a pair at the
    threshold is missed with a probability below 1e-6, more similar ones with less.
    """
    sketched = stored(sketches(docs, size))
    filled = sketched.filter(F.col("n") > 0)
    one = lambda c: F.first(c).alias(c)  # noqa: E731  (equal for all rows of a set)
    sets = stored(filled.groupBy("id").agg(F.min(F.struct("doc", "tag")).alias("first"), one("n"), one("bits"), one("bands")))
    dealt = sets.select(F.explode("bands").alias("key"), "id").repartition(shuffle_partitions(docs.sparkSession), "key")
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > 1)
    met = checkpointed(dealt.join(shared, "key"))
    # sets that share their bands with many others are the most central ones of their group
    weights = checkpointed(met.groupBy("id").agg(F.sum(F.log(F.col("sets").cast("double"))).alias("weight")))
    met = checkpointed(join_hot(met.drop("sets"), weights, ["id"]).withColumn("label", F.col("id")))
    rows = sets.join(weights.select("id"), "id", "left_semi").select("first.*", "id")
    tokens = stored(full_sets(docs, rows, size))
    named = weights.select("id", F.col("id").alias("label"))
    steps = (
        lambda m: confirmed(checkpointed(estimated(checkpointed(star_pairs(m)), sets, percent)), tokens, percent),
        lambda m: block_links(m, sets, tokens, percent),
    )
    for last, step in zip((False, True), steps):
        if met.isEmpty():
            break
        found = checkpointed(step(met))
        if row_count(found):
            # links of components: only sets of different ones were compared
            of = lambda side: named.select(F.col("id").alias(side), F.col("label").alias(f"of_{side}"))
            ends = join_hot(join_hot(found, of("a"), ["a"]), of("b"), ["b"], rows=found)
            roots = connected(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
            named = checkpointed(labelled(named, roots))
            met = met if last else checkpointed(labelled(met, roots))
        if not last:
            met = open_bands(met)
    first = sets.select("id", "first").join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "first")
    first = checkpointed(first)
    least = first.groupBy("label").agg(F.min("first").alias("least"))
    first = join_hot(first, least, ["label"]).select("id", F.col("least").alias("first"))
    together = join_hot(sketched.select("doc", "tag", "id", "n"), first, ["id"], "left")
    return together.select(
        "doc",
        "tag",
        F.col("n").alias("n_shingles"),
        F.coalesce("first.doc", "doc").alias("component_doc"),
        F.coalesce("first.tag", "tag").alias("component_tag"),
    )
