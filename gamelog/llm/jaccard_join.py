"""Near-duplicate components by an exact n-gram Jaccard join with set-relation skipping.

Documents of equal shingle sets are one set. Spark counts in how many sets each shingle
occurs; a set with too many shingles of its own matches nothing. The rest are joined by
their prefixes in rising frequency, and two relations between sets save work:

* Answers of similar sets. Sets that verify against a leader leave the search with the
  number of shingles they have beyond it. What the leader shares with a third set bounds
  what they share with it, so the leader's answer settles theirs, and only pairs that it
  leaves open are compared themselves. Links within a leader's group need no comparison.
* Blocks of index lists. The list of a shingle keeps one block per group, with the best
  position and the range of sizes in it; a pair of blocks that cannot reach the threshold
  is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.components import connected
from gamelog.llm.marks import PACKED, PACKED_ARROW, Entries, changes, deal, gathered, together, unpack
from gamelog.llm.tables import checkpointed, join_hot, shuffle_partitions, stored, text_buckets
from gamelog.llm.textbytes import LOWER, NOT_SPACE, U64, mix, room, row_slices, span_codes, utf8, windows, word_spans

#: Shares of a group in the rounds that look for leaders: a large group of copies is first
#: split by hash, its leaders meet in later rounds.
ROUND_SHARES = (32, 4, 1, 1)
#: Leaders that a set is compared with in one round, at most; they are the sets of its group
#: that hold the most widespread shingles and match no leader before them.
LEADERS = 12
KEY_BYTES = 6
SIZE_BITS = np.int64(40)
SIZE_MASK = (np.int64(1) << SIZE_BITS) - np.int64(1)
#: Frequencies above this are equal in the order of shingles; any fixed order is right.
TOP_FREQUENCY = 2**15 - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of every distinct shingle, by row. Letters A-Z are folded; rows
    with fewer words than ``size`` have their whole sequence as one shingle, or none."""
    folded = LOWER[data]
    start, end, first = word_spans(folded, offsets, NOT_SPACE)
    codes = span_codes(folded, start, end)
    at, count = room(first, size)
    rows = [np.repeat(np.arange(len(count)), count)]
    keys = [mix(windows(codes, size)[at] + U64(size)) if len(at) else np.empty(0, U64)]
    words = np.diff(first)
    for fewer in range(1, size):
        row = np.flatnonzero(words == fewer)
        if len(row):
            rows.append(row)
            keys.append(mix(windows(codes, fewer)[first[row]] + U64(fewer)))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = changes(row, key)
    return row[new], key[new]


def _sets(batch: pa.RecordBatch, size: int):
    """Of every slice: its row range, each row's set size and signature, and the shingles."""
    data, offsets = utf8(batch.column(2))
    for low, high in row_slices(offsets):
        row, key = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
        count = np.bincount(row, minlength=high - low)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(key ^ U64(0xA5A5A5A5)), dtype=U64)])
        ends = np.concatenate([[0], np.cumsum(count)])
        sums = total[ends[1:]] - total[ends[:-1]]
        yield low, high, count, mix(sums + mix(count.astype(U64))).view(np.int64), row, key


def set_members(docs: DataFrame, size: int) -> DataFrame:
    """(doc, tag, id, n) of every row: its set's signature and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count, ids, *_ in _sets(batch, size):
                part = batch.slice(low, high - low)
                yield pa.record_batch([*part.columns[:2], pa.array(ids), pa.array(count)], names=["doc", "tag", "id", "n"])

    return docs.mapInArrow(run, "doc long, tag long, id long, n long")


def shared_shingles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, tokens, prefix, places, keys) of the sets that may match another one.

    ``tokens`` are the shingles that other sets have too, sorted; ``prefix`` those among
    the first n - ceil(percent n / 100) + 1 of the set in rising frequency, with their
    places in that order; ``keys`` the minima of several hashes of the tokens; ``spread`` the
    mean log frequency of all its shingles: the least edited of many copies has the most.
    """
    buckets = min(2 * text_buckets(docs), 1 << 16)  # the number fits beside the key's bytes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
            for _, _, count, ids, row, key in _sets(batch, size):
                yield Entries(ids[row], count[row], np.zeros(len(row), np.int64), (key,))

        for e in gathered(batches, entries):
            e = e.take(np.lexsort((e.keys[0], e.doc)))
            yield from deal(e.take(np.flatnonzero(changes(e.doc, e.keys[0]))), buckets, (KEY_BYTES,))

    def count(table: pa.Table) -> pa.Table:
        e = Entries.joined([unpack(m, k, (KEY_BYTES,)) for m, k in zip(table["meta"].to_pylist(), table["keys"].to_pylist())])
        e = e.take(np.lexsort((e.doc, e.keys[0])))
        e = e.take(np.flatnonzero(changes(e.doc, e.keys[0])))
        head = np.flatnonzero(changes(e.keys[0]))
        sets = np.diff(np.append(head, len(e)))
        frequency = np.repeat(np.minimum(sets, TOP_FREQUENCY), sets)
        both = np.flatnonzero(frequency > 1)
        # bucket and bytes name the shingle; the frequency goes beside the size
        token = (e.keys[0][both] | U64(table["bucket"][0].as_py()) << U64(8 * KEY_BYTES)).view(np.int64)
        sized = e.tag[both] | frequency[both] << SIZE_BITS
        found = together(Entries(e.doc[both], sized, token, (mix(e.doc[both].view(U64)),)))
        batches = list(deal(found, buckets, ()))
        return pa.Table.from_batches(batches) if batches else PACKED_ARROW.empty_table()

    def gather(table: pa.Table) -> pa.Table:
        e = Entries.joined([unpack(m, None, ()) for m in table["meta"].to_pylist()])
        e = e.take(np.lexsort((e.at, e.tag, e.doc)))  # by set in rising frequency
        ends = np.append(np.flatnonzero(changes(e.doc)), len(e))
        rows = []
        for low, high in zip(ends, ends[1:]):
            n, shared = int(e.tag[low] & SIZE_MASK), high - low
            need = -(-percent * n // 100)
            if shared < need:
                continue
            own = n - shared
            tokens = e.at[low:high]
            spread = float(np.log(e.tag[low:high] >> SIZE_BITS).sum() / n)
            prefix = tokens[: max(0, n - need + 1 - own)]
            keys = [int(mix(tokens.view(U64) + U64(r + 1)).min() >> U64(1)) for r in range(len(ROUND_SHARES))]
            rows.append((int(e.doc[low]), n, np.sort(tokens).astype("<i8").tobytes(), prefix.tolist(), list(range(own, own + len(prefix))), keys, spread))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS)], schema=_SETS) if rows else _SETS.empty_table()

    packed = docs.mapInArrow(scan, PACKED).groupBy("bucket").applyInArrow(count, PACKED)
    return packed.groupBy("bucket").applyInArrow(gather, SETS)


SETS = "id long, n long, tokens binary, prefix array<long>, places array<int>, keys array<long>, spread double"
_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("spread", pa.float64())])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct numbers share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(shared, n, m, percent: int):
    """Whether intersection / union reaches the threshold (numbers or columns)."""
    return 100 * shared >= percent * (n + m - shared)


def leader_links(sets: DataFrame, number: int, shares: int, percent: int) -> DataFrame:
    """(id, leader, beyond): sets that match a leader among the sets with their key in one round.

    ``beyond`` is the number of shingles the set has and its leader has not.
    """
    keyed = sets.select(
        F.col("keys")[number].alias("key"), F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share"), "id", "n", "tokens", "spread"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            rows = []
            for key, share, own, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                mine = np.frombuffer(raw, "<i8")
                if (key, share) != group:
                    group, leaders = (key, share), []
                for leader, size, tokens in leaders:
                    both = overlap(mine, tokens)
                    if own != leader and _linked(both, n, size, percent):
                        rows.append((own, leader, n - both))
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((own, n, mine))
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "leader", "beyond"])

    met = keyed.repartition(shuffle_partitions(sets.sparkSession), "key", "share").sortWithinPartitions("key", "share", F.desc("spread"), "id")
    return met.drop("spread").mapInArrow(run, "id long, leader long, beyond long")


def grouped_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(id, root, beyond) of every set: the leader its leaders lead to, or itself, and a
    bound of the shingles it has beyond that root."""
    left, links = sets, []
    for number, shares in enumerate(ROUND_SHARES):
        found = checkpointed(leader_links(left, number, shares, percent))
        links.append(found)
        left = left.join(found.select("id"), "id", "left_anti")
    up = reduce(DataFrame.union, links)
    for _ in range(len(ROUND_SHARES) - 1):
        above = up.select(F.col("id").alias("leader"), F.col("leader").alias("top"), F.col("beyond").alias("more"))
        up = up.join(above, "leader", "left").select(
            "id", F.coalesce("top", "leader").alias("leader"), (F.col("beyond") + F.coalesce("more", F.lit(0))).alias("beyond")
        )
    own = sets.select("id").join(up, "id", "left")
    return own.select("id", F.coalesce("leader", "id").alias("root"), F.coalesce("beyond", F.lit(0).cast("long")).alias("beyond"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the number of shingles they share, compared exactly."""
    of = lambda name: sets.select(F.col("id").alias(name), F.col("tokens").alias(f"{name}_tokens"))
    whole = pairs.join(of("a"), "a").join(of("b"), "b")
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a_tokens", "b_tokens"))
            both = [overlap(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")) for x, y in zip(a, b)]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(both, pa.int64())], names=[*kept, "shared"])

    return whole.mapInArrow(run, pairs.schema.add("shared", "long"))


def root_links(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between groups, a and b being their roots."""
    postings = (
        sets.select("id", "n", F.posexplode("prefix").alias("at", "token"), "places")
        .select("id", "n", "token", (F.col("n") - F.col("places")[F.col("at")]).alias("rest"))
        .join(roots, "id")
    )
    # a block of a list: the sets of one group, by the ranges that decide whether it can match
    blocks = postings.groupBy("token", "root").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.max("beyond").alias("beyond")
    )
    active = blocks.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") > 1).select("token")
    blocks = blocks.join(active, "token")
    side = lambda df, name: df.select("token", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "token"])
    met = side(blocks, "a").join(side(blocks, "b"), "token").filter(F.col("root_a") < F.col("root_b"))
    sizes_meet = 100 * F.least("most_a", "most_b") >= percent * F.greatest("least_a", "least_b")
    rest_meets = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("least_a") + F.col("least_b"))
    met = checkpointed(met.filter(sizes_meet & rest_meets))
    groups = met.groupBy(F.col("root_a").alias("a"), F.col("root_b").alias("b")).agg(
        F.max("beyond_a").alias("beyond_a"), F.max("beyond_b").alias("beyond_b"), (F.min("least_a") + F.min("least_b")).alias("least")
    )
    sized = lambda name: sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"))
    answered = checkpointed(compared(groups.join(sized("a"), "a").join(sized("b"), "b"), sets))
    yes = _linked(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)
    # the roots' answer bounds that of all sets behind them; it is final where there are only roots
    # (another set has shingles beyond its root, or fewer than it)
    reach = F.col("shared") + F.col("beyond_a") + F.col("beyond_b")
    others = (F.col("beyond_a") + F.col("beyond_b") > 0) | (F.col("least") < F.col("n_a") + F.col("n_b"))
    unsure = answered.filter(~yes & others & ((100 + percent) * reach >= percent * F.col("least")))
    open_pairs = unsure.select(F.col("a").alias("root_a"), F.col("b").alias("root_b"), F.col("shared").alias("root_shared"))
    sets_a, sets_b = side(postings, "a"), side(postings, "b")
    single = (
        met.select("token", "root_a", "root_b")
        .join(open_pairs, ["root_a", "root_b"])
        .join(sets_a, ["token", "root_a"])
        .join(sets_b, ["token", "root_b"])
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .filter((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b")))
        .filter((100 + percent) * (F.col("root_shared") + F.col("beyond_a") + F.col("beyond_b")) >= percent * (F.col("n_a") + F.col("n_b")))
        .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b", "root_a", "root_b")
        .distinct()
    )
    found = compared(single, sets).filter(_linked(F.col("shared"), F.col("n_a"), F.col("n_b"), percent))
    return answered.filter(yes).select("a", "b").union(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc, tag, n_shingles, component_doc, component_tag) of every row of ``docs``
    (``tables.keyed_texts``), repeated rows repeated.

    Words are runs of bytes other than the six ASCII white spaces, A-Z folded; a document's
    set are its distinct ``size``-word shingles, its whole sequence if it has fewer words,
    and empty without words. Documents are linked if their sets' intersection has at least
    ``percent`` per cent of their union; empty sets are linked with nothing, so they are
    components of their own. A component is named by its smallest (doc, tag); the key of a
    NULL id comes first. Equal sets are one set, so copies are never compared.
    """
    members = stored(set_members(docs, size))
    sets = stored(shared_shingles(docs, size, percent))
    roots = checkpointed(grouped_sets(sets, percent))
    links = checkpointed(root_links(sets, roots, percent))
    group = F.col("root")
    if not links.isEmpty():
        merged = connected(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.join(merged, "root", "left")
        group = F.coalesce("top", "root")
    named = roots.select("id", group.alias("group"))
    filled = members.filter(F.col("n") > 0)
    first = filled.groupBy("id").agg(F.min(F.struct("doc", "tag")).alias("first")).join(named, "id", "left")
    first = first.select("id", F.coalesce("group", "id").alias("group"), "first")
    first = checkpointed(first)
    least = first.groupBy("group").agg(F.min("first").alias("least"))
    of_set = join_hot(first, least, ["group"]).select("id", "least")
    together = join_hot(members, of_set, ["id"], "left")
    alone = F.col("n") == 0
    return together.select(
        "doc",
        "tag",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc")).otherwise(F.col("least.doc")).alias("component_doc"),
        F.when(alone, F.col("tag")).otherwise(F.col("least.tag")).alias("component_tag"),
    )
