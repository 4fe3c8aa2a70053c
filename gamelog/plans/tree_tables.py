"""Boosted trees as tables of leaf masks, and what they give when one input is shuffled.

A row is a byte (or two) per used input: how many thresholds of that input it exceeds. The
leaves of a tree are bits from left to right. For every input and code a table has the leaves
that its splits leave open; the lowest bit open in all tables of the tree is the leaf. When one
input is shuffled, only its own table is looked up again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gamelog.session import find_package

WORD = 32
#: Positions that travel together, and rows that are worked on at a time.
BLOCK_ROWS = 4096
CHUNK_ROWS = 1024
#: Stands for the rows as they are, among the numbers of shuffles and of inputs.
OWN = -1


@dataclass(frozen=True)
class Tree:
    """``masks[k]``: (word, code) of the input ``inputs[k]``; ``values``: (word, leaf), weighed."""

    inputs: list[int]
    masks: list[np.ndarray]
    values: np.ndarray


@dataclass(frozen=True)
class TreeTables:
    slots: list[int]
    thresholds: list[np.ndarray]
    trees: list[Tree]

    @property
    def code_type(self) -> np.dtype:
        most = max((len(t) for t in self.thresholds), default=0)
        return np.min_scalar_type(most)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """(row, input) codes of (row, slot) values. What is no number exceeds all thresholds."""
        found = [np.searchsorted(t, values[:, s], side="left") for s, t in zip(self.slots, self.thresholds)]
        return np.stack(found, axis=1).astype(self.code_type)


def _parsed(lines: Iterator[str]) -> tuple:
    """The next node: (value,) of a leaf, (slot, threshold, left, right) of a split."""
    line = next(lines).strip()
    if line.startswith("Predict: "):
        return (float(line.removeprefix("Predict: ")),)
    split = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    if not split:
        raise ValueError(f"no split by a threshold: {line}")
    left = _parsed(lines)
    next(lines)  # Else
    return int(split[1]), float(split[2]), left, _parsed(lines)


def nodes_of(fitted: GBTRegressionModel) -> list[tuple]:
    """The root of every tree."""
    parts, lines = [], fitted.toDebugString.splitlines()[1:]
    for line in lines:
        if line.strip().startswith("Tree "):
            parts.append([])
        elif line.strip():
            parts[-1].append(line)
    return [_parsed(iter(part)) for part in parts]


def _splits(node: tuple, first: int = 0) -> tuple[list[float], list[tuple[int, float, int, int]]]:
    """Leaf values from left to right, and (slot, threshold, first, end) of the left leaves of every split."""
    if len(node) == 1:
        return [node[0]], []
    slot, threshold, left, right = node
    values, splits = _splits(left, first)
    more, others = _splits(right, first + len(values))
    return values + more, [(slot, threshold, first, first + len(values)), *splits, *others]


def tree_tables(fitted: GBTRegressionModel) -> TreeTables:
    listed = [_splits(root) for root in nodes_of(fitted)]
    slots = sorted({s for _, splits in listed for s, *_ in splits})
    thresholds = [np.unique([t for _, splits in listed for s, t, *_ in splits if s == slot]) for slot in slots]
    trees = []
    for (leaves, splits), weight in zip(listed, fitted.treeWeights):
        words = -(-len(leaves) // WORD)
        values = np.zeros(words * WORD)
        values[: len(leaves)] = np.array(leaves) * weight
        inputs = sorted({slots.index(s) for s, *_ in splits})
        masks = []
        for k in inputs:
            open_leaves = np.ones((len(thresholds[k]) + 1, words * WORD), bool)
            for slot, threshold, first, end in splits:
                if slot == slots[k]:
                    open_leaves[np.searchsorted(thresholds[k], threshold) + 1 :, first:end] = False
            packed = np.packbits(open_leaves, axis=1, bitorder="little")
            masks.append(np.ascontiguousarray(packed.view("<u4").T))
        trees.append(Tree(inputs, masks, values.reshape(words, WORD)))
    return TreeTables(slots, thresholds, trees)


def _leaf_values(words: Sequence[np.ndarray], values: np.ndarray) -> np.ndarray:
    """The value of the lowest open leaf. The exponent of a power of two is the place of its bit."""
    out = None
    for word, of in zip(reversed(words), values[::-1]):
        lowest = (word & np.negative(word)).astype(np.float32).view(np.int32)
        found = np.take(of, (lowest >> 23) - 127, mode="clip")
        out = found if out is None else np.where(word != 0, found, out)
    return out


def squared_errors(tables: TreeTables, y: np.ndarray, known: np.ndarray, codes: np.ndarray, donors: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed squared error as is, and (input, shuffle) with one input taken from the donors.

    ``codes`` is (input, row), ``donors`` (input, shuffle, row). Rows without a known ``y`` have no error.
    """
    own, codes, given = np.zeros(donors.shape[0:1] + y.shape), codes.astype(np.intp), donors.astype(np.intp)
    whole, new = np.zeros(len(y)), np.zeros(donors.shape)
    for tree in tables.trees:
        picked = [[m.take(codes[k], mode="clip") for m in mask] for k, mask in zip(tree.inputs, tree.masks)]
        full = np.full((len(tree.values), len(y)), 2**WORD - 1, np.uint32)
        # open to all inputs before this one, and to all inputs from the last one on
        before, after = [full], [full]
        for words in picked:
            before.append(before[-1] & words)
        for words in reversed(picked):
            after.append(after[-1] & words)
        out = _leaf_values(before[-1], tree.values)
        whole += out
        for at, (k, mask) in enumerate(zip(tree.inputs, tree.masks)):
            others = before[at] & after[len(picked) - 1 - at]
            own[k] += out
            new[k] += _leaf_values([m.take(given[k], mode="clip") & o for m, o in zip(mask, others)], tree.values)
    left = y - whole
    moved = ((left + own)[:, None, :] - new)[:, :, known]
    return float(np.sum(left[known] ** 2)), np.einsum("ksr,ksr->ks", moved, moved)


def coded(rows: DataFrame, tables: TreeTables, values: str, name: str) -> DataFrame:
    """The array column of all slots replaced by the packed codes."""
    find_package(rows.sparkSession)
    kept = [c for c in rows.columns if c != values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(values)
            if len(of):
                table = of.flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
                packed = [c.tobytes() for c in tables.codes(table)]
                yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(packed, pa.binary())], names=[*kept, name])

    schema = StructType([*[f for f in rows.schema if f.name in kept], StructField(name, BinaryType())])
    return rows.select(*kept, values).mapInArrow(run, schema)


def errors_by_tree(tables: TreeTables, rows: DataFrame, n: int, shifts: Sequence[int]) -> DataFrame:
    """(_repeat, _slot, _squared): the summed squared error of each slot after each shuffle, and
    without one as repeat and slot ``OWN``.

    ``rows`` are (_at, _y, _codes) with positions 0 to n - 1. In shuffle r a row takes the value
    of the row ``shifts[r]`` further on, wrapping around. Rows go to blocks of positions, and a
    block is sent as a few slices to those that it gives to; no pair of rows is kept anywhere.
    """
    find_package(rows.sparkSession)
    kind, inputs = tables.code_type, len(tables.slots)
    pieces = "_to long, _repeat int, _offset int, _codes binary, _y binary, _known binary"
    names = [field.split(" ")[0] for field in pieces.split(", ")]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at").combine_chunks()
        start, size = table["_at"][0].as_py(), len(table)
        codes = np.frombuffer(b"".join(table["_codes"].to_pylist()), kind).reshape(size, inputs).T
        y = table["_y"].combine_chunks()
        known = y.is_valid().to_numpy(zero_copy_only=False)
        out = [(start // BLOCK_ROWS, OWN, 0, codes.tobytes(), y.fill_null(0.0).to_numpy(zero_copy_only=False).tobytes(), known.tobytes())]
        for repeat, shift in enumerate(shifts):
            at = 0
            while at < size:
                to = (start + at - shift) % n
                end = min(size, at + min(n - to, BLOCK_ROWS - to % BLOCK_ROWS))
                out.append((to // BLOCK_ROWS, repeat, to % BLOCK_ROWS, codes[:, at:end].tobytes(), None, None))
                at = end
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def sums(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        own = next(p for p in parts if p["_repeat"] == OWN)
        y, known = np.frombuffer(own["_y"]), np.frombuffer(own["_known"], bool)
        codes = np.frombuffer(own["_codes"], kind).reshape(inputs, -1)
        donors = np.zeros((inputs, len(shifts), len(y)), kind)
        for p in parts:
            if p["_repeat"] != OWN:
                piece = np.frombuffer(p["_codes"], kind).reshape(inputs, -1)
                donors[:, p["_repeat"], p["_offset"] : p["_offset"] + piece.shape[1]] = piece
        plain, moved = 0.0, np.zeros((inputs, len(shifts)))
        for low in range(0, len(y), CHUNK_ROWS):
            part = slice(low, low + CHUNK_ROWS)
            a, b = squared_errors(tables, y[part], known[part], codes[:, part], donors[:, :, part])
            plain, moved = plain + a, moved + b
        found = [(OWN, OWN, plain), *[(r, s, float(v)) for s, of in zip(tables.slots, moved) for r, v in enumerate(of)]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.float64()))], names=["_repeat", "_slot", "_squared"])

    sent = rows.groupBy(F.floor(F.col("_at") / F.lit(BLOCK_ROWS)).alias("_block")).applyInArrow(pack, pieces)
    found = sent.groupBy("_to").applyInArrow(sums, "_repeat int, _slot int, _squared double")
    return found.groupBy("_repeat", "_slot").agg(F.sum("_squared").alias("_squared"))
