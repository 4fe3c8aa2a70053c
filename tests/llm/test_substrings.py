"""Repeated word windows and byte strings against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from gamelog.llm import block_anchors, queries, suffix_doubling
from gamelog.llm.tables import NULL_ID, keyed_texts


def sha(x):
    return hashlib.sha256(x).hexdigest()


def result(spark, folder, name):
    return [r.asDict() for r in queries.registered()[name](spark, folder).collect()]


def removed(units, window):
    """Of each (doc, tag): which units lie in a window that also starts earlier."""
    seen, out = set(), {}
    for key in sorted(units):
        row = units[key]
        gone = [False] * len(row)
        for i in range(len(row) - window + 1):
            w = tuple(row[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[key] = gone
    return out


def by_key(rows):
    tag = lambda raw: xxhash.xxh64_intdigest(raw, 42) - (xxhash.xxh64_intdigest(raw, 42) >> 63 << 64)
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    return {(NULL_ID if i is None else i, tag(raw)): raw for i, raw in texts}


def want(rows, split, join, window):
    units = {k: split(t) for k, t in by_key(rows).items()}
    gone = removed(units, window)
    for r in rows:
        k = next(iter(by_key([r])))
        kept = join([u for u, g in zip(units[k], gone[k]) if not g])
        runs = len(re.findall("1+", "".join("01"[g] for g in gone[k])))
        yield r[0], len(gone[k]), sum(gone[k]), runs, sha(kept)


def test_word_windows(spark, folder, rows):
    expected = Counter((d, n, r, k) for d, n, r, _, k in want(rows, bytes.split, b" ".join, 20))
    got = result(spark, folder, "op9_block_anchors")
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0


def test_byte_strings(spark, folder, rows):
    expected = Counter(want(rows, list, bytes, 100))
    got = result(spark, folder, "op5_suffix_doubling")
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0


SMALL = [(1, "a b c d e f g h"), (2, "x a b c d e y"), (3, "c d e f g h c d e f"), (4, "a a a a a a a a a"), (4, "a a a a a"), (5, "aaaaaaaaaaaaaaaaaaaaaaa"), (6, "éaéaéaéaéaéaéa"), (7, None)]


@pytest.mark.parametrize("window", [2, 4, 6])
def test_small_word_windows(spark, window):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string")
    got = block_anchors.dedup_windows(keyed_texts(docs), window).collect()
    expected = Counter((d, n, r, k) for d, n, r, _, k in want(SMALL, bytes.split, b" ".join, window))
    assert Counter((r.doc, r.n_words, r.n_removed, sha(r.kept.encode())) for r in got) == expected


@pytest.mark.parametrize("length", [3, 7, 10])
def test_small_byte_strings(spark, length):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string")
    got = suffix_doubling.dedup_bytes(keyed_texts(docs), length).collect()
    expected = Counter(want(SMALL, list, bytes, length))
    assert Counter((r.doc, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got) == expected
    for r in got:
        assert sum(g.end - g.start for g in r.gone) == r.n_removed


def test_empty_tables(spark, empty_folder):
    for name in ("op5_suffix_doubling", "op9_block_anchors"):
        assert result(spark, empty_folder, name) == []
