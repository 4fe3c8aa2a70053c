"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import pytest

from gamelog.llm import jaccard_join, queries
from gamelog.llm.components import connected
from gamelog.llm.tables import NULL_ID, keyed_texts

from test_substrings import by_key


def shingles(text, size):
    words = re.sub(b"[A-Z]", lambda m: m[0].lower(), text).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    """Of each key: set size and the smallest key of its component."""
    keys = sorted(texts := by_key(rows))
    sets = {k: shingles(texts[k], size) for k in keys}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def check(spark, rows, size, percent):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    want = brute(rows, size, percent)
    got = jaccard_join.jaccard_components(keyed_texts(df), size, percent).collect()
    expected = Counter((k, *want[k]) for r in rows for k in by_key([r]))
    assert Counter(((r.doc, r.tag), r.n_shingles, (r.component_doc, r.component_tag)) for r in got) == expected
    return want


def test_registered_query(spark, folder, rows):
    want = brute(rows, 4, 85)
    show = lambda doc: None if doc == NULL_ID else doc
    expected = Counter((r[0], want[k][0], show(want[k][1][0])) for r in rows for k in by_key([r]))
    got = queries.registered()["op2_jaccard_join"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_families_around_the_threshold(spark, seed):
    """Copies edited more and more, chains, and families that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(20, 150))]
        if rng.random() < 0.5:
            base[10:10] = passage
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    want = check(spark, rows, 4, 85)
    assert 8 < len({c for _, c in want.values()}) < len(texts)


def test_smaller_sets_link_where_their_leaders_do_not(spark):
    """x-A, y-B and x-y match, A-B do not. A and B end in widespread words, so they lead;
    x and y are subsets of them."""
    few, rows = [f"few{i}" for i in range(20)], []
    for family in range(12):
        core = [f"core{family}_{i}" for i in range(95)]
        own = [[f"own{family}_{s}_{i}" for i in range(5)] for s in "xy"]
        x, y = core + own[0], core + own[1]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((x, y, x + few[:10], y + few[10:]))]
    texts = [" ".join(few + [f"rest{k}_{i}" for i in range(40)]) for k in range(60)]
    rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    want = check(spark, rows, 1, 85)
    assert len({c for _, c in want.values()}) == 12 + 60


def test_default_threshold(spark, rows):
    check(spark, rows[:60], 5, 80)


def test_chain_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = dict(connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_empty_table(spark, empty_folder):
    assert queries.registered()["op2_jaccard_join"](spark, empty_folder).collect() == []
