"""b-bit MinHash, phrase collocations and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gamelog.llm import bbit_minhash, centroid_clustering, collocations, queries
from gamelog.llm.tables import NULL_ID, join_hot, keyed_texts
from gamelog.llm.textbytes import mix

from test_jaccard import brute as components_of
from test_substrings import by_key

DOCS = "doc_id long, text string, lang string"


# --- b-bit MinHash -------------------------------------------------------------


def check_components(spark, rows, size, percent):
    want = components_of(rows, size, percent)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    got = bbit_minhash.near_duplicates(keyed_texts(df), size, percent).collect()
    expected = Counter((k, *want[k]) for r in rows for k in by_key([r]))
    assert Counter(((r.doc, r.tag), r.n_shingles, (r.component_doc, r.component_tag)) for r in got) == expected
    return want


def test_near_duplicates_of_odd_rows(spark, folder, rows):
    want = components_of(rows, 4, 80)
    show = lambda doc: None if doc == NULL_ID else doc
    expected = Counter((r[0], want[k][0], show(want[k][1][0]), k[0] == want[k][1][0]) for r in rows for k in by_key([r]))
    got = queries.registered()["op11_bbit_minhash"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_edited_copies(spark, seed):
    """Copies edited more and more, chains, and families that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.5:
            base[10:10] = passage
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy))
    want = check_components(spark, [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))], 4, 80)
    assert 8 < len({c for _, c in want.values()}) < len(texts)


def test_a_band_of_many_components(spark, monkeypatch):
    """Pairs that link only with each other inside one large family, in small blocks."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 7)
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(200)]
    for _ in range(40):
        one = list(base)
        for at in rng.sample(range(200), 9):
            one[at] = f"x{rng.random()}"
        two = list(one)
        two[rng.randrange(200)] = f"y{rng.random()}"
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    want = check_components(spark, rows, 4, 80)
    assert 20 <= len({c for _, c in want.values()}) <= 40


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(3)
    for n in (20, 400):
        found = []
        for _ in range(60):
            pool = mix(rng.integers(1, 2**62, 2 * n).astype(np.uint64))
            both = round(1.6 * n / 1.8)
            sides = [np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))]
            least = [bbit_minhash.minima(np.zeros(n, np.int64), s, 1) for s in sides]
            assert (bbit_minhash.band_keys(least[0]) == bbit_minhash.band_keys(least[1])).any()
            found.append(bbit_minhash.similarity(*(bbit_minhash.packed_bits(m) for m in least))[0])
        truth = both / (2 * n - both)
        assert np.mean(found) == pytest.approx(truth, abs=0.015) and min(found) > bbit_minhash.least_estimate(80)
    assert bbit_minhash.packed_bits(least[0]).shape == (1, bbit_minhash.HASHES * bbit_minhash.BITS // 8)


def test_no_documents(spark, empty_folder):
    for name in ("op11_bbit_minhash", "op12_collocations"):
        assert queries.registered()[name](spark, empty_folder).collect() == []


def test_frequent_keys_are_spread(spark, monkeypatch):
    from gamelog.llm import tables

    monkeypatch.setattr(tables, "FEW_ROWS", 30)
    left = spark.createDataFrame([(k % 5 if k > 300 else 7, k) for k in range(400)] + [(9, 1000)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(8)], "k long, w long")
    for how in ("inner", "left"):
        got = Counter(map(tuple, join_hot(left, right, ["k"], how).select("k", "v", "w").collect()))
        assert got == Counter(map(tuple, left.join(right, ["k"], how).select("k", "v", "w").collect()))


# --- phrases -------------------------------------------------------------------


def brute_phrases(rows, top, least):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = []
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least:
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        held = any(
            100 * n >= 80 * a
            for (other, q), n in counts.items()
            if other == lang and n >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        )
        if not held:
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out.sort()
    rank, found = Counter(), set()
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            found.add((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return found


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    fixed = [rng.choices(words, k=rng.randint(2, 6)) + [f"q{i}"] * rng.randint(0, 2) for i in range(25)]
    rows = []
    for i in range(420):
        text = []
        for _ in range(rng.randint(1, 12)):
            text += rng.choice(fixed[: rng.randint(1, 25)]) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 4))
            text.append(rng.choice([",", ".", "\t", "  ", "\n", " ; "]))
        glue = " ".join(w.upper() if rng.random() < 0.1 else w for w in text)
        rows.append((i, glue, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [rows[0], (None, None, "fr"), (None, "", None), (7, "einÄ einä \x85 \xa0x", "de"), (8, "aaa " * 900, "en")]


@pytest.mark.parametrize("bars", [(900_000, 200_000, 0), (0,)])
def test_phrases(spark, phrases, monkeypatch, bars):
    """Bars that settle some languages, or none, give the same rows."""
    monkeypatch.setattr(collocations, "BARS", bars)
    df = spark.createDataFrame(phrases, DOCS).selectExpr("*", "1 as n", "'x' as phrase", "0 as key").repartition(3)
    got = {tuple(r) for r in collocations.collocations(df, top=12, least=5).collect()}
    assert got == brute_phrases(phrases, 12, 5)
    assert {r[0] for r in got} >= {"en", "und"}


def test_full_tables_of_bounds_only_loosen(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    monkeypatch.setattr(collocations, "BARS", (300_000, 0))
    df = spark.createDataFrame(phrases, DOCS).repartition(3)
    assert {tuple(r) for r in collocations.collocations(df, top=20, least=4).collect()} == brute_phrases(phrases, 20, 4)


# --- clusters ------------------------------------------------------------------


def brute_clusters(rows, count=40, rounds=5):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [math.floor(256 * v) if abs(v) < 2**53 else 256 * int(v) for v in x]))
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centers = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:count]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for k, members in groups.items():
            centers[k] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *assign(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, k, d in found:
        sums[k] += d
    cap = 2**63 - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, k, min(d, cap), min(sums[k], cap), min(sum(sums.values()), cap), sha[k]) for i, k, d in found)


def vectors(rng, n):
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(n)]


def clustered(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as distance").repartition(3)
    return Counter(tuple(r) for r in centroid_clustering.cluster_vectors(df).collect())


def test_clusters(spark):
    rng = random.Random(2)
    rows = vectors(rng, 300)
    rows += [rows[5], (rows[6][0], rows[7][1]), (None, rows[8][1]), (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65)]
    rows += [(904, [None] + [0.1] * 63), (905, [math.inf] + [0.1] * 63), (906, [math.nan] * 64), (907, [0.0] * 64), (908, [0.0] * 64)]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_few_and_equal_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(50)]
    assert clustered(spark, same) == brute_clusters(same)
    assert {r[1] for r in clustered(spark, same)} == {0}
    assert clustered(spark, same[:3]) == brute_clusters(same[:3])
    assert not clustered(spark, [(1, None)])


def test_huge_components_stay_exact(spark):
    rng = random.Random(4)
    rows = vectors(rng, 60) + [(1000 + i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([3, 6, 12, 30, 38]) for _ in range(64)]) for i in range(20)]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_progressive_search_sums_less():
    rng = np.random.default_rng(1)
    centers = rng.integers(-200, 200, (40, 64))
    rows = centers[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    cluster, distance, summed = centroid_clustering.nearest(centroid_clustering.transformed(rows), centroid_clustering.transformed(centers))
    whole = ((rows[:, None, :] - centers[None]) ** 2).sum(2)
    assert (cluster == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    assert summed < 0.3 * whole.size * 64


def test_transform_keeps_distances():
    rows = np.random.default_rng(2).integers(-500, 500, (2, 64))
    a, b = centroid_clustering.transformed(rows)
    assert ((a - b) ** 2).sum() == 64 * ((rows[0] - rows[1]) ** 2).sum()
