"""Encoding, fingerprints and licences against brute force."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

from gamelog.llm import byte_bpe, license_scan, piecewise_hash, queries


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def result(spark, folder, name):
    return [r.asDict() for r in queries.registered()[name](spark, folder).collect()]


def test_encoding_matches_the_library(spark, folder, rows):
    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(queries.RANKS))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, folder, "op8_byte_bpe"))
    assert got == want


def test_matrix_and_heap_merge_alike():
    encoder = byte_bpe.encoder_for(byte_bpe.load_ranks(queries.RANKS), public_tokenizers.PATTERN)
    pieces = [b"thtionerwh" * 9, b"a" * 300, "ñétionß".encode() * 12, b"!?" * 90]
    for piece, ids in zip(pieces, encoder.merge_matrix(pieces)):
        assert ids.tolist() == encoder.merge_long(piece).tolist()


def brute_edits(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for k, (doc_id, text) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(text)
        yield doc_id, n, sha(text[: n - n // 2] + after[: n // 2])


def test_edited_texts(spark, folder, rows):
    got = result(spark, folder, "op10_piecewise_hash")
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(brute_edits(rows))
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    by_text = {}
    for doc_id, text in texts.items():
        assert len(prints[doc_id]) == 1
        by_text.setdefault(text, set()).update(prints[doc_id])
    assert all(len(p) == 1 for p in by_text.values())
    long = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.3
    assert sum(r["near_next"] < r["near_edited"] for r in long) > 0.8 * len(long)


TOP = 2**64


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % TOP
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % TOP
    return x ^ (x >> 31)


BYTE_CODES = [_mixed((b + 1) * 0x9E3779B97F4A7C15 % TOP) for b in range(256)]


def brute_print(raw):
    """Piecewise hash of bytes, by whole numbers."""
    cuts = []
    for i in range(len(raw) - 6):
        h = 0
        for b in raw[i : i + 7]:
            h = (h * 0xD6E8FEB86659FD93 + BYTE_CODES[b]) % TOP
        third, left = divmod(_mixed(h), 3)
        if left == 2:
            level = 0
            while third >> level & 1:
                level += 1
            cuts.append((i + 7, level))
    k = 0
    while sum(level >= k for _, level in cuts) >= 64:
        k += 1

    def signature(least):
        ends = [at for at, level in cuts if level >= least]
        ends += [len(raw)] if len(raw) > (ends[-1] if ends else 0) else []
        out, begin = "", 0
        for end in ends:
            total = sum(BYTE_CODES[b] * pow(0x9E3779B97F4A7C15, n, TOP) for n, b in enumerate(raw[begin:end])) % TOP
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[_mixed(total) >> 58]
            begin = end
        return out

    return f"{3 << k}:{signature(k)}:{signature(k + 1)}"


def brute_likeness(x, y):
    if x == y:
        return 1.0
    sides = []
    for p in (x, y):
        size, one, two = p.split(":")
        sides.append({int(size): one, 2 * int(size): two})
    best = 0.0
    for size in sides[0].keys() & sides[1].keys():
        a, b = sides[0][size], sides[1][size]
        run = min(len(a), len(b), 4)
        if not run or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
            continue
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        best = max(best, 1 - row[-1] / max(len(a), len(b)))
    return best


def test_fingerprints_and_likeness_match_brute_force(spark, folder, rows):
    prints = {}
    of = lambda text: prints[text] if text in prints else prints.setdefault(text, brute_print(text.encode()))
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for k, (doc_id, text) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(text)
        own, edited, follows = of(text), of(text[: n - n // 2] + after[: n // 2]), of(after)
        want[doc_id, own, edited, round(brute_likeness(own, edited), 9), round(brute_likeness(own, follows), 9)] += 1
    got = result(spark, folder, "op10_piecewise_hash")
    found = Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert found == want


def test_likeness_is_edit_distance_over_length():
    assert piecewise_hash.likeness(["3:ABCDEFGH:ABCD"], ["3:ABCDEFGH:ABCD"]).tolist() == [1.0]
    assert piecewise_hash.likeness(["3:ABCDEFGH:"], ["3:ABCDxFGHi:"]).tolist() == [1 - 2 / 9]
    assert piecewise_hash.likeness(["6:ABCDEFGH:"], ["3:zz:ABCDEFG"]).tolist() == [1 - 1 / 8]
    assert piecewise_hash.likeness(["3:ABCDEFGH:A"], ["12:ABCDEFGH:A"]).tolist() == [0.0]
    assert piecewise_hash.likeness(["3:ABCDEFGH:"], ["3:HGFEDCBA:"]).tolist() == [0.0]


def test_signatures_cover_whole_texts(spark, docs):
    prints = [r.fingerprint.split(":") for r in piecewise_hash.fingerprint_documents(docs).collect()]
    assert all(len(one) <= 64 and len(two) <= len(one) for _, one, two in prints)


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places(spark, folder, rows):
    got = result(spark, folder, "op7_license_scan")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *brute_places(r[1])) for r in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert (r["score"] > 0) == bool(r["labels"]) and r["score"] <= 1


def test_notice_with_inserted_and_missing_words(spark):
    from gamelog.llm.tables import keyed_texts

    notice = next(t for t, label in license_scan.NOTICES.items() if label == "bsd").split()
    edited = " ".join(["intro"] * 5 + notice[:8] + ["really"] + notice[8:13] + notice[14:] + ["end"])
    df = spark.createDataFrame([(1, edited), (2, "redistribution and use of something else")], "doc_id long, text string")
    got = {r.doc: r for r in license_scan.license_scan(keyed_texts(df)).collect()}
    assert got[1].labels == "bsd" and got[1].n_base == 0 and got[1].spans[0].first_word == 5
    assert 0.6 <= got[1].score < 1 and got[2].labels == "" and got[2].spans is None


def test_empty_tables(spark, empty_folder):
    for name in ("op7_license_scan", "op8_byte_bpe", "op10_piecewise_hash"):
        assert result(spark, empty_folder, name) == []
