import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "a", "\n\t  \x0b\x0c\r", "word", "Word word", "one two three", "x" * 700, "aaaa " * 400,
    "é" * 333, "日本語のテキスト、 と空白　です", "\x1c\x1d\x85\xa0 sep arators", "😀👩‍👧 <|endoftext|> don't I'LL",
    "Released under the MIT License. CC-BY NC, cc by-nc 4.0 apache LICENSE version 2 Apache License, Version 2.0",
    "under the mit license under the mit license",
]


def words(rng, n):
    parts = ["the", "of", "ing", "tion", "der", "ñue", "été", "ß", "wh", "ere"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, odd and long texts, NULLs, repeats."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(5, 300)) for _ in range(25)]
    shared = words(rng, 60)
    texts = base + ODD + base[:5] + [base[3]] * 4
    for t in base[5:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for t in base[12:18]:
        texts.append(t[: len(t) // 2] + "\n" + shared + " " + t[len(t) // 2 :])
    long = words(rng, 9000)
    texts += [shared, shared + " " + shared, long, long[:40000] + " tail", ("line of junk here\n" * 300)]
    ids = list(range(3, 3 + 2 * len(texts), 2))
    rng.shuffle(ids)
    out = [(i, t, rng.choice(["en", None]), rng.choice(["src0", "src0", "src1", None]), len(t or "")) for i, t in zip(ids, texts)]
    return out + [out[0], (None, base[1], "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(c) for c in ("doc", "tag", "bucket", "score", "ids", "n_words", "label", "component_id")}
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "n_chars").withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """The same documents as a folder of tables, for the registered queries."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty_folder(no_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    no_docs.write.parquet(f"{path}/documents.parquet")
    return path
