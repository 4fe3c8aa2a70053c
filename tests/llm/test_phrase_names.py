"""Collocations: only phrases that reach the bar, or hold one that does, are named and moved."""

import random

from gamelog.llm import collocations
from gamelog.llm.tables import stored


def test_pairs_below_the_bar_are_not_named(spark, monkeypatch):
    """Common words in any order make many frequent pairs, none of which scores high."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    rows = [(" ".join(rng.choices(common, k=200)) + ". kept together. held in place", "en") for _ in range(60)]
    named = []

    def seen(docs, tables, least, bar, plain=collocations.phrase_names):
        names = stored(plain(docs, tables, least, bar))
        named.append((bar, {r.phrase for r in names.filter("k > 0").collect()}))
        return names

    monkeypatch.setattr(collocations, "phrase_names", seen)
    monkeypatch.setattr(collocations, "BARS", (500_000, 0))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    best = collocations.collocations(docs, top=2).collect()
    assert [r.phrase for r in best] == ["held in place", "kept together"]
    (bar, phrases), *later = named
    assert bar == 500_000 and not later
    # the held pairs are named, as they reach the bar; of 144 frequent common pairs none is
    assert phrases == {"kept together", "held in", "in place", "held in place"}
