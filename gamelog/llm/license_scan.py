"""License phrases and notices in texts, by voting of word k-grams along diagonals.

Every rolling k-gram of a text that some template holds is joined to the template's
positions. A place of the template in the text puts its votes on one diagonal (text
position less template position); an insertion or deletion moves the rest to a neighbouring
diagonal, which is merged. Spans are then verified by the share of k-grams they match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.textbytes import LOWER, U64, ranges, room, row_slices, span_codes, utf8, windows, word_spans

K = 3
#: A span of a notice counts from this share of the template's k-grams.
LEAST_SHARE = 0.6
#: Diagonals this near (inserted or missing words) belong to one span.
NEAR_DIAGONALS = 4

# The phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wordings of public licence notices, by label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "mozilla public license version 2 0": "mpl-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by sa": "cc-by-sa",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}

#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def _grams(data: np.ndarray, offsets: np.ndarray, k: int):
    """Folded bytes, word spans, and the start word, row and hash of every k-gram."""
    folded = LOWER[data]
    start, end, first = word_spans(folded, offsets, WORD_BYTE)
    at, count = room(first, k)
    codes = windows(span_codes(folded, start, end), k)
    row = np.repeat(np.arange(len(count)), count)
    return folded, start, end, first, at, row, codes[at] if len(at) else np.empty(0, U64)


def scan_hits(docs: DataFrame, wanted: np.ndarray, k: int) -> DataFrame:
    """(doc, tag, n_words, hits): each row's k-grams whose hash is wanted, with their words."""
    wanted = np.sort(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for low, high in row_slices(offsets):
                base = offsets[low]
                folded, start, end, first, at, row, codes = _grams(data[base : offsets[high]], offsets[low : high + 1] - base, k)
                near = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                hit = np.flatnonzero(wanted[near] == codes)
                pick = ranges(at[hit], np.full(len(hit), k))
                words = [folded[a:b].tobytes().decode() for a, b in zip(start[pick], end[pick])]
                grams = [" ".join(words[i : i + k]) for i in range(0, len(words), k)]
                found = pa.StructArray.from_arrays(
                    [pa.array(at[hit] - first[row[hit]], pa.int64()), pa.array(grams, pa.string())], ["place", "gram"]
                )
                ends = np.searchsorted(row[hit], np.arange(high - low + 1))
                yield pa.record_batch(
                    [
                        *(c.slice(low, high - low) for c in batch.columns[:2]),
                        pa.array(np.diff(first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
                    ],
                    names=["doc", "tag", "n_words", "hits"],
                )

    return docs.mapInArrow(run, "doc long, tag long, n_words long, hits array<struct<place: long, gram: string>>")


def template_positions(templates: dict[str, str], k: int) -> list[tuple[str, str, int, int]]:
    """(gram, template, position, k-grams of the template); templates are lower-case words."""
    rows = []
    for text in templates:
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        size = len(words) - k + 1
        rows += [(" ".join(words[i : i + k]), text, i, size) for i in range(size)]
    return rows


def license_spans(hits: DataFrame, templates: dict[str, str], k: int, least: float) -> DataFrame:
    """(doc, tag, template, first_word, last_start, share): verified spans of every document.

    ``share`` is the part of the template's k-grams found in order on the merged diagonals.
    The template table is as large as the list of templates and is broadcast.
    """
    spark = hits.sparkSession
    places = spark.createDataFrame(template_positions(templates, k), "gram string, template string, at long, size long")
    one = hits.filter(F.size("hits") > 0).dropDuplicates(["doc", "tag"])
    votes = (
        one.select("doc", "tag", F.explode("hits").alias("hit"))
        .select("doc", "tag", "hit.place", "hit.gram")
        .join(F.broadcast(places), "gram")
        .withColumn("diagonal", F.col("place") - F.col("at"))
    )
    # votes of one diagonal, then neighbouring diagonals, as long as their places go on
    lines = votes.groupBy("doc", "tag", "template", "size", "diagonal").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("ats")
    )
    by = Window.partitionBy("doc", "tag", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR_DIAGONALS, F.lit(True))
    spans = (
        lines.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(by))
        .groupBy("doc", "tag", "template", "size", "span")
        .agg(
            F.min("low").alias("first_word"),
            F.max("high").alias("last_start"),
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("matched"),
        )
    )
    share = F.col("matched") / F.col("size")
    return spans.select("doc", "tag", "template", "first_word", "last_start", share.alias("share")).filter(share >= least)


def license_scan(
    docs: DataFrame,
    base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    k: int = K,
    least: float = LEAST_SHARE,
) -> DataFrame:
    """Licences of every row of ``docs`` (from ``tables.keyed_texts``).

    Returns (doc, tag, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans). A base phrase counts where all of its k-grams stand on one diagonal, that is,
    where its words stand consecutively. ``labels`` adds those of notices found in part, to
    the share ``least``. ``score`` is the best share (1 for a base phrase). Texts without
    words have 0 places, NULL first and last words and empty labels. Equal rows (id and
    text) give equal results, once per row.
    """
    base, notices = base or BASE_PHRASES, notices or NOTICES
    label = base | notices
    wanted = _gram_codes([gram for gram, *_ in template_positions(label, k)], k)
    hits = scan_hits(docs, wanted, k)
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame(list(label.items()), "template string, label string"))
    exact = base_places(hits, base, k)
    part = license_spans(hits, notices, k, least).select("doc", "tag", "template", "first_word", "last_start", "share")
    found = (
        exact.withColumn("base", F.lit(True))
        .unionByName(part.withColumn("base", F.lit(False)).withColumn("places", F.lit(0).cast("long")))
        .join(names, "template")
        .groupBy("doc", "tag")
        .agg(
            F.sum("places").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("last_start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.struct("first_word", "last_start", "label", "share"))).alias("spans"),
        )
    )
    return hits.drop("hits").join(found, ["doc", "tag"], "left").select(
        "doc",
        "tag",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )


def base_places(hits: DataFrame, base: dict[str, str], k: int) -> DataFrame:
    """(doc, tag, template, places, first_word, last_start, share = 1): whole phrases only."""
    spark = hits.sparkSession
    places = spark.createDataFrame(template_positions(base, k), "gram string, template string, at long, size long")
    one = hits.filter(F.size("hits") > 0).dropDuplicates(["doc", "tag"])
    return (
        one.select("doc", "tag", F.explode("hits").alias("hit"))
        .select("doc", "tag", "hit.place", "hit.gram")
        .join(F.broadcast(places), "gram")
        .groupBy("doc", "tag", "template", "size", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.count_distinct("at").alias("matched"))
        .filter(F.col("matched") == F.col("size"))
        .groupBy("doc", "tag", "template")
        .agg(
            F.count(F.lit(1)).alias("places"),
            F.min("diagonal").alias("first_word"),
            F.max("diagonal").alias("last_start"),
            F.lit(1.0).alias("share"),
        )
    )


def _gram_codes(grams: list[str], k: int) -> np.ndarray:
    data = "\n".join(grams).encode()
    offsets = np.cumsum([0, *[len(g.encode()) + 1 for g in grams]])
    offsets[-1] -= 1
    *_, codes = _grams(np.frombuffer(data, np.uint8), offsets, k)
    return np.unique(codes)
