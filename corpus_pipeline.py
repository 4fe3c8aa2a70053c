"""The training-data pipeline: stages over ``documents``, each reading what the last one wrote.

Toxic documents go, one document of each group of near duplicates stays, passages that
appeared before are cut out, sources are mixed to target weights, and the texts are encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.llm import byte_bpe, jaccard_join, source_mixing, suffix_doubling, toxicity
from gamelog.llm.queries import RANKS, TOXIC, sha256
from gamelog.llm.tables import keyed, keyed_texts, read, stored

# For every stage: a NULL text counts as an empty one, a NULL id is an id of its own that
# comes first, columns beyond ``COLUMNS`` are not read, and an empty table stays empty.

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold by a model of their labelled rows.

    A score equal to the threshold is toxic. Repeated rows share their score and stay or go
    together. Without labels of both kinds all rows have one score.
    """
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select(*COLUMNS), model)
    return scored.filter(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of near duplicates, and one of repeated rows.

    First is the smallest id, among equal ids the smallest hash of the text. A text without
    words is a component of its own.
    """
    found = jaccard_join.jaccard_components(keyed_texts(docs))
    first = (F.col("doc") == F.col("component_doc")) & (F.col("tag") == F.col("component_tag"))
    stay = found.filter(first).select("doc", "tag").distinct()
    return keyed(docs, *COLUMNS).join(stay, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters of 100-byte strings that appeared before.

    A character goes if all of its bytes do. Among equal ids the smaller hash of the text
    comes first; repeated rows are one document. ``n_chars`` is counted anew.
    """
    found = suffix_doubling.dedup_bytes(keyed_texts(docs), whole_characters=True)
    texts = found.select("doc", "tag", F.col("kept").cast("string").alias("text")).dropDuplicates(["doc", "tag"])
    others = keyed(docs, "doc_id", "lang", "source")
    return others.join(texts, ["doc", "tag"]).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source weighs the root of its size, in shuffled order.

    A NULL source is a source; rows with equal id and source have equal counts; a source
    without characters is left out.
    """
    return source_mixing.mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row; an empty text has no ids."""
    encoded = byte_bpe.encode_documents(docs, byte_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", sha256("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: SQL cannot express the stages; the tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage's rows are written once and read back."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
