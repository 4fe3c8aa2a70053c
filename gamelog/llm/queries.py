"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gamelog.llm import (
    bbit_minhash, block_anchors, byte_bpe, centroid_clustering, collocations, jaccard_join, license_scan, piecewise_hash, site_style_tree,
    source_mixing, suffix_doubling, toxicity, va_file,
)
from gamelog.llm.tables import id_of, keyed_texts, read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: The rank file of the registered encoding query.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Scores from here on count as toxic.
TOXIC = 0.3


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def sha256(column):
    return F.sha2(column, 256)


@query
def op1_site_style_tree(spark, folder):
    found = site_style_tree.extract_main_text(read(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_jaccard_join(spark, folder):
    docs = keyed_texts(read(spark, folder, "documents"))
    found = jaccard_join.jaccard_components(docs, size=4, percent=85)
    return found.select(
        id_of(F.col("doc")).alias("doc_id"), "n_shingles", id_of(F.col("component_doc")).alias("component_id")
    )


@query
def op3_source_mixing(spark, folder):
    return source_mixing.mix_sources(read(spark, folder, "documents"))


@query
def op4_toxicity(spark, folder):
    docs = read(spark, folder, "documents")
    model = toxicity.learn(docs, read(spark, folder, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )


@query
def op5_suffix_doubling(spark, folder):
    found = suffix_doubling.dedup_bytes(keyed_texts(read(spark, folder, "documents")))
    return found.select(
        id_of(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", sha256("kept").alias("kept_sha256")
    )


@query
def op6_va_file(spark, folder):
    return va_file.exact_top_k(read(spark, folder, "embeddings"), k=5, every=50)


@query
def op7_license_scan(spark, folder):
    found = license_scan.license_scan(keyed_texts(read(spark, folder, "documents")))
    return found.select(
        id_of(F.col("doc")).alias("doc_id"),
        *("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
    )


@query
def op8_byte_bpe(spark, folder):
    tokens = byte_bpe.load_ranks(RANKS)
    encoded = byte_bpe.encode_documents(
        read(spark, folder, "documents"), tokens, public_tokenizers.PATTERN
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"),
    )


@query
def op9_block_anchors(spark, folder):
    found = block_anchors.dedup_windows(keyed_texts(read(spark, folder, "documents")))
    return found.select(id_of(F.col("doc")).alias("doc_id"), "n_words", "n_removed", sha256("kept").alias("kept_sha256"))


@query
def op10_piecewise_hash(spark, folder):
    found = piecewise_hash.edited_neighbours(read(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        sha256("edited_text").alias("edited_sha256"),
        *("fingerprint", "edited_fingerprint", "near_edited", "near_next"),
    )


@query
def op11_bbit_minhash(spark, folder):
    found = bbit_minhash.near_duplicates(keyed_texts(read(spark, folder, "documents")), size=4, percent=80)
    return found.select(
        id_of(F.col("doc")).alias("doc_id"),
        "n_shingles",
        id_of(F.col("component_doc")).alias("component_id"),
        (F.col("doc") == F.col("component_doc")).alias("kept"),
    )


@query
def op12_collocations(spark, folder):
    return collocations.collocations(read(spark, folder, "documents"))


@query
def op13_centroid_clustering(spark, folder):
    return centroid_clustering.cluster_vectors(read(spark, folder, "embeddings"))
