"""Every stage of the pipeline against a brute-force version, on what the stage before kept."""

import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gamelog.llm import byte_bpe, oracle, queries, toxicity

from test_jaccard import brute
from test_substrings import by_key, removed


def cut(text, gone):
    """The characters of which not all bytes are gone."""
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        if not all(gone[at : at + size]):
            out.append(c)
        at += size
    return "".join(out)


def test_stages(spark, rows, folder, tmp_path):
    toxic = [(1000 + i, f"{r[1]} gruk blarg {r[1][:40]} gruk", "en", "src1", 5) for i, r in enumerate(rows[:25]) if r[1]]
    docs = spark.createDataFrame([*rows, *toxic], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(r[0], 0) for r in rows if r[0] is not None] + [(r[0], 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clashing = ("doc", "tag", "toxicity", "score", "label", "id", "place", "copy", "rate", "sums", "marks", "kept", "component_doc")
    docs.withColumns({c: F.lit(c) for c in clashing}).write.parquet(f"{tmp_path}/documents.parquet")
    kept, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path, before = f"{tmp_path}/{number}", kept
        stage(spark, before, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        old, new = ([tuple(r) for r in df.collect()] for df in (before.select(*corpus_pipeline.COLUMNS), kept))
        if name != "byte_bpe":
            assert kept.schema == docs.schema, name
        if name == "toxicity":
            model = toxicity.learn(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            scores = toxicity.NGrams(), [r[1] for r in old]
            assert Counter(new) == Counter(r for r, s in zip(old, model.scores(*scores)) if s < queries.TOXIC)
            assert not {r[0] for r in new} & {r[0] for r in toxic} and len(new) > 0.8 * len(rows)
        elif name == "near_duplicates":
            named = brute(old, 5, 80)
            assert Counter(new) == Counter({r: 1 for r in old for k in by_key([r]) if named[k][1] == k})
        elif name == "suffix_dedup":
            gone = removed({k: list(t) for k, t in by_key(old).items()}, 100)
            text = {r: cut(r[1] or "", gone[k]) for r in old for k in by_key([r])}
            assert Counter(new) == Counter((r[0], text[r], *r[2:4], len(text[r])) for r in old)
        elif name == "source_mixing":
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/{number - 1}/*.parquet'")
            assert Counter(new) == Counter(r[:5] for r in con.sql(oracle.MIXING).fetchall())
    ranks = {t: i for i, t in enumerate(byte_bpe.load_ranks(queries.RANKS))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(r[0], library.encode_ordinary(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in old]
    assert Counter((r[0], r[1], tuple(r[2]), r[3]) for r in new) == Counter((d, len(i), tuple(i), s) for d, i, s in ids)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((d, tuple(i)) for d, i, _ in ids)


def test_empty_tables(spark, empty_folder, tmp_path):
    spark.read.parquet(f"{empty_folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "source_mixing", "byte_bpe"]
