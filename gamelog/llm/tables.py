"""Reading tables and cutting lineage, shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gamelog.session import find_package, require_checkpoint_dir, stored  # noqa: F401

#: Stands for a NULL id wherever ids are compared: it comes before every other id.
NULL_ID = -(2**63)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose positions share a bucket of an exchange.
BUCKET_BYTES = 1 << 25


def text_buckets(docs: DataFrame) -> int:
    """Buckets for an exchange of positions in texts: as many as the texts need, and at least
    one per shuffle partition. One pass over the lengths."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """(doc, tag, columns): the id with NULL first, and a 64-bit hash of the text."""
    find_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("tag"), *columns)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc, tag, text), a NULL text being empty.

    Rows that share an id are told apart and ordered by the hash; rows equal in both
    are one document. Only these columns are read, whatever else the table holds.
    """
    return keyed(docs, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_of(doc):
    """The id as it was, from the key of ``keyed_texts``."""
    return F.when(doc != NULL_ID, doc)


#: Rows of one key that a task may well take in a join, whatever the table's size.
FEW_ROWS = 20_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A table without texts, cut from its lineage by a checkpoint.

    Its rows are counted as they are written. A table that is small for its partitions is
    read in fewer of them (what made it ran on all): every later shuffle writes a file per
    partition on both sides, and such tables are many.
    """
    require_checkpoint_dir(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    rows = seen.get["rows"]
    kept = kept.coalesce(max(1, -(-rows // FEW_ROWS)))
    kept.known_rows = rows
    return kept


def row_count(df: DataFrame) -> int:
    """Rows of a stored table, without a job if they were counted when it was written."""
    known = getattr(df, "known_rows", None)
    return df.count() if known is None else known


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key, with frequent keys spread.

    Keys with more than a quarter of a task's share are salted; at most four per shuffle
    partition can be that frequent, which bounds what is collected and broadcast here. They
    are counted in ``rows``, a stored table with the keys of ``left`` (``left`` itself if
    that is stored).
    """
    spark = left.sparkSession
    rows = left if rows is None else rows
    total = row_count(rows)
    if total <= FEW_ROWS:
        return left.join(right, on, how)
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    each = max(FEW_ROWS // 10, total // (4 * shuffle_partitions(spark)))
    heavy = counts.filter(F.col("rows") > each).select(*on, F.ceil(F.col("rows") / each).cast("int").alias("salts")).collect()
    if not heavy:
        return left.join(right, on, how)
    schema = left.select(*on).schema.add("salts", "integer")
    salts = F.broadcast(spark.createDataFrame(heavy, schema))
    parts = F.coalesce("salts", F.lit(1))
    dealt = left.join(salts, on, "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("salts")
    copies = right.join(salts, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("salts")
    return dealt.join(copies, [*on, "salt"], how).drop("salt")
