"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import checkpointed, shuffle_partitions

#: Rates of so many sources are broadcast (each takes a few hundred bytes); beyond it the
#: texts are joined to them by exchange.
MOST_SENT = 10_000
#: The largest mean of one draw: exp(-mean) stays a normal double. Larger means are sums of
#: equal parts.
LARGEST_MEAN = 600
#: Digits of the hash that make the uniform number: 52 bits, exact in a double.
HEX_DIGITS = 13
DENOMINATOR = float(2**52)


def uniform(seed: str, *columns):
    """A number in [0, 1) fixed by the seed and the row's columns, NULL or not."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / DENOMINATOR


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, power: float, epochs: float) -> DataFrame:
    """(source, rate): the mean number of repetitions that gives each source its weight.

    ``weights`` are shares by source name (a missing source has 0; None names rows without
    one); without them a source weighs its characters to ``power``. The mix has ``epochs``
    times the characters of all documents. One row per source.
    """
    sizes = checkpointed(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(power))).otherwise(0.0))
    else:
        spark = docs.sparkSession
        named = spark.createDataFrame(list(weights.items()), "name string, weight double")
        weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("name")), "left").select(
            "source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    all_size, all_weight = weighed.agg(F.sum("size"), F.sum("weight")).first()
    if not all_size or not all_weight:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    rate = F.lit(epochs * all_size / all_weight) * F.col("weight") / F.col("size")
    return weighed.select("source", F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def distribution(rate, most: int):
    """The Poisson distribution function at 0, 1, ... ``most``, which is past the reach of
    52 bits, for a column of means."""
    last = lambda s: F.element_at(s["sums"], -1)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums")),
        lambda s, k: F.struct(
            (s["term"] * rate / k).alias("term"), F.array_append(s["sums"], last(s) + s["term"] * rate / k).alias("sums")
        ),
        lambda s: s["sums"],
    )


def poisson_inverse(u, sums):
    """The least count whose Poisson distribution function exceeds ``u``."""
    return F.size(F.filter(sums, lambda x: u >= x))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    epochs: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """The documents repeated to target weights and shuffled: doc_id, text, lang, source,
    n_chars, copy (from 1), place (the shuffle key, ascending).

    A row's count inverts the Poisson distribution with its source's rate at a uniform
    number hashed from seed, doc_id and source, so it does not depend on partitions or
    reruns. A NULL source is a source of its own; NULL doc_ids share one number; repeated
    rows have equal counts and are all repeated; empty and NULL texts have the counts of
    their source; a source without characters or of weight 0 is left out. Other columns
    are not read.
    """
    rates = source_rates(docs.select("source", "text"), weights, power, epochs)
    top, sources = rates.agg(F.max("rate"), F.count(F.lit(1))).first()
    parts = max(1, math.ceil((top or 0.0) / LARGEST_MEAN))
    mean = (top or 0.0) / parts
    most = math.ceil(mean + 12 * math.sqrt(mean) + 25)
    # the distribution is summed up once per source; a row only looks its number up
    known = rates.select(F.col("source").alias("rated"), distribution(F.col("rate") / parts, most).alias("sums"))
    if sources <= MOST_SENT:
        known = F.broadcast(known)
    rated = docs.select("doc_id", "text", "lang", "source", "n_chars").join(known, F.col("source").eqNullSafe(F.col("rated")))
    draws = [poisson_inverse(uniform(f"{seed}/count/{p}", F.col("doc_id"), F.col("source")), F.col("sums")) for p in range(parts)]
    copies = rated.withColumn("count", sum(draws[1:], draws[0])).filter(F.col("count") > 0)
    repeated = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}/place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")))
    # places are uniform: their first digits deal them to ordered partitions without a sample
    partitions = shuffle_partitions(docs.sparkSession)
    ordered = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * partitions / 2**32).cast("int")
    return (
        repeated.withColumn("place", place)
        .select("doc_id", "text", "lang", "source", "n_chars", "copy", "place")
        .repartitionById(partitions, ordered)
        .sortWithinPartitions("place", "copy")
    )
