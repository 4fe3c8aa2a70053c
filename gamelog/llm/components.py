"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.tables import checkpointed, join_hot


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): the least node it is connected to.

    Every round a node takes the least root of its neighbours and then its root's root, so
    long chains shrink by more than half. Rounds end when no neighbour has a lesser root.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = checkpointed(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        of_neighbour = join_hot(both, roots.select(F.col("node").alias("b"), "root"), ["b"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = checkpointed(
            roots.join(of_neighbour, roots["node"] == of_neighbour["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        )
        if lower.filter(F.col("old") != F.col("mid")).isEmpty():
            return roots
        above = lower.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        roots = checkpointed(join_hot(lower, above, ["mid"]).select("node", F.least("mid", "top").alias("root")))
