"""Connected components of a table of links, by minimum labels and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: a, b.  One row a node with a link: node, label, the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours, then that label's own label, so a round halves
    long chains at least; rounds: stop after so many, with labels that may still be too large.
    """
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    done = 1
    while rounds is None or done < rounds:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(lower.join(jump, "label").select("node", "old", F.col("next").alias("label")), "labels")
        changed = after.where(F.col("old") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        done += 1
        if not changed:
            break
    return labels
