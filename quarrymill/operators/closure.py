"""What is reached over edges: a semi-naive iteration, whose every round follows only what the round before has found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def closure(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges: child, parent; seeds: root, node.  root, node and the least number of steps (the seeds have 0).

    Pairs that are known already are left out of a round, so cycles end; rows without a key lead nowhere.  Each round joins
    its frontier with the edges and is written; rounds: stop after so many.
    """
    edges = edges.where("child is not null and parent is not null").distinct()
    frontier = staged(seeds.where("root is not null and node is not null").select("root", "node").distinct(), "frontier")
    known, done = frontier.withColumn("steps", F.lit(0)), 0
    while rounds is None or done < rounds:
        done += 1
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = staged(step.join(known.select("root", "node"), ["root", "node"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            break
        known = known.union(frontier.withColumn("steps", F.lit(done)))
    return known
