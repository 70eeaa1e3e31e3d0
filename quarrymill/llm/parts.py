"""Trees over groups too large for one task, without sending each part of a group to each other.

A group's parts have been compared by themselves, which leaves trees.  Whether trees of different parts join is asked of one
node of each first, round by round: a group of nodes that are like each other is soon one tree.  A node outside the largest
tree of its group then meets all parts, and only such nodes do: of n nodes in P parts, m of them outside, some n + m P rows
are sent.  Where nothing joins that is what comparing all parts with each other takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_safe_lookup
from .components import components

#: Rounds of comparing one node of each tree, at most; they end before if a round leaves more than half of the trees.
ROUNDS = 6


def _trees(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, node, label of its tree; of each group with several trees: n nodes, trees, top: the largest, outside it, parts)."""
    named = members.join(components(links), "node", "left").select("group", "node", "parts", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "part-trees")
    each = named.groupBy("group", "label").agg(F.count("*").alias("c"), F.max("parts").alias("parts"))
    groups = each.groupBy("group").agg(F.sum("c").alias("n"), F.count("*").alias("trees"), F.max(F.struct("c", (-F.col("label")).alias("last"))).alias("most"), F.max("parts").alias("parts"))
    groups = groups.select("group", "n", "trees", (-F.col("most.last")).alias("top"), (F.col("n") - F.col("most.c")).alias("outside"), "parts")
    return named.drop("parts"), materialize(groups, "part-groups")


def join_parts(members: DataFrame, links: DataFrame, compare) -> DataFrame:
    """links and those that compare finds across parts.

    members: group, node, parts (the number of parts that the group is worth); links: a, b, found within parts, materialized;
    compare: cells (cell, node) -> a, b.
    """
    members = materialize(members.distinct(), "parted")
    total = members.count()
    if not total:
        return links
    share = lambda some: F.greatest(F.lit(1), F.ceil(F.col(some) * F.col("parts") / F.col("n")))  # noqa: E731  parts of some of a group
    before = None
    for nth in range(ROUNDS):
        named, groups = _trees(members, links)
        trees = groups.where("trees > 1").agg(F.sum("trees")).first()[0] or 0
        if not trees or before and 2 * trees > before:
            break
        before = trees
        firsts = named.groupBy("group", "label").agg(F.min("node").alias("node"))
        open_ = groups.where("trees > 1").withColumn("rows", F.col("trees"))
        firsts = skew_safe_lookup(firsts.select("group", "node"), open_, ["group"], "rows", trees, how="inner")
        cell = F.xxhash64("group", F.lit(nth), F.pmod(F.xxhash64("node", F.lit(nth)), share("trees")))
        links = materialize(links.union(compare(firsts.select(cell.alias("cell"), "node"))).distinct(), "part-links")
    else:
        named, groups = _trees(members, links)
    open_ = groups.where("trees > 1").withColumn("rows", F.col("n"))
    if not open_.limit(1).count():
        return links
    rows = skew_safe_lookup(named, open_, ["group"], "rows", total, how="inner")
    mine, theirs = F.pmod(F.xxhash64("node", F.lit(-1)), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(-2)), share("outside"))
    each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    own = rows.select("group", "node", mine.alias("part"), each(share("outside")).alias("guest"))
    guests = rows.where(F.col("label") != F.col("top")).select("group", "node", each(F.col("parts")).alias("part"), theirs.alias("guest"))
    cells = own.union(guests).select(F.xxhash64("group", "part", "guest", F.lit("last")).alias("cell"), "node").distinct()
    return materialize(links.union(compare(cells)).distinct(), "part-links")
