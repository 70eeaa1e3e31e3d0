"""Exact dedup by content sort, in DataFrame operations only.

Texts are equal when they are identical after all ASCII white space is deleted; null counts as empty.  Sampled splitters
deal the rows to ranges of their normalised content (its first characters, then its digest, so that splitters stay
short); within a range an external sort places equal contents side by side, and a window over the full normalised text
compares neighbours and takes the row that stays: the one with the most code points, then the smallest doc_id.

A content held by more than a thousandth of all rows is salted, so that no range gets a hot group as a whole; its
partial results, at most some hundred thousand in number whatever the input, are joined once more.

Rows with equal doc_id are separate rows of a group, of which one stays; a null doc_id counts as the smallest.  Salts come
from rows, so rows that share a doc_id are spread, too.  Texts of any length are compared whole.  Other columns are neither
needed nor touched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, materialize, shuffle_slices

#: Characters that no comparison sees.
IGNORED = " \t\n\x0b\x0c\r"
PREFIX, SALTS = 48, 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("size"), normalised(F.col(text_col).cast("string")).alias("norm"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("mark", F.xxhash64("norm"))
    # hot contents: at most HEAVY_SHARE marks, found by one count over digests
    counts = materialize(base.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > 1), "content-counts")
    total = docs.count()
    hot = counts.where(F.col("n") > max(SALTS, total // HEAVY_SHARE)).select("mark", F.lit(SALTS).alias("salts"))
    # at most HEAVY_SHARE rows by arithmetic, so the broadcast is bounded
    dealt = base.join(F.broadcast(hot), "mark", "left").select("doc_id", "row", "size", "norm", F.substring("norm", 1, PREFIX).alias("head"), F.sha2("norm", 256).alias("sha"), F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("salts")).cast("int") + 1).otherwise(0).alias("salt"))
    ranged = dealt.repartitionByRange(shuffle_slices(spark), "head", "sha", "salt")
    key = ["head", "sha", "salt", "norm"]
    inside = Window.partitionBy(*key).orderBy(F.desc("size"), F.asc("doc_id"), F.asc("row"))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.select("doc_id", "row", "sha", "salt", F.struct(-F.first("size").over(whole), F.first("doc_id").over(whole), F.first("row").over(whole)).alias("best"), F.count("*").over(whole).alias("n"), F.row_number().over(inside).alias("nth"))
    found = materialize(found.select("doc_id", "row", "sha", "salt", F.col("best.col1").alias("best_size"), F.col("best.col2").alias("best_id"), F.col("best.col3").alias("best_row"), "n", "nth"), "content-groups")
    # each salted run gives one row; a hot content has SALTS of them at most
    runs = found.where((F.col("salt") > 0) & (F.col("nth") == 1))
    merged = runs.groupBy("sha").agg(F.min(F.struct("best_size", "best_id", "best_row")).alias("best"), F.sum("n").alias("all_n"))
    out = found.join(F.broadcast(merged), "sha", "left")
    keep = F.when(F.col("salt") > 0, F.col("best.best_id")).otherwise(F.col("best_id"))
    alone = F.col("row") == F.when(F.col("salt") > 0, F.col("best.best_row")).otherwise(F.col("best_row"))
    return out.select("doc_id", keep.alias("keep_id"), F.when(F.col("salt") > 0, F.col("all_n")).otherwise(F.col("n")).alias("group_size"), alone.alias("kept"), F.col("sha").alias("text_sha256"))
