"""A corpus pipeline over the table documents: quality classifier, exact dedup, n-gram Jaccard join, suffix-array dedup,
best-fit packing.

Each stage takes (spark, docs, sf_dir), where docs are the documents that the stage before has kept, and returns a
DataFrame; run() writes it as Parquet to the shared folder and reads it again for the next.  All stages but the last
return the columns of documents, whatever others there are and whatever their names.

For every stage: a null text is an empty one; texts of any length are taken whole; an empty table gives an empty one; nulls
in other columns stay as they are.  Rows that share a doc_id, rows without one, and ties are settled row by row, as each
stage says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from quarrymill.llm.common import documents, materialize, quoted, without_clash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents it is given.

    Each row is scored by its own text, so rows that share a doc_id, or have none, go or stay alone; a score of 0.5 stays.
    """
    score = without_clash(docs.columns, "score")
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=score)
    return scored.where(F.col(score) >= 0.5).select(*quoted(docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays: the one with the most code points, then the smallest doc_id, null before all.

    Rows that agree in all this are repeats of each other; one of them stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda sha, doc_id: F.concat_ws(" ", sha, F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")))
    key, size, nth = without_clash(docs.columns, "key"), without_clash(docs.columns, "size"), without_clash(docs.columns, "nth")
    marked = docs.select("*", named(F.sha2(exact_dedup.normalised(text), 256), F.col("doc_id")).alias(key), F.length(text).alias(size))
    kept = exact_dedup.groups(docs).where("kept").select(named(F.col("text_sha256"), F.col("doc_id")).alias(key))
    best = marked.join(kept, key, "left_semi")
    # rows of one doc_id and content that differ in white space, or not at all: the longest stays
    one = Window.partitionBy(key).orderBy(F.desc(size))
    return best.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*quoted(docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest doc_id stays.

    Rows that share a doc_id are linked with each other, are one document and stay or go together.  Rows without doc_id
    have no name that a group could keep, so all of them stay.
    """
    kept = ngram_join.link(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("k_id")).distinct()
    own = without_clash(docs.columns, "own_id")
    marked = docs.select(*quoted(docs.columns), F.col("doc_id").cast("long").alias(own))
    named = marked.where(F.col(own).isNotNull()).join(kept, F.col(own) == F.col("k_id"), "left_semi")
    return named.unionByName(marked.where(F.col(own).isNull())).select(*quoted(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur earlier go; n_chars follows the text.

    Rows that share a doc_id are documents of their own; rows without doc_id lose nothing.
    """
    out = substring_dedup.remove(docs, keep_columns=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of what is left, a row a piece; each row is packed, whether its doc_id is shared or missing."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]
#: A classifier and a packing plan are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
