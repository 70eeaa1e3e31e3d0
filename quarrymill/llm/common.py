"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key held by more than a total / HEAVY_SHARE of the rows counts as hot; there can be at most HEAVY_SHARE of them.
HEAVY_SHARE = 1000
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes that a slice of packed blocks holds, and 64-bit words of a broadcast Bloom filter at most.
SLICE_BYTES, MAX_FILTER_WORDS = 64 << 20, 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(step):
    """A step over Arrow batches that hands its memory back when a task ends; workers live on and wait for the next one."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return run


def bound_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES from here on, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set and Spark itself is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quarrymill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later step reads; what a result is read from stays until its owner clears the folder."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_slices(spark: SparkSession) -> int:
    """Number of slices that hash-partitioned binary blocks are dealt to; it follows the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices_for(spark: SparkSession, size: int | None) -> int:
    """As many slices as hold size bytes in SLICE_BYTES each, and as many as the session has shuffle partitions at least."""
    return max(shuffle_slices(spark), -(-int(size or 0) // SLICE_BYTES))


def broadcast_filter(keys: DataFrame, hashed):
    """A function (hashes: uint64 array) -> bool array that is true for the 64-bit hashes of keys, and for a few others.

    A Bloom filter of 16 bits a key, MAX_FILTER_WORDS of 64 bits at most, is what the driver holds and broadcasts; beyond
    that size it lets more through, so whoever asks it confirms by a join, and shuffles little else than what it keeps.
    """
    spark = keys.sparkSession
    words = 1 << min(max(10, (keys.count() // 4).bit_length()), MAX_FILTER_WORDS.bit_length() - 1)
    mask = F.lit(words * 64 - 1)
    spots = keys.select(F.explode(F.array(hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask))).alias("spot"))
    filled = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toPandas()
    bits = np.zeros(words, np.uint64)
    bits[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast(bits)

    def holds(hashes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(hashes), bool)
        for spot in (hashes & np.uint64(words * 64 - 1), hashes >> np.uint64(32) & np.uint64(words * 64 - 1)):
            keep &= (known.value[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return keep

    return holds


def _kept_by(docs: DataFrame, key: str, holds, wanted: bool) -> DataFrame:
    names = docs.columns

    def run(batches):
        for batch in batches:
            keep = holds(batch.column(len(names)).to_numpy().view(np.uint64)) == wanted
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(keep))

    return docs.select("*", F.xxhash64(key).alias("_hashed")).mapInArrow(tidy(run), docs.schema)


def lookup_few(docs: DataFrame, table: DataFrame, key: str, step, schema) -> DataFrame:
    """docs left-joined with a table that has one row a key, then step over Arrow batches of docs' columns and table's others.

    Rows that surely have no row in the table pass by the shuffle: they meet the step at once, with nulls.  No stage holds
    more than one Python worker a task.
    """
    holds = broadcast_filter(table.select(key), F.xxhash64(key))
    others = [f for f in table.schema.fields if f.name != key]

    def without(batches):
        for batch in batches:
            yield batch.filter(pa.array(~holds(batch.column(batch.num_columns - len(others) - 1).to_numpy().view(np.uint64))))

    names = [*docs.columns, *[f.name for f in others]]
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in others]
    passed = docs.select("*", F.xxhash64(key).alias("_hashed"), *nulls)
    found = _kept_by(docs, key, holds, True).join(table.hint("merge"), key, "left").select(*names).mapInArrow(tidy(step), schema)

    def run(batches):
        for batch in without(batches):
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_hashed"]
            yield from step(iter([pa.RecordBatch.from_arrays(columns, names)]))

    return found.union(passed.mapInArrow(tidy(run), schema))


def unique_ids(docs: DataFrame, id_col: str, new_col: str) -> DataFrame:
    """docs with a long column new_col that orders rows as id_col does and that no two rows share; null stays null.

    Where no id is shared it is id_col itself; else ids are counted in order, by local places and the sizes of ranges.
    """
    spark = docs.sparkSession
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return docs.withColumn(new_col, F.col(id_col))
    row = without_clash(docs.columns, "row")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ranged = docs.where(F.col(id_col).isNotNull()).select(id_col, row).repartitionByRange(shuffle_slices(spark), id_col, row).sortWithinPartitions(id_col, row)
    ranged = materialize(ranged.select(row, F.monotonically_increasing_id().alias("at")), "ordered-rows")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = ranged.withColumn("part", part).join(F.broadcast(base), "part").select(row, (F.col("base") + place).alias(new_col))
    return docs.join(numbered, row, "left").drop(row)


def without_clash(names: list[str], wanted: str) -> str:
    """wanted, with as many underscores before it as make it differ from all names."""
    while wanted.lower() in {n.lower() for n in names}:
        wanted = "_" + wanted
    return wanted


def quoted(names: list[str]) -> list[str]:
    """Column names as select() takes them, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def hot_keys(counted: DataFrame, count_col: str, total: int) -> DataFrame:
    """Rows of a table keyed once per key whose count exceeds total / HEAVY_SHARE: at most HEAVY_SHARE rows by arithmetic."""
    return counted.where(F.col(count_col) > F.lit(max(1, total // HEAVY_SHARE)))


def skew_safe_lookup(left: DataFrame, table: DataFrame, key: list[str], count_col: str, total: int, how: str = "left") -> DataFrame:
    """Joins left with a table that has one row a key and the number of left's rows of that key.

    The keys with more than total / HEAVY_SHARE rows are at most HEAVY_SHARE, so their rows are broadcast and their
    many left rows never move; all other keys have few rows each and go through a shuffle join.
    """
    value = [c for c in table.columns if c not in key and c != count_col]
    limit = max(1, total // HEAVY_SHARE)
    hot = hot_keys(table, count_col, total).select(*key, F.struct(*value).alias("_hot"))
    cold = table.where(F.col(count_col) <= limit).select(*key, F.struct(*value).alias("_cold"))
    marked = left.join(F.broadcast(hot), key, "left")
    done = marked.where(F.col("_hot").isNotNull()).select(*left.columns, *[F.col("_hot")[c].alias(c) for c in value])
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, key, "left" if how == "left" else "inner")
    return done.unionByName(rest.select(*left.columns, *[F.col("_cold")[c].alias(c) for c in value]))
