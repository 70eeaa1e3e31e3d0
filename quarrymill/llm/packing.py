"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over a histogram of piece lengths, never over documents: lengths go from the longest down, and all
pieces of one length are placed at once into the groups of equal bins with the least room that still holds them.  The
plan has a few rows a length whatever the size of the corpus.  A piece then takes its slot by joining on its length and
its rank within that length.

A document longer than a sequence is cut so that only its first piece may be shorter than a sequence.  Nulls count as
empty texts, which still have their end id.  Rows that repeat a doc_id, or have none, are packed as separate documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import json_encoder
from .common import bound_batches, materialize, tidy

SEQUENCE, END_ID = 1024, 2
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"
_PLAN = "length int, first_rank long, last_rank long, per_bin long, first_sequence long, first_offset long"


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of _PLAN for a histogram {length: number of pieces}.

    A group stands for many bins with the same contents; rooms maps the free room to the groups that have it.
    A piece of full length needs no plan: each is a sequence by itself.
    """
    rooms: dict[int, list[list[int]]] = {}  # room -> [[first sequence, number of bins]]
    free: list[int] = []  # rooms that occur, ascending
    rows, sequences = [], 0

    def give(room: int, first: int, bins: int) -> None:
        if bins and room:
            if room not in rooms:
                rooms[room] = []
                insort(free, room)
            rooms[room].append([first, bins])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                per = size // length
                bins = left // per
                groups = [[sequences, bins, per]] if bins else []
                if left % per:
                    groups.append([sequences + bins, 1, left % per])
                for first, many, each in groups:
                    rows.append((length, rank, rank + many * each - 1, each, first, 0))
                    give(size - each * length, first, many)
                    rank += many * each
                    sequences += many
                left = 0
                continue
            room = free[at]
            first, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], free[at]
            per = room // length
            full = min(bins, left // per)
            groups = [[first, full, per]] if full else []
            if full < bins and left - full * per:
                groups.append([first + full, 1, left - full * per])
            used = 0
            for begin, many, each in groups:
                each = min(each, per)
                rows.append((length, rank, rank + many * each - 1, each, begin, size - room))
                give(room - each * length, begin, many)
                rank += many * each
                left -= many * each
                used += many
            give(room, first + used, bins - used)
    return rows


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encoded documents with their end id, cut into pieces; part and local_rank number the pieces of a length in a task."""

    def run(batches):
        encoder, part, seen = json_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for at, ids, off in encoder.blocks(batch.column(1)):
                n = np.diff(off) + 1
                doc = batch.column(0).slice(at, len(n))
                many = -(-n // size)
                first = n - (many - 1) * size
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
                length = np.where(piece == 0, first[row], size)
                order = np.argsort(length, kind="stable")
                sizes, counts = np.unique(length, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                with_end = np.insert(ids.astype("<u4"), off[1:], end_id)
                begin = (off[:-1] + np.arange(len(n)))[row] + start
                spans = list(zip(begin.tolist(), (begin + length).tolist(), strict=True))
                columns = [doc.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(with_end[a:b]) for a, b in spans], pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if with_ids:
                    columns.append(pa.array([with_end[a:b].view("<i4").tolist() for a, b in spans], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({text_col} as string) as text").mapInArrow(tidy(run), _PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False, **columns) -> DataFrame:
    """One row a piece with its sequence and its place there."""
    spark = docs.sparkSession
    bound_batches(spark)
    table = materialize(pieces(docs, tokenizer, size, end_id, with_ids=with_ids, **columns), "pieces")
    by_part = materialize(table.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rows = plan_bins(histogram, size)
    slots = spark.createDataFrame([(*r,) for r in rows], _PLAN)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = table.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    # the plan depends on the number of lengths alone, so it may be broadcast
    placed = ranked.alias("p").join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
