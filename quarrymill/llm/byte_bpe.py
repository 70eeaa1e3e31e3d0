"""Byte-level BPE encoding and decoding of a text column.

``encode_decode`` encodes each whole text by a rank file with the tokenizers library over Arrow batches and decodes the
ids again through the byte table: characters that are split over ids come back whole, since bytes are joined before
anything is read as UTF-8.

Nulls and empty texts have no ids.  A row gives a row, whether its doc_id is null or shared; ties cannot occur.  Texts of any
length are encoded whole.  Other columns are neither needed nor touched, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import decode, rank_encoder
from .common import bound_batches, tidy

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id long, ids array<int>, offsets array<int>, decoded binary"


def byte_offsets(ids: np.ndarray, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where in the text's bytes each id starts."""
    lens = (starts[1:] - starts[:-1])[ids]
    return np.cumsum(lens) - lens


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """full: the ids, their byte offsets and the decoded bytes; else their number and SHA-256 digests."""

    def run(batches):
        encoder, table, starts = rank_encoder(path, pattern)
        for batch in batches:
            for at, ids, off in encoder.blocks(batch.column(1)):
                small = ids.astype("<u4")
                data, ends = decode(ids, table, starts)
                ends = np.concatenate([[0], ends])[off].tolist()
                off = off.tolist()
                keys = batch.column(0).slice(at, len(off) - 1)
                spans = list(zip(off[:-1], off[1:], ends[:-1], ends[1:], strict=True))
                if full:
                    columns = [pa.array([small[a:b].tolist() for a, b, _, _ in spans], pa.list_(pa.int32())), pa.array([byte_offsets(ids[a:b], table, starts).tolist() for a, b, _, _ in spans], pa.list_(pa.int32())), pa.array([data[c:d].tobytes() for _, _, c, d in spans], pa.binary())]
                    yield pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "ids", "offsets", "decoded"])
                else:
                    columns = [pa.array([b - a for a, b, _, _ in spans], pa.int64()), pa.array([hashlib.sha256(small[a:b]).hexdigest() for a, b, _, _ in spans]), pa.array([hashlib.sha256(data[c:d]).hexdigest() for _, _, c, d in spans])]
                    yield pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"cast({text_col} as string) as text").mapInArrow(tidy(run), FULL if full else DIGEST)
