"""Sequence packing by power-of-two decomposition.

A document's ids are cut into pieces of `max_length` and then, for the rest,
into the powers of two of its binary length, largest first.  Each piece is a
sequence of its own and goes to the bucket of its length; a full bucket leaves
as one batch of equal sequences, so no sequence crosses documents and none
needs padding.  The work is a projection: no shuffle, a bucket holds BATCH_IDS
ids at most besides one piece, and copies or hot sources cannot gather
anywhere.

sequence_id and batch_id are unique and made of the task's partition and a
count in it; a partition that is computed again gives the same.  The ids of
one document are in memory at a time, whatever its length.
Null texts count as empty: one piece with the end id.  Rows with equal doc_id
are packed each by itself.  Other columns of the input are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common

MAX_LENGTH = 1024
END_ID = 0
#: Ids of a batch of equal sequences.
BATCH_IDS = 1 << 16
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, batch_id long"


def binary_pieces(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; max_length is a power of two."""
    out, at = [], 0
    while n - at >= max_length:
        out.append((at, max_length))
        at += max_length
    for b in reversed(range(max_length.bit_length())):
        if (n - at) >> b & 1:
            out.append((at, 1 << b))
            at += 1 << b
    return out


class _Buckets:
    """Pieces by length; full batches leave, so a bucket holds `batch_ids` ids or few more."""

    def __init__(self, batch_ids: int, keep_ids: bool, part: int):
        self.batch_ids, self.keep_ids, self.batch = batch_ids, keep_ids, part << 33
        self.rows: dict[int, list[tuple]] = {}

    def add(self, length: int, *row) -> pa.RecordBatch | None:
        rows = self.rows.setdefault(length, [])
        rows.append(row)
        return self.flush(length) if len(rows) * length >= self.batch_ids else None

    def flush(self, length: int) -> pa.RecordBatch:
        rows = self.rows.pop(length)
        doc, start, crc, tokens, ids = zip(*rows)
        n = len(rows)
        columns = [pa.array(x, pa.int64()) for x in (doc, start, [length] * n, crc, tokens, [self.batch] * n)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "batch_id"]
        if self.keep_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        self.batch += 1
        return pa.RecordBatch.from_arrays(columns, names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for length in sorted(self.rows, reverse=True):
            yield self.flush(length)


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, keep_ids: bool = True, batch_ids: int = BATCH_IDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, batch_id[, ids], sequence_id, offset), a row for each piece.

    Rows come in batches: the sequences of a batch_id have one length and
    follow each other, `batch_ids` ids together, fewer in a partition's last
    batch of a length.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        buckets = _Buckets(batch_ids, keep_ids, TaskContext.get().partitionId())
        for batch in batches:
            for d, code in zip(batch.column("doc_id").to_pylist(), tok.encode(common.texts(batch.column("text")))):
                code += end
                n = len(code) // 4
                for a, m in binary_pieces(n, max_length):
                    piece = code[4 * a : 4 * (a + m)]
                    full = buckets.add(m, d, a, common.crc_of(piece), n, piece if keep_ids else None)
                    if full is not None:
                        yield full
        yield from buckets.rest()
        common.release()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECE + (", ids binary" if keep_ids else ""))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
