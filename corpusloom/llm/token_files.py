"""Token ids of a corpus in Simple-8b shard files.

Documents are range-partitioned and sorted by doc_id, tokenized, and written
as shards of about SHARD_IDS ids in a Parquet table of the shared folder: a
row holds one shard's bytes (see simple8b) and the directory of documents in
it.  Reading decodes the shards and needs no shuffle; what lies before a
partition comes from a sum by partition, one small row each.

Null texts count as empty and have the end id alone.  Rows with equal doc_id
keep their own places, in order of their text, and may lie in several ranges.  Rows without doc_id come
first.  A document is never split between shards, however long.  Other
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, simple8b

SHARD_IDS = 1 << 18
END_ID = 0
_SHARD = "part int, seq long, before long, n_ids long, doc_id array<long>, n_tokens array<long>, payload binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, seq, before, n_ids, doc_id[], n_tokens[], payload): the shards, lazily; before counts within the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer_path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        ids, sizes, raw, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = simple8b.pack(np.frombuffer(b"".join(raw), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "seq", "before", "n_ids", "doc_id", "n_tokens", "payload"],
            )

        for batch in batches:
            for doc, code in zip(batch.column("doc_id").to_pylist(), tok.encode(common.texts(batch.column("text")))):
                n = len(code) // 4 + 1
                ids.append(doc)
                sizes.append(n)
                raw += (code, end)
                total += n
                if total >= shard_ids:
                    yield flush()
                    seq, before = seq + 1, before + total
                    ids, sizes, raw, total = [], [], [], 0
        if ids:
            yield flush()
        common.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 32).alias("head"))
    ordered = rows.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(encode, _SHARD)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    encode_documents(docs, tokenizer_path, end_id, shard_ids).write.option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)


def _starts(spark, path: str) -> dict[int, int]:
    """Ids before each partition of the files; one entry a partition."""
    shards = spark.read.schema(_SHARD).parquet(path)
    sums = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    out, before = {}, 0
    for part, n in sums:
        out[part], before = before, before + n
    return out


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids, decoded from the files."""
    return _read(spark, path, lambda raw, at, n: [raw[4 * a : 4 * (a + m)] for a, m in zip(at, n)], "ids binary", pa.binary())


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): from the decoded ids."""
    return _read(spark, path, lambda raw, at, n: [common.crc_of(raw[4 * a : 4 * (a + m)]) for a, m in zip(at, n)], "ids_crc32 long", pa.int64())


def _read(spark, path: str, cut, column: str, kind: pa.DataType) -> DataFrame:
    parts = spark.sparkContext.broadcast(_starts(spark, path))  # one number a partition of the files
    shards = spark.read.schema(_SHARD).parquet(path)
    name = column.split()[0]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, within, docs, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_id", "n_tokens", "payload"))):
                raw = simple8b.unpack(payload).tobytes()
                at = (np.cumsum(sizes) - np.array(sizes)).tolist()
                start = parts.value[part] + within
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([start + a for a in at], pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut(raw, at, sizes), kind)],
                    ["doc_id", "start", "n_tokens", name],
                )

    return shards.select("part", "before", "doc_id", "n_tokens", "payload").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")
