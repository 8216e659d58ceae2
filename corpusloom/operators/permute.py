"""Shuffling without a sort of random keys: a keyed permutation of positions.

Each row has a position by its id (vector_store.with_positions: one range
partitioning, no row through a single task).  A balanced Feistel network over
the next even power of two above n maps positions to places; it is a bijection
there whatever its round function, and a place of n or more is mapped again
until it is below n, which keeps it a bijection of 0 .. n - 1.  The place of a
row depends on its position, n and the key alone, so any partitioning gives the
same order.  Rows then go to buckets of places side by side, and only a bucket
is sorted.

Defined results: rows without an id come first in position order; rows that
repeat an id take each other's places in any order; an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.operators.vector_store import with_positions
from corpusloom.session import ship

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def places(position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where each position of 0 .. n - 1 goes."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [(seed * ROUNDS + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for r in range(ROUNDS)]
    out = position.astype(np.uint64)
    todo = np.arange(out.size)
    while todo.size:
        x = out[todo]
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]  # beyond the table: once more
    return out.astype(np.int64)


def permuted(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Adds place, a row's position in the shuffled order from 0."""
    spark = ship(df.sparkSession)
    rows = with_positions(df, id_col)
    n = rows.count()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(places(batch.to_numpy(), n, seed))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    move = F.arrow_udf(run, LongType())
    return rows.withColumn("place", move("position")).drop("position") if n else spark.createDataFrame([], rows.drop("position").withColumn("place", F.lit(0).cast("long")).schema)


def write_shuffled(df: DataFrame, path: str, id_col: str, seed: int = 42, bucket_rows: int = 1_000_000) -> None:
    """Parquet folders bucket=0, 1, ... that hold the shuffled rows in order, bucket_rows each."""
    rows = permuted(df, id_col, seed).withColumn("bucket", F.floor(F.col("place") / bucket_rows))
    rows.repartition("bucket").sortWithinPartitions("bucket", "place").write.mode("overwrite").partitionBy("bucket").parquet(path)
