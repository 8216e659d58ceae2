"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir, ship

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds what one Arrow batch holds, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return ship(spark)


def release() -> None:
    """Gives freed memory of a Python worker back, as workers live on and other operators use them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone
            drop_written(spark, path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes a table in the shared folder, which cuts the lineage, and reads it back."""
    return kept(df, name, **options)[0]


def kept(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """The same with its path, for drop_written."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW = "__row"


def boxed(docs: DataFrame) -> DataFrame:
    """The rows as one struct, so that no column's name can clash with an operator's own.

    What goes to Python is read out of it (`field`); the struct stays in the JVM.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def field(name: str) -> Column:
    """A column of a boxed row."""
    return F.col(ROW)[name]


def fields(names: list[str]) -> list[Column]:
    return [field(c).alias(c) for c in names]


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


#: The most that is broadcast of a side whose size depends on the data.
BROADCAST_BYTES = 8 << 20


def row_key(id_col: str, text_col: str) -> Column:
    """32 bytes that tell boxed rows apart by id and whole text."""
    own = field(id_col).cast("string")
    marked = F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), own))
    return F.unhex(F.sha2(F.concat(marked, F.lit("\0"), F.coalesce(field(text_col), F.lit(""))).cast("binary"), 256))


def keep_rows(docs: DataFrame, id_col: str, text_col: str, every: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns.

    every and stay have row_key as `key`: a row for each row of docs, and one
    for each that stays, of a key one at most.  Only the keys of rows that go
    are sent to the texts: broadcast while they are few, which is counted, else
    by a join on the key.
    """
    marked = every.select("key", F.lit(0).alias("s")).unionAll(stay.select("key", F.lit(1).alias("s")))
    counted = marked.groupBy("key").agg(F.count_if(F.col("s") == 0).alias("n"), F.count_if(F.col("s") == 1).alias("m"))
    gone = written(counted.filter("m < n"), "rows-that-go")
    size, shared = gone.agg(F.count(F.lit(1)), F.count_if(F.col("m") > 0)).first()
    rows = boxed(docs).withColumn("key", row_key(id_col, text_col))
    keys = gone.select("key")
    rest = rows.join(F.broadcast(keys) if 64 * size <= BROADCAST_BYTES else keys.hint("merge"), "key", "left_anti").select(ROW)
    if shared:  # rows that repeat an id and a text: one of them stays
        one = rows.join(gone.filter("m > 0").select("key"), "key", "left_semi").groupBy("key").agg(F.first(ROW).alias(ROW))
        rest = rest.unionAll(one.select(ROW))
    return unboxed(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, m: int) -> Column:
    """crc32 of an id written as text, modulo m; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m)), F.lit(-1))


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text without decoding it; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on the input's."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
