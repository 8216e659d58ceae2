"""Writers: tables, vector stores and training sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.vector_store import PAYLOAD_MB, payload_mb


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def collection(df: DataFrame, path: str, by: Column, least: int = 8, most_mb: float = 16) -> None:
    """The rows as JSON arrays, a file each: `least` of them, or more, so that one has about `most_mb`; dealt by a hash of `by`."""
    row = F.struct(*df.columns)
    size = df.agg(F.sum(F.octet_length(F.to_json(row)))).first()[0] or 0
    n = max(least, math.ceil(size / (most_mb * (1 << 20))))
    rows = df.select(F.pmod(F.xxhash64(by), F.lit(n)).alias("part"), row.alias("r")).repartition(n, "part")
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("part").text(path)


def append_vectors(df: DataFrame, path: str, by: str | None = "collection") -> None:
    """Rows with a vector, a folder for each collection."""
    w = df.filter(F.col("embedding").isNotNull()).write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def hybrid(df: DataFrame, path: str, columns: list[str], order: str, limit_mb: float = PAYLOAD_MB) -> str:
    """Writes to the primary store, or the local one where the payload estimate is too large; returns which."""
    mb = payload_mb(df, columns, order).first()["payload_mb"] or 0.0
    store = "primary" if mb < limit_mb else "local"
    append_vectors(df.withColumn("store", F.lit(store)), path, "store")
    return store


def clear(df: DataFrame, path: str) -> None:
    """An empty table of the same schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def pairs(df: DataFrame, path: str, kind: str = "json") -> None:
    """Instruction pairs as json, csv with a header, or alpaca with an empty input."""
    w = df.select("instruction", "output")
    if kind == "csv":
        w.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif kind == "alpaca":
        w.select("instruction", F.lit("").alias("input"), "output").write.mode("overwrite").json(path)
    else:
        w.write.mode("overwrite").json(path)


def dataset(df: DataFrame, path: str) -> None:
    """A folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
