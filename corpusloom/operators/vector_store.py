"""Vector tables: search, merge, routing, lookups and statistics.  A table has one row a vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.functions import vectors as V
from corpusloom.session import bounded, shared_path

PAYLOAD_MB = 30.0


def _equal(df: DataFrame, where: dict | None) -> Column:
    out = F.lit(True)
    for k, v in (where or {}).items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def search(table: DataFrame, query: list[float], k: int = 5, metric: str = "cosine", where: dict | None = None, threshold: float | None = None, post_filter: bool = False, compat: bool = False, id_col: str = "vec_id") -> DataFrame:
    """The k best rows, ties by id.  Filters come before ranking, or after it with post_filter.

    A threshold is a least score; null scores, of zero vectors, are never hits.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = table if post_filter else table.filter(_equal(table, where))
    rows = rows.withColumn("score", V.score(metric, F.col("embedding"), q, compat)).filter(F.col("score").isNotNull())
    if threshold is not None and not post_filter:
        rows = rows.filter(F.col("score") >= threshold)
    best = rows.orderBy(F.desc("score"), id_col).limit(k)
    if post_filter:
        best = best.filter(_equal(table, where))
        if threshold is not None:
            best = best.filter(F.col("score") >= threshold)
    return best


#: Rows and queries that are scored at once: a matrix of 8 MB.
ROWS, QUERIES = 512, 2048


def search_many(table: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "vec_id", query_col: str = "query_id", most_mb: float = 16) -> DataFrame:
    """(query, id, score, rank): the k best rows of each query, rank from 1, ties by id.

    The queries (query_id, embedding) are a stated set: collected in blocks
    that take at most `most_mb` with their hits, each scored against every row
    of the table by matrix products of bounded size, whatever the number of
    queries.  A task keeps the k best of its rows for each query, so what is
    shuffled is k rows for each query and task, however many rows tie.
    Scores are rounded to 12 places so that equal vectors tie exactly.
    """
    spark = bounded(table.sparkSession)
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, math.ceil(n * ((width or 1) * 8 + k * 24) / (most_mb * (1 << 20))))
    schema = StructType([StructField(query_col, queries.schema[query_col].dataType), table.schema[id_col], StructField("score", DoubleType())])
    path = shared_path(spark, "hits") if blocks > 1 else ""
    for b in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b)
        rows = [r for r in some.select(query_col, "embedding").collect() if r[1] is not None]
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([list(r[1]) for r in rows], float)))
        del rows

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held = [_Best(q[a : a + QUERIES], k) for a in range(0, len(names), QUERIES)]
            for batch in batches:
                valid = batch.filter(batch.column("embedding").is_valid())
                for a in range(0, valid.num_rows if names else 0, ROWS):
                    some = valid.slice(a, ROWS)
                    ids = some.column(id_col).to_numpy(zero_copy_only=False)
                    x = np.stack(some.column("embedding").to_numpy(zero_copy_only=False)).astype(float)
                    for h in held:
                        h.add(ids, _scores(metric, x, h.queries))
            for h, a in zip(held, range(0, len(names), QUERIES)):
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + QUERIES], target[0]).take(pa.array(h.at)), pa.array(h.ids, target[1]), pa.array(h.scores)], schema.names)

        target = [to_arrow_type(f.dataType) for f in schema.fields]
        out = table.select(id_col, "embedding").mapInArrow(best, schema)
        if blocks > 1:  # one block at a time is held
            out.write.mode("append").parquet(path)
            shared.destroy()
    if blocks > 1:
        out = spark.read.schema(schema).parquet(path)
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Best:
    """The k best rows of some queries so far: by query, then score from the highest, then id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.at, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(queries), -np.inf)  # what a score has to reach

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows with their ids, and their scores by query."""
        s = np.where(np.isnan(scores), -np.inf, scores).T
        least = self.least
        if s.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k])
        at, row = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        if not at.size:
            return
        all_at, all_scores, all_ids = np.concatenate([self.at, at]), np.concatenate([self.scores, s[at, row]]), np.concatenate([self.ids, ids[row]])
        order = np.lexsort((all_ids, -all_scores, all_at))
        sorted_at = all_at[order]
        rank = np.arange(order.size) - np.searchsorted(sorted_at, sorted_at)
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.at, self.scores, self.ids = all_at[order], all_scores[order], all_ids[order]
        full = rank == self.k - 1
        self.least[self.at[full]] = self.scores[full]


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A row for each vector, a column for each query; -inf where a vector has no direction."""
    if metric == "dot":
        s = x @ q.T
    elif metric == "euclid":
        s = -np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ q.T) + (q**2).sum(1)[None, :], 0))
    else:
        n = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((q**2).sum(1))[None, :]
        s = np.divide(x @ q.T, n, out=np.full((len(x), len(q)), -np.inf), where=n > 0)
    return np.round(s, 12)


def merge(primary: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """Primary hits, the fallback's for what is missing, best first."""
    missing = F.lit(k) - F.coalesce(F.col("n"), F.lit(0))
    n = primary.agg(F.count(F.lit(1)).alias("n"))
    # no more than k rows of the fallback can be of use, so the numbering is of k rows
    rest = fallback.orderBy(F.desc("score"), "vec_id").limit(k).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))).join(F.broadcast(n)).filter(F.col("__r") <= missing).drop("__r", "n")
    return primary.unionByName(rest).orderBy(F.desc("score"), "vec_id").limit(k)


def payload_mb(table: DataFrame, columns: list[str], order: str, sample: int = 5) -> DataFrame:
    """(n, mean_bytes, payload_mb) from the mean JSON size of the first rows."""
    row = F.octet_length(F.to_json(F.struct(*columns)))
    mean = table.orderBy(order).limit(sample).agg(F.avg(row).alias("mean_bytes"))
    return table.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(mean)).select("n", "mean_bytes", (F.col("mean_bytes") * F.col("n") / (1 << 20)).alias("payload_mb"))


def route(payload: Column, limit_mb: float = PAYLOAD_MB) -> Column:
    return F.when(payload < limit_mb, "primary").otherwise("local")


def with_positions(table: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Adds position, a row's place from 0 by id, as of vectors in a flat index.

    A range sort and one count a partition; no row passes through a single task.
    """
    spark = table.sparkSession
    path = shared_path(spark, "positions")
    table.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "__part").withColumn("position", place).drop("__part", "__at", "before")


def at_positions(table: DataFrame, positions: list[int]) -> DataFrame:
    """The rows of with_positions at these places; places beyond the table, or below zero, have none."""
    return table.filter(F.col("position").isin(positions))


def by_chunk_id(table: DataFrame, value, column: str = "chunk_id") -> DataFrame:
    return table.filter(F.col(column) == value).limit(1)


def document_chunks(table: DataFrame, document, column: str = "document_id", index: str = "chunk_index", cap: int | None = None) -> DataFrame:
    rows = table.filter(F.col(column) == document)
    return (rows.limit(cap) if cap else rows).orderBy(index)


def page(table: DataFrame, after, size: int, id_col: str = "vec_id") -> DataFrame:
    """The next rows by id; one more than `size` tells that there is another page."""
    return (table if after is None else table.filter(F.col(id_col) > after)).orderBy(id_col).limit(size + 1)


def info(table: DataFrame, store: str = "store") -> DataFrame:
    """Vectors and dimension by store, and over all (store null)."""
    return table.rollup(store).agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def target(kind: Column, embedding: Column) -> Column:
    """The collection of a row by its type and whether it has a vector; unknown types are articles."""
    base = F.when(kind.isin("post", "article", "repository"), kind).otherwise("article")
    return F.concat(F.when(embedding.isNull(), "cleaned_").otherwise("embedded_"), base, F.lit("s"))


def as_points(table: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    return table.select(F.col(id_col).cast("string").alias("id"), F.col("embedding").alias("vector"), F.struct(*payload).alias("payload"))


def as_records(points: DataFrame) -> DataFrame:
    return points.select("id", "payload.*", F.col("vector").alias("embedding"))


def embedding_stats(table: DataFrame) -> DataFrame:
    n = V.norm(F.col("embedding"))
    return table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"))


def batch_id(order: Column, size: int, partition: list[str] | None = None) -> Column:
    """Which batch of `size` rows a row is in; without a partition give it a bounded table."""
    w = Window.partitionBy(*partition) if partition else Window
    return F.floor((F.row_number().over(w.orderBy(order)) - 1) / size)
