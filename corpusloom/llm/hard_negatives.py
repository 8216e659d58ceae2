"""Hard-negative mining by blocked dense matrix products.

Vectors become integers, floor(scale * x), held in float64: every product and
sum is exact below 2^53, which is checked from the table's largest component
and longest vector first (beyond it int64 products are used, exact below
2^63; more is refused, as such a score has no long).

Anchors are taken in blocks of at most BLOCK_BYTES, one after the other, so
that what is broadcast has a fixed bound.  For a block the whole table streams
past twice.  The first pass multiplies the block with each batch of candidates
and keeps, for each anchor, the best rows of its label; the second keeps, for
each anchor and positive, the best rows of other labels whose score lies in
the positive's window.  A task's best lists are merged by score and id in
Spark, and each has a handful of rows whatever the data, so ties and copies
never pile up.  An anchor's own row is among the first pass's candidates; the
best list is one longer for it, and one entry of its id and score is taken out
(any other row like that gives the same result).

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; vectors of different lengths meet as if
the shorter one ended in zeros; an empty vector scores zero; repeated ids are
rows of their own, as anchors too; ties go by the smaller id; an empty table,
or one without anchors, gives no rows.  Other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

#: The most that one block of anchors takes, as float64.
BLOCK_BYTES = 4 << 20
#: Anchors that are multiplied at a time.
STEP = 512
_LOW = np.iinfo(np.int64).min


class Best:
    """The k best (score, id) of each of n lists, kept as arrays; a higher score comes first, then a smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _LOW), np.full((n, k), np.iinfo(np.int64).max)
        self.size = np.zeros(n, np.int64)

    def better(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the entries for the lists `at` would enter them."""
        full = self.size[at] == self.score.shape[1]
        worst = self.score[at, -1]
        return ~full | (score > worst) | ((score == worst) & (ids < self.id[at, -1]))

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = self.better(at, score, ids)
        at, score, ids = at[some], score[some], ids[some]
        if not at.size:
            return
        k = self.score.shape[1]
        own = np.unique(at)
        held = np.arange(k)[None, :] < self.size[own][:, None]
        at = np.concatenate([at, np.repeat(own, self.size[own])])
        score, ids = np.concatenate([score, self.score[own][held]]), np.concatenate([ids, self.id[own][held]])
        order = np.lexsort((ids, ~score, at))  # ~score falls as score rises, for every long
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, own)
        rank = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
        keep = rank < k
        self.score[at[keep], rank[keep]], self.id[at[keep], rank[keep]] = score[keep], ids[keep]
        self.size[own] = np.minimum(k, np.diff(np.append(first, at.size)))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, rank = np.nonzero(np.arange(self.score.shape[1])[None, :] < self.size[:, None])
        return at, self.score[at, rank], self.id[at, rank]


def _matrix(column: pa.Array, width: int, scale: float, kind: type) -> np.ndarray:
    """One row a vector, scaled and floored, with zeros behind short ones."""
    size = np.diff(column.offsets.to_numpy())
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(kind)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width)[None, :] < size[:, None]] = values
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T).astype(np.int64)


def _batch(batch: pa.RecordBatch, width: int, scale: float, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), width, scale, kind)


def mine(table: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", scale: float = 256.0,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: a condition on the table's columns.  A negative's score lies
    between low and high hundredths of its positive's score, ends included.
    """
    spark = common.prepare(table.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), anchor.alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    anchors = common.written(rows.filter("anchor").select(F.monotonically_increasing_id().alias("no"), "id", "label", "vector"), "anchors")
    wide = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    n, width, most = anchors.count(), int(wide[0] or 0), int(abs(scale) * (wide[1] or 0)) + 1
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    if width * most * most >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit a long")
    kind = np.float64 if width * most * most < 1 << 53 else np.int64
    blocks = max(1, -(-n * max(1, width) * 8 // block_bytes))
    while True:  # numbers are dealt by hash, so blocks are even but for chance
        numbered = anchors.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
        if blocks >= n or max(r["count"] for r in numbered.groupBy("block").count().orderBy(F.desc("count")).limit(1).collect()) * max(1, width) * 8 <= 2 * block_bytes:
            break
        blocks *= 2
    path = common.scratch(spark, "hard-negatives")
    candidates = rows.select("id", "label", "vector")
    for b in range(blocks):
        own = numbered.filter(F.col("block") == b).select("id", "label", "vector").toArrow().combine_chunks()
        if len(own):
            block = (own.column("id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("vector").combine_chunks(), width, scale, kind))
            _block(candidates, block, width, scale, kind, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)


def _block(candidates: DataFrame, block: tuple, width: int, scale: float, kind: type, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = candidates.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q = sent.value
        best = Best(len(ids), positives + 1)
        for batch in batches:
            cid, clabel, c = _batch(batch, width, scale, kind)
            for a in range(0, len(ids), STEP):
                s = _scores(q[a : a + STEP], c)
                i, j = np.nonzero((labels[a : a + STEP, None] == clabel[None, :]) & (s >= best.score[a : a + STEP, -1:]))
                best.add(i + a, s[i, j], cid[j])
        at, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score), pa.array(found)], ["at", "score", "id"])
        common.release()

    merged = Window.partitionBy("at").orderBy(F.desc("score"), "id")
    near = candidates.mapInArrow(nearest, "at long, score long, id long").withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= positives + 1)
    # a handful of rows for each anchor of a block
    got = sorted((r["at"], r["rank"], r["score"], r["id"]) for r in near.collect())
    ids, _, q = block
    own = np.einsum("ij,ij->i", q, q).astype(np.int64)
    lists: list[list[tuple[int, int]]] = [[] for _ in ids]
    gone = np.zeros(len(ids), bool)
    for at, _, score, i in got:
        if not gone[at] and i == ids[at] and score == own[at]:
            gone[at] = True  # the anchor itself
        elif len(lists[at]) < positives:
            lists[at].append((score, i))
    pos = [(a, s, i) for a, x in enumerate(lists) for s, i in x]
    number = np.array([p[0] for p in pos], np.int64)
    first = np.searchsorted(number, np.arange(len(ids)))
    until = np.searchsorted(number, np.arange(len(ids)), "right")
    floor = np.array([-(-low * s // 100) for _, s, _ in pos], np.int64)
    ceil = np.array([high * s // 100 for _, s, _ in pos], np.int64)
    windows = spark.sparkContext.broadcast((first, until, floor, ceil, pos))

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q = sent.value
        first, until, floor, ceil, pos = windows.value
        best = Best(len(pos), negatives)
        size = until - first
        least = np.array([floor[a:z].min() if z > a else 1 for a, z in zip(first, until)], np.int64)
        most = np.array([ceil[a:z].max() if z > a else 0 for a, z in zip(first, until)], np.int64)
        for batch in batches:
            cid, clabel, c = _batch(batch, width, scale, kind)
            for a in range(0, len(ids), STEP):
                s = _scores(q[a : a + STEP], c)
                part = slice(a, a + STEP)
                i, j = np.nonzero((labels[part, None] != clabel[None, :]) & (s >= least[part, None]) & (s <= most[part, None]))
                score = s[i, j]
                i += a
                for k in range(int(size.max(initial=0))):
                    w = first[i] + k
                    some = np.flatnonzero(k < size[i])
                    some = some[(score[some] >= floor[w[some]]) & (score[some] <= ceil[w[some]])]
                    best.add(w[some], score[some], cid[j[some]])
        at, score, found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, [int(ids[pos[w][0]]) for w in at], [pos[w][2] for w in at], [pos[w][1] for w in at], found, score)] if at.size else [pa.array([], pa.int64())] * 6, list(_FOUND))
        common.release()

    merged = Window.partitionBy("at").orderBy(F.desc("negative_score"), "negative_id")
    found = candidates.mapInArrow(window, ", ".join(f"{c} long" for c in _FOUND)).withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_FOUND = ("at", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
