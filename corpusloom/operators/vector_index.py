"""A persistent vector index: cells of k-means, product-quantised codes, exact re-ranking.

Fitting takes at most `sample` rows, those with the smallest id hashes; every
row is then assigned to its nearest cell and coded by the residual, in Arrow
batches.  The table is laid out by cell (range-partitioned by cell and row, so
that a cell with a large share of the rows is several files), with the codes
beside the vectors: a search reads the codes of the probed cells and no
vectors, keeps a few candidates for each query and task, and reads the
candidates' vectors to rank them by the exact score.

With all cells probed, vectors are scored instead of codes and the result is
that of an exhaustive search.  Rows without a vector, or without a direction
where the metric is cosine, are in the index (cell -1) and are never hits.
Appended rows are coded by the index's own model.  Scores and ties are those
of vector_store.search_many: higher first, then the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.vector_store import _equal, _scores
from corpusloom.session import shared_path, ship

#: Rows that a model is fitted on, at most.
SAMPLE = 20_000
#: Codes of a part of a vector.
WORDS = 256
#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 8 << 20
_ROUNDS = 12


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    square = (centres**2).sum(1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (square[None, :] - 2 * (x[a : a + 4096] @ centres.T)).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = _ROUNDS) -> np.ndarray:
    """Centres of at most k clusters; an empty one moves to the point that lies worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if empty.size:
            worst = np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")[: empty.size]
            centres[empty[: worst.size]] = x[worst]
    return centres


class Model:
    """Cell centres and the code books of the residuals' parts."""

    def __init__(self, metric: str, centres: np.ndarray, books: np.ndarray, width: int):
        self.metric, self.centres, self.books, self.width = metric, centres, books, width

    @staticmethod
    def fit(x: np.ndarray, metric: str, cells: int | None, parts: int, seed: int = 0) -> Model:
        width = x.shape[1]
        x = Model._even(x, parts)
        cells = cells or max(1, math.isqrt(len(x)))
        centres = k_means(x, min(cells, max(1, len(x))), seed)
        rest = x - centres[_nearest(x, centres)]
        own = rest.reshape(len(x), parts, -1).transpose(1, 0, 2)
        books = [k_means(p, min(WORDS, len(p)), seed + 1 + j) for j, p in enumerate(own)]
        return Model(metric, centres, np.stack(books), width)

    @staticmethod
    def _even(x: np.ndarray, parts: int) -> np.ndarray:
        """Zeros behind vectors, so that the parts are equal."""
        more = -x.shape[1] % parts
        return np.pad(x, ((0, 0), (0, more))) if more else x

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the index holds them: of unit length where the metric is cosine, as wide as the parts need."""
        if self.metric == "cosine":
            n = np.sqrt((x**2).sum(1, keepdims=True))
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return Model._even(x, len(self.books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.unit(x)
        cell = _nearest(x, self.centres)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return cell, np.stack([_nearest(rest[:, j], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n cells that lie best for each query."""
        q = self.unit(q)
        near = q @ self.centres.T if self.metric == "dot" else 2 * (q @ self.centres.T) - (self.centres**2).sum(1)[None, :]
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def table(self, q: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """For queries (as the index holds them) in one cell: the score of each part's codes, and the cell's own share."""
        if self.metric == "dot":
            own, rest = q @ self.centres[cell], q
        else:
            rest = q - self.centres[cell]
            own = -(rest**2).sum(1)
        rest = rest.reshape(len(q), len(self.books), -1)
        dots = np.einsum("qpd,pwd->qpw", rest, self.books)
        return (dots if self.metric == "dot" else 2 * dots - (self.books**2).sum(2)[None]), own

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {c: pa.array([x.astype("<f8").tobytes()], pa.binary()) for c, x in (("centres", self.centres), ("books", self.books))}
        shape = pa.array([[len(self.centres), *self.books.shape, self.width]], pa.list_(pa.int64()))
        spark.createDataFrame(pa.table({"metric": [self.metric], "shape": shape, **arrays})).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(f"{path}/model").first()
        cells, parts, words, each, width = r["shape"]
        return Model(r["metric"], np.frombuffer(r["centres"]).reshape(cells, parts * each), np.frombuffer(r["books"]).reshape(parts, words, each), width)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def build(table: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, parts: int = 16, sample: int = SAMPLE, id_col: str = "vec_id") -> Model:
    """Fits a model and writes the whole table, with all its columns, as an index.

    cells: the square root of the sample's size unless given.  All vectors have one length.
    """
    spark = ship(table.sparkSession)
    ok = _indexed(metric)
    n, least, most = table.filter(ok).agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError("vectors of one index have one length")
    some = table.filter(ok)
    if n > sample:  # by hash, a little more than needed, so that no sort of the whole is
        some = some.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / n + 100 / n)))
    some = some.select(id_col, "embedding").orderBy(F.xxhash64(id_col), id_col).limit(sample)  # bounded
    x = _matrix(some.toArrow().column(1).combine_chunks()) if n else np.zeros((1, 1))
    model = Model.fit(_unit(x, metric), metric, cells, min(parts, x.shape[1]))
    model.save(spark, path)
    append(table, path, model, "overwrite")
    return model


def _indexed(metric: str):
    vector = F.col("embedding").isNotNull()
    return vector & (V.norm(F.col("embedding")) > 0) if metric == "cosine" else vector


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    n = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def append(table: DataFrame, path: str, model: Model | None = None, mode: str = "append") -> None:
    """Codes more rows by the index's model and adds them; rows are not looked for among those that are there."""
    spark = ship(table.sparkSession)
    model = model or Model.load(spark, path)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf("cell int, code binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cell, code = sent.value.encode(_matrix(batch))
            yield pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "code"])

    ok = _indexed(model.metric)
    coded = table.filter(ok).withColumn("__c", encode.asNondeterministic()("embedding")).select(*table.columns, F.col("__c.cell").alias("cell"), F.col("__c.code").alias("code"))
    none = table.filter(F.coalesce(~ok, F.lit(True))).select(*table.columns, F.lit(-1).alias("cell"), F.lit(None).cast("binary").alias("code"))
    row = F.expr("uuid()")
    coded.unionByName(none).withColumn("row", row).repartitionByRange("cell", "row").sortWithinPartitions("cell").write.mode(mode).parquet(f"{path}/rows")


def info(spark: SparkSession, path: str) -> DataFrame:
    """Rows by cell; -1: without a vector, or a direction."""
    return spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))


class _Top:
    """The k best (score, id, row) of each of n queries."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))] * n

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        old = self.held[query]
        if old[0].size >= self.k:
            ok = score >= old[0][-1]
            score, ids, rows = score[ok], ids[ok], rows[ok]
        if score.size:
            s, i, r = (np.concatenate(x) for x in zip(old, (score, ids, rows)))
            order = np.lexsort((i, -s))[: self.k]
            self.held[query] = s[order], i[order], r[order]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, candidates: int | None = None, where: dict | None = None, id_col: str = "vec_id", query_col: str = "query_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, id, score, rank): about the k best rows of each query, by the exact score.

    Each query looks at `probes` cells and re-ranks `candidates` rows, 20 times k
    unless given.  Queries are taken in blocks of a bounded size, one after the
    other; a block's hits are written before the next.
    """
    ship(spark)
    model = Model.load(spark, path)
    everything = probes >= len(model.centres)
    asked = queries.filter(F.size("embedding") == model.width).select(F.col(query_col), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = shared_path(spark, "index-queries")
    asked.withColumn("__n", F.monotonically_increasing_id()).write.parquet(kept)
    asked = spark.read.parquet(kept)
    blocks = max(1, -(-asked.count() * 8 * model.width // block_bytes))
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("cell") >= 0).filter(_equal(asked, where))
    out = shared_path(spark, "index-hits")
    schema = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("__n"), F.lit(blocks)) == b)
        hits = _search(model, rows, block, k, len(model.centres) if everything else probes, everything, candidates or 20 * k, id_col, query_col)
        schema = hits.schema
        hits.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _search(model: Model, rows: DataFrame, asked: DataFrame, k: int, probes: int, exact: bool, candidates: int, id_col: str, query_col: str) -> DataFrame:
    spark = rows.sparkSession
    got = asked.select("__n", "embedding").toArrow()  # a block of bounded size
    q = _matrix(got.column(1).combine_chunks()) if len(got) else np.zeros((0, model.width))
    names = got.column(0).to_numpy()
    near = model.probed(q, probes)
    of = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    sent = spark.sparkContext.broadcast((model, q, names, of))
    most = k if exact else candidates

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q, names, of = sent.value
        top, held = _Top(len(q), most), model.unit(q)
        for batch in batches:
            cells, ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "row"))
            codes = None if exact else np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(cells), -1)
            vectors = _matrix(batch.column("embedding")) if exact else None
            order = np.argsort(cells, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                mine = of.get(int(cells[part[0]])) if part.size else None
                if mine is None:
                    continue
                if exact:
                    s = _scores(model.metric, vectors[part], q[mine]).T
                else:
                    table, own = model.table(held[mine], int(cells[part[0]]))
                    s = np.repeat(own[:, None], part.size, axis=1)
                    for j in range(len(model.books)):
                        s += table[:, j, codes[part, j]]
                for i, row in zip(mine, s):
                    top.add(i, row, ids[part], rows[part])
        for n, (s, i, r) in zip(names, top.held):
            if s.size:
                yield pa.RecordBatch.from_arrays([pa.array([n] * s.size, pa.int64()), pa.array(s), pa.array(i, pa.int64()), pa.array(r, pa.string())], ["__n", "score", "id", "row"])

    read = rows if exact else rows.filter(F.col("cell").isin(list(of)))
    columns = [F.col("cell"), F.col(id_col).cast("long").alias("id"), "row", "embedding" if exact else "code"]
    found = read.select(*columns).mapInArrow(look, "__n long, score double, id long, row string")
    w = Window.partitionBy("__n").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    if not exact:
        some = best.select("__n", "row", "id")  # candidates of one block
        some = F.broadcast(some) if len(q) * candidates * 64 <= BLOCK_BYTES else some
        paired = rows.select("row", F.col("embedding").cast("array<double>").alias("v")).join(some, "row").join(F.broadcast(asked.select("__n", "embedding")), "__n")
        scored = paired.select("__n", "id", F.round(V.score(model.metric, F.col("v"), F.col("embedding")), 12).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(F.broadcast(asked.select("__n", query_col)), "__n").select(query_col, F.col("id").alias(id_col), "score", F.col("rank").cast("int").alias("rank"))


def tune(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, recall: float = 0.95, id_col: str = "vec_id", query_col: str = "query_id", most: int = 200) -> int:
    """The fewest probes with which, for some of the queries (`most` at most), so large a share of the exact hits lies in probed cells."""
    model = Model.load(spark, path)
    some = queries.filter(F.size("embedding") == model.width).orderBy(F.xxhash64(query_col)).limit(most)
    hits = search(spark, path, some, k, len(model.centres), id_col=id_col, query_col=query_col)
    cells = spark.read.parquet(f"{path}/rows").select(id_col, "cell")
    found = hits.join(cells, id_col).join(some.select(query_col, F.col("embedding").cast("array<double>").alias("embedding")), query_col).select("cell", "embedding").toArrow()
    if not len(found):
        return 1
    order = model.probed(_matrix(found.column(1).combine_chunks()), len(model.centres))
    place = (order == found.column(0).to_numpy()[:, None]).argmax(1)
    return int(np.sort(place)[min(len(place), math.ceil(recall * len(place))) - 1]) + 1
