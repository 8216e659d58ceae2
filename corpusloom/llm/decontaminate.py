"""Benchmark decontamination with suffix arrays of the training text.

A few Arrow batches of documents are a shard.  Its words become ranks in the
benchmark's sorted vocabulary (other words cannot be part of a match and end
a suffix), and the suffixes long enough to hold a window are sorted into a
word-level suffix array.  Every test suffix of the benchmark is located by
binary search; neighbouring hits on one diagonal join to the longest verbatim
matches.  A document lies in one shard whole, so nothing is shuffled.

The benchmark enters in blocks of at most BLOCK_BYTES of text, measured
first, one at a time collected, broadcast and let go; further blocks add to
the hits found so far.

Defined results: null and word-less texts have no words, no hits and are
clean; an item without words has no windows; items that repeat an item_id
count once; repeated documents are judged each by itself; an empty benchmark
leaves all clean.  The columns kept are named in each function.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

WINDOW = 13
#: Text of a block; its index takes about thirty times that in a worker.
BLOCK_BYTES = 8 << 20
#: Text of a shard, unless a batch has more.
SHARD_BYTES = 8 << 20
#: Lower-case A-Z; every other ASCII character outside 0-9a-z separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Suffixes:
    """The test suffixes of one benchmark block: distinct windows and the items that hold them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        split = [words(t) for _, t in items]
        names = sorted({w for ws in split for w in ws})
        self.vocabulary = {w: i for i, w in enumerate(names)}
        self.item_ids = [i for i, _ in items]
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, ws in enumerate(split):
            ids = tuple(map(self.vocabulary.__getitem__, ws))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(ids[i : i + n], []).append((k, i))
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        keys = np.zeros((len(found), window), ">u4")
        for r, w in enumerate(found):
            keys[r, : len(w)] = w
            keys[r, : len(w)] += 1
        above = keys.copy()
        above[np.arange(window)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        kind = f"S{4 * window}"
        self.low, self.high = keys.view(kind).ravel(), above.view(kind).ravel()
        self.full = self.lengths == window
        self.holders = [np.array(v, np.int64) for v in found.values()]

    def ids(self, text: bytes) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of each occurrence in a shard of word ranks; -1 ends a suffix."""
        w, n = self.window, ids.size
        none = np.zeros(0, np.int64)
        if not self.holders or not n:
            return none, none
        stop = np.where(ids < 0, np.arange(n), n)
        room = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        starts = np.flatnonzero(room >= self.shortest)
        if not starts.size:
            return none, none
        padded = (np.concatenate([ids, np.full(w, -1)]) + 1).astype(">u4")
        keys = np.lib.stride_tricks.sliding_window_view(padded, w)[starts]
        keys[np.arange(w)[None, :] >= room[starts][:, None]] = 0
        keys = np.ascontiguousarray(keys).view(f"S{4 * w}").ravel()
        order = np.argsort(keys, kind="stable")
        array, keys = starts[order], keys[order]  # the suffix array
        low = np.searchsorted(keys, self.low, "left")
        high = np.where(self.full, np.searchsorted(keys, self.high, "right"), np.searchsorted(keys, self.high, "left"))
        count = high - low
        which = np.repeat(np.arange(count.size), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return array[at], which


class Shard:
    """The hits of one batch of documents."""

    def __init__(self, suffixes: Suffixes, raw: list[bytes]):
        parts = [suffixes.ids(t) for t in raw]
        self.n_words = np.array([p.size for p in parts], np.int64)
        gap = np.full(1, -1)
        ids = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.position, self.which = suffixes.search(ids)
        self.doc = np.searchsorted(self.first, self.position, "right") - 1
        self.suffixes, self.size = suffixes, ids.size

    def cover(self, earlier: list[list[int]] | None = None) -> np.ndarray:
        """Which places of the shard are inside a window; earlier: the (start, end) pairs, flat, that each document has."""
        edge = np.bincount(self.position, minlength=self.size + 1) - np.bincount(self.position + self.suffixes.lengths[self.which], minlength=self.size + 1)
        for first, pairs in zip(self.first.tolist(), earlier or ()):
            for a, b in zip(pairs[::2], pairs[1::2]):
                edge[first + a] += 1
                edge[first + b] -= 1
        return np.cumsum(edge)[: self.size] > 0

    def items(self) -> list[list[int]]:
        """The item numbers that each document meets."""
        out: list[list[int]] = [[] for _ in self.n_words]
        pairs = np.unique(np.stack([self.doc, self.which], 1), axis=0) if self.doc.size else np.zeros((0, 2), np.int64)
        for d, w in pairs.tolist():
            out[d] += self.suffixes.holders[w][:, 0].tolist()
        return [sorted(set(x)) for x in out]

    def matches(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, document word, item word, length): longest verbatim matches."""
        hits = [(d, int(i), int(j) - p, p, int(self.suffixes.lengths[w])) for d, p, w in zip(self.doc.tolist(), (self.position - self.first[self.doc]).tolist(), self.which.tolist()) for i, j in self.suffixes.holders[w]]
        hits.sort()
        k = 0
        while k < len(hits):
            d, item, shift, p, n = hits[k]
            end = p + n
            k += 1
            while k < len(hits) and hits[k][:3] == (d, item, shift) and hits[k][3] <= end:
                end = max(end, hits[k][3] + hits[k][4])
                k += 1
            yield d, item, p, p + shift, end - p


_BUILT: dict[str, Suffixes] = {}


def _suffixes(items, key: str, window: int) -> Suffixes:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Suffixes(items.value, window)
    return _BUILT[key]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def count_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the benchmark's measured size takes."""
    total = _items(benchmark).agg(F.sum(F.length("text") + 64)).first()[0] or 0
    return -(-total // block_bytes) or 1


def block(benchmark: DataFrame, b: int, n: int) -> list[tuple[str, bytes]]:
    """The (item_id, text) of one of n blocks, each of a bounded size."""
    items = _items(benchmark)
    part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
    return [(r[0] or "", bytes(r[1])) for r in part.collect()]


def _runs(cover: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
    return edge.tolist()


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_STATE = "hit array<long>, items array<string>"


def _shards(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[list[bytes], list]]:
    """Texts and states of several batches together, SHARD_BYTES of text or little more, as every test suffix is searched once a shard."""
    raw, states, size = [], [], 0
    for text, state in batches:
        raw += common.raw_texts(text)
        states += state.to_pylist()
        size += text.nbytes
        if size >= SHARD_BYTES:
            yield raw, states
            raw, states, size = [], [], 0
    if raw:
        yield raw, states


def _judge(items: Broadcast, window: int, last: bool):
    """A column function of (text, state so far): what the block's items add, or at the last block the result."""
    key = uuid.uuid4().hex

    @F.arrow_udf(_FOUND if last else _STATE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        suffixes = _suffixes(items, key, window)
        for raw, states in _shards(batches):
            shard = Shard(suffixes, raw)
            cover = shard.cover([s["hit"] if s else [] for s in states])
            met = [sorted({*(s["items"] if s else ()), *(suffixes.item_ids[i] for i in new)}) for s, new in zip(states, shard.items())]
            bounds = list(zip(shard.first.tolist(), (shard.first + shard.n_words).tolist()))
            if not last:
                yield pa.StructArray.from_arrays([pa.array([_runs(cover[a:b]) for a, b in bounds], pa.list_(pa.int64())), pa.array(met, pa.list_(pa.string()))], ["hit", "items"])
                continue
            before = np.concatenate([[0], np.cumsum(cover)])
            hit = [int(before[b] - before[a]) for a, b in bounds]
            n = shard.n_words.tolist()
            columns = [
                pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(m) for m in met], pa.int64()),
                pa.array([hashlib.sha256(",".join(m).encode()).hexdigest() for m in met], pa.string()),
                pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, n)], pa.bool_()),
            ]
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
        common.release()

    return run.asNondeterministic()  # so that it runs once, however often its fields are used


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """The boxed rows and `found`, a struct of _FOUND; texts go to Python, and nothing else of a row."""
    spark = common.prepare(docs.sparkSession)
    rows = common.boxed(docs)
    text = common.field("text").cast("binary")
    none = F.lit(None).cast(f"struct<{_STATE}>")
    n = count_blocks(benchmark, block_bytes)
    if n == 1:
        items = spark.sparkContext.broadcast(block(benchmark, 0, 1))
        return rows.select(common.ROW, _judge(items, window, True)(text, none).alias("found"))
    # of each block only what it finds is kept, by the text's digest; the texts are read again for the next
    key = F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256)).alias("key")
    path = common.scratch(spark, "benchmark-hits")
    for b in range(n):
        items = spark.sparkContext.broadcast(block(benchmark, b, n))
        found = rows.select(key, _judge(items, window, False)(text, none).alias("state")).filter(F.size("state.items") > 0)
        found.select("key", F.lit(b).alias("block"), "state").dropDuplicates(["key", "block"]).write.mode("append").parquet(path)
        items.destroy()
    met = spark.read.schema(f"key binary, block int, state struct<{_STATE}>").parquet(path)
    # n entries a text at most
    met = met.groupBy("key").agg(F.flatten(F.collect_list("state.hit")).alias("hit"), F.array_distinct(F.flatten(F.collect_list("state.items"))).alias("items"))
    met = common.written(met.select("key", F.struct("hit", "items").alias("state")), "benchmark-states")
    size = met.agg(F.sum(32 + 8 * F.size("state.hit") + F.aggregate("state.items", F.lit(0), lambda n, x: n + 24 + F.octet_length(x)))).first()[0] or 0
    joined = rows.withColumn("key", key).join(F.broadcast(met) if size <= common.BROADCAST_BYTES else met.hint("merge"), "key", "left")
    nothing = spark.sparkContext.broadcast([])
    return joined.select(common.ROW, _judge(nothing, window, True)(text, F.col("state")).alias("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id or the columns of keep, n_words, n_hit, n_items, items_sha256, contaminated), one row a document.

    contaminated: a word is hit, and at least a twentieth of the words are.
    """
    return _judged(docs, benchmark, window, block_bytes).select(*common.fields(keep or ["doc_id"]), "found.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): each longest verbatim match and where it is."""
    spark = common.prepare(docs.sparkSession)
    out, n = None, count_blocks(benchmark, block_bytes)
    for b in range(n):
        items = spark.sparkContext.broadcast(block(benchmark, b, n))

        def locate(batches: Iterator[pa.RecordBatch], items=items, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            suffixes = _suffixes(items, key, window)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], suffixes.item_ids[i], p, j, n) for d, i, p, j, n in Shard(suffixes, common.raw_texts(batch.column("text"))).matches()]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(locate, "doc_id long, item_id string, doc_word long, item_word long, n_words long")
        if n > 1:  # one block at a time is held
            found = common.written(found, "longest-matches")
            items.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return common.unboxed(_judged(docs, benchmark, window, block_bytes).filter(~F.col("found")["contaminated"]).select(common.ROW))
