"""N-gram Jaccard join: groups of texts whose shingle sets are similar, by set-relation skipping.

Sets and tokens.  A text's set has the distinct five-word shingles of its
lower-cased words, as 64-bit hashes under a seed drawn for each run.  Equal
sets collapse to one.  Tokens are ordered by a count sketch of fixed size
over all texts, rare ones first, ties by hash; the order decides the work,
never the result.

Index.  Of a set of n tokens the first n - ceil(t n) + 1 are indexed, with
their positions: two sets over the threshold t share one of them.  Where a
pair's first common token stands at positions p and q, its overlap is at most
min(n - p, m - q); the bound is tested on every entry pair, and true pairs
pass it at their first common token.  Lists of one entry go at once.

Answers by set relations.  In a list, each entry is first compared with
leaders only: the entry with the smallest position, which is the set nearest
to what its likes have in common, in its class of sizes and in the one below.
These pairs are verified by whole sets, so a list of many near copies costs
its length, not its square.  Then lists are skipped whose sets all have come
together.  In those left, sorted into blocks by size and position, block
pairs whose bound fails are skipped; of the others only pairs not yet
together are looked at, and a set's answers follow from those of the leader
that it is highly similar to: symmetric differences obey the triangle
inequality, so x and y differ by |D(x, s) - D(y, s)| at least, and what
cannot be linked by that is never verified.  What remains is verified by
whole sets.  Lists beyond CHUNK entries are cut by a hash of the set, and each pair of
chunks is a task of bounded size.

Links are exact but for 64-bit hashes of shingles, whose seed changes with
each run; sets themselves are told apart by 128 bits.

Defined results: a text of fewer than five words is one shingle of all of
them; null, empty and white texts have no set (n_shingles 0) and are linked
with nothing, not even each other; rows with equal ids are rows of their own;
null ids never name a group that has others; an empty table gives no rows.
Other columns stay out.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.llm import common
from corpusloom.llm.components import components

SHINGLE = 5
THRESHOLD = 80
#: The sketch and the filter of wanted sets have 2 to this power cells of 32 bits, 4 MB.
SKETCH_BITS = 20
_PARTS = 16
#: Entries of a list in a task at a time.
CHUNK = 4096
#: Entries of a list that one task holds at most; tokens whose cell counts more are heavy, and their lists are dealt.
MOST = 1 << 22
BLOCK = 128
#: Digests of sets that a task remembers, so as to pass each on once.
SEEN = 200_000
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes, seed: int) -> np.ndarray:
    """A hash for each lower-cased word; long texts are split a megabyte at a time."""
    from xxhash import xxh3_64_intdigest

    out, at = [], 0
    while at < len(text):
        stop = _BREAK.search(text, at + (1 << 20)) if len(text) - at > 1 << 20 else None
        end = stop.end() if stop else len(text)
        words = text[at:end].lower().split()  # of bytes: A-Z and ASCII white space only
        out.append(np.fromiter(map(xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, seed: int, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text, seed)
    if not w.size:
        return w
    k = min(shingle, w.size)
    n = w.size - k + 1
    h = np.full(n, np.uint64((seed + k) & 0xFFFFFFFFFFFFFFFF))
    for i in range(k):
        h = common.mix(h ^ w[i : n + i])
    return np.unique(h)


def prefix(n: int, threshold: int) -> int:
    """How many tokens of a set of n are indexed."""
    return n - (threshold * n + 99) // 100 + 1


def digest(tokens: np.ndarray, seed: int, bits: int = 64) -> tuple[int, int]:
    """Two longs that name a set; bits: of the first."""
    from xxhash import xxh3_128_intdigest

    d = xxh3_128_intdigest(tokens.tobytes(), seed)
    return tuple(np.array([d >> 128 - bits, d & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist())


class _Sets:
    """Distinct sets of a task's texts."""

    def __init__(self, seed: int, shingle: int, bits: int, twice: frozenset[int]):
        self.seed, self.shingle, self.bits, self.twice, self.seen = seed, shingle, bits, twice, set()

    def new(self, batch: pa.RecordBatch, takes: Callable[[int, int | None], bool] = lambda s, i: True) -> Iterator[tuple[int, np.ndarray, int | None]]:
        """The name, tokens and row id of each set that is taken and was not seen before."""
        for text, i in zip(common.raw_texts(batch.column("text")), batch.column("id").to_pylist()):
            tokens = shingle_set(text, self.seed, self.shingle)
            if tokens.size:
                hi, lo = digest(tokens, self.seed, self.bits)
                sid = lo if hi in self.twice else hi
                if sid not in self.seen and takes(sid, i):
                    if len(self.seen) >= SEEN:
                        self.seen.clear()
                    self.seen.add(sid)
                    yield sid, tokens, i


def _merged(parts: DataFrame, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """One array of partial arrays (part, cells), first by the partitions that hold them, then by part; the result has a fixed size."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                x = np.frombuffer(cells, np.uint32).astype(np.uint64)
                got[part] = np.minimum(op(got[part], x), 0xFFFFFFFF) if part in got else x
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in got.values()], pa.binary())], ["part", "cells"])

    shape = "part int, cells binary"
    rows = parts.mapInArrow(fold, shape).repartition(_PARTS, "part").mapInArrow(fold, shape).collect()
    size = (1 << SKETCH_BITS) // _PARTS
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["cells"], np.uint32)
    return out


def _parts(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    size = cells.size // _PARTS
    own = [k for k in range(_PARTS) if cells[k * size : (k + 1) * size].any()]
    return own, [cells[k * size : (k + 1) * size].astype(np.uint32).tobytes() for k in own]


def _scan(docs: DataFrame, seed: int, shingle: int, bits: int) -> DataFrame:
    """(id, n, hi, lo): each row's set; rows with a part hold a piece of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["id", "n", "hi", "lo", "part", "cells"]
        for batch in batches:
            sets = [shingle_set(t, seed, shingle) for t in common.raw_texts(batch.column("text"))]
            cells += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells.size)
            marks = [digest(s, seed, bits) if s.size else (None, None) for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.size for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
            )
        part, some = _parts(np.minimum(cells, 0xFFFFFFFF))
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.array(part, pa.int32()), pa.array(some, pa.binary())], names)
        common.release()

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, part int, cells binary")


def _entries(docs: DataFrame, seed: int, shingle: int, bits: int, threshold: int, sent, heavy: int) -> DataFrame:
    """(token, sid, place): what is indexed; place holds n above 32 bits and the position, negative for tokens of heavy cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, twice = sent.value
        own = _Sets(seed, shingle, bits, twice)
        for batch in batches:
            token, sid, place = [], [], []
            for s, tokens, _ in own.new(batch):
                count = cells[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = prefix(tokens.size, threshold)
                first = np.lexsort((tokens, count))[:p]
                at = np.int64(tokens.size << 32) + np.arange(p)
                token.append(tokens[first].view(np.int64))
                sid.append(np.full(p, s, np.int64))
                place.append(np.where(count[first] > heavy, ~at, at))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, sid, place)], ["token", "sid", "place"])
        common.release()

    return docs.mapInArrow(run, "token long, sid long, place long")


_LIST = ("token", "sid", "n", "pos", "cls", "size", "lead", "lead2")


def _classes(n: np.ndarray, threshold: int) -> np.ndarray:
    """Sizes of one class differ by less than the threshold allows."""
    return np.floor(np.log(n) / np.log(100 / threshold if threshold < 100 else 2.0) + 1e-9).astype(np.int64)


def _led(x: np.ndarray, threshold: int) -> np.ndarray:
    """Of whole lists (token, sid, n, pos, cls) in order, those of two and more as _LIST; lead and lead2: the leaders that an entry is compared with, or the entry itself."""
    first = np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1)) if len(x) else np.zeros(0, bool)
    x = x[first]  # repeats of a token and set go
    start = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0])) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(x)))
    keep = np.repeat(size > 1, size)
    x, size = x[keep], np.repeat(size, size)[keep]
    if not len(x):
        return np.zeros((0, len(_LIST)), np.int64)
    group = np.flatnonzero(np.append(True, (x[1:, [0, 4]] != x[:-1, [0, 4]]).any(axis=1)))
    of = np.repeat(np.arange(group.size), np.diff(np.append(group, len(x))))
    own = x[group]  # the first of each class, the smallest position
    before = np.maximum(np.arange(group.size) - 1, 0)
    near = (own[before, 0] == own[:, 0]) & (own[before, 4] == own[:, 4] - 1)  # the class below is there
    t = threshold

    def lead(leader: np.ndarray, there: np.ndarray) -> np.ndarray:
        ok = there & ((100 + t) * np.minimum(x[:, 2] - x[:, 3], leader[:, 2] - leader[:, 3]) >= t * (x[:, 2] + leader[:, 2]))
        return np.where(ok, leader[:, 1], x[:, 1])

    return np.column_stack([x, size, lead(own[of], np.ones(len(x), bool)), lead(own[before][of], near[of])])


def _lists(entries: DataFrame, spark: SparkSession, threshold: int) -> DataFrame:
    """_LIST: the entries of lists of two and more with their leaders; of heavy cells all, dealt by set as well, without (size 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            token, sid, place = (batch.column(c).to_numpy() for c in ("token", "sid", "place"))
            heavy = place < 0
            place = np.where(heavy, ~place, place)
            n, pos = place >> 32, place & 0xFFFFFFFF
            x = np.column_stack([token, sid, n, pos, _classes(n, threshold)])
            if heavy.any():
                none = np.zeros((int(heavy.sum()), 1), np.int64)
                yield out(np.hstack([x[heavy], none, x[heavy][:, 1:2], x[heavy][:, 1:2]]))
                x = x[~heavy]
            rest = np.concatenate([rest, x])
            differ = np.flatnonzero(rest[1:, 0] != rest[:-1, 0])
            if differ.size:
                end = int(differ[-1]) + 1  # the last list may go on; it is bounded, as larger ones are heavy
                yield out(ordered(rest[:end]))
                rest = rest[end:]
        yield out(ordered(rest))
        common.release()

    def ordered(x: np.ndarray) -> np.ndarray:
        return _led(x[np.lexsort((x[:, 1], x[:, 2], x[:, 3], x[:, 4], x[:, 0]))], threshold)

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(len(_LIST))], list(_LIST))

    salt = F.when(F.col("place") < 0, F.pmod(F.xxhash64("sid"), F.lit(common.partitions(spark)))).otherwise(F.lit(0).cast("long"))
    return entries.repartition("token", salt).sortWithinPartitions("token").mapInArrow(run, ", ".join(f"{c} long" for c in _LIST))


def _heavy_lists(lists: DataFrame, threshold: int) -> DataFrame:
    """The same for lists that several tasks hold: counted and led by aggregations and joins."""
    rows = lists.dropDuplicates(["token", "sid"])
    sizes = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = rows.groupBy("token", "cls").agg(F.min(F.struct("pos", "n", "sid")).alias("lead"))
    leaders = common.written(leaders.join(sizes, "token"), "leaders")
    below = leaders.select("token", (F.col("cls") + 1).alias("cls"), F.col("lead").alias("lead2"))
    led = rows.drop("size", "lead", "lead2").join(leaders, ["token", "cls"]).join(below, ["token", "cls"], "left")
    own = lambda c: F.when(_may(F.col("n"), F.col("pos"), F.col(f"{c}.n"), F.col(f"{c}.pos"), threshold), F.col(f"{c}.sid")).otherwise(F.col("sid"))
    return led.select("token", "sid", "n", "pos", "cls", "size", own("lead").alias("lead"), own("lead2").alias("lead2"))


def _may(n: Column, pos: Column, m: Column, at: Column, t: int) -> Column:
    """Whether sets of n and m tokens that first meet at these positions may pass the threshold."""
    return (100 + t) * F.least(n - pos, m - at) >= t * (n + m)


def _wanted(named: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds rows (sid, least): sets and the row that stands for each; others pass it by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for at, bit in _bits(batch.column("sid").to_numpy(), batch.column("least").to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(cells, at, bit)
        part, some = _parts(cells)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(some, pa.binary())], ["part", "cells"])

    return _merged(named.select("sid", F.coalesce("least", F.lit(0)).alias("least")).mapInArrow(run, "part int, cells binary"), np.bitwise_or)


def _bits(sid: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    x = common.mix(common.mix(sid.astype(np.int64).view(np.uint64)) ^ row.astype(np.int64).view(np.uint64))
    cut = [(x >> np.uint64(s)) & np.uint64((1 << (SKETCH_BITS + 5)) - 1) for s in (0, 32)]
    return [((c >> np.uint64(5)).astype(np.int64), np.uint32(1) << (c & np.uint64(31)).astype(np.uint32)) for c in cut]


def _members(docs: DataFrame, sets: DataFrame, wanted: DataFrame, seed: int, shingle: int, bits: int, twice: frozenset[int]) -> DataFrame:
    """(sid, tokens): the whole sets of wanted (sid), written, each once; a few others may be among them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((_wanted(sets.join(wanted, "sid", "left_semi")), twice))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, twice = sent.value
        own = _Sets(seed, shingle, bits, twice)
        for batch in batches:
            got = [(s, x) for s, x, i in own.new(batch, lambda s, i: all((cells[at] & bit).all() for at, bit in _bits(np.array([s]), np.array([i or 0]))))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([x.tobytes() for _, x in got], pa.binary())], ["sid", "tokens"])
        common.release()

    found = common.written(docs.mapInArrow(run, "sid long, tokens binary"), "shingle-members")
    if found.count() > found.select("sid").distinct().count():  # rows that repeat an id and a text
        found = common.written(found.groupBy("sid").agg(F.first("tokens").alias("tokens")), "shingle-members")
    return found


@F.arrow_udf(LongType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        if x.size > y.size:
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == y.size] = 0
        out.append(int((y[at] == x).sum()))
    return pa.array(out, pa.int64())


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(x, s, d, link): the symmetric difference of each pair's whole sets, and whether it passes."""
    sent = F.broadcast(pairs) if 32 * pairs.count() <= common.BROADCAST_BYTES else pairs
    # each side goes to its pairs, and the sides meet by pair, so a leader of many pairs is no key
    left = sets.select(F.col("sid").alias("x"), F.col("tokens").alias("a")).join(sent, "x")
    right = sets.select(F.col("sid").alias("s"), F.col("tokens").alias("b")).join(sent, "s")
    both = left.join(right, ["x", "s"])
    total = (F.octet_length("a") + F.octet_length("b")).cast("long") / F.lit(8)
    out = both.select("x", "s", total.cast("long").alias("total"), _overlap("a", "b").alias("o"))
    return out.select("x", "s", (F.col("total") - 2 * F.col("o")).alias("d"), (100 * F.col("o") >= threshold * (F.col("total") - F.col("o"))).alias("link"))


def _pairs(rows: np.ndarray, threshold: int, chunk: int = CHUNK, block: int = BLOCK) -> np.ndarray:
    """Pairs of one run of whole lists that are to be verified; rows: token, lo, hi, own, sid, n, pos, label, lead, d (-1: unknown)."""
    first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
    # lists whose sets have all come together go
    mixed = np.minimum.reduceat(rows[:, 7], first) != np.maximum.reduceat(rows[:, 7], first)
    rows = rows[np.repeat(mixed, np.diff(np.append(first, len(rows))))]
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
    size = np.diff(np.append(first, len(rows)))
    t = threshold

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rows[i], rows[j]
        total = a[:, 5] + b[:, 5]
        ok = (a[:, 7] != b[:, 7]) & ((100 + t) * np.minimum(a[:, 5] - a[:, 6], b[:, 5] - b[:, 6]) >= t * total)
        ok &= (a[:, 1] == a[:, 2]) | (a[:, 3] != b[:, 3])
        far = (a[:, 8] == b[:, 8]) & (a[:, 9] >= 0) & (b[:, 9] >= 0) & ((100 + t) * np.abs(a[:, 9] - b[:, 9]) > (100 - t) * total)
        ok &= ~far
        return np.stack([np.minimum(a[ok, 4], b[ok, 4]), np.maximum(a[ok, 4], b[ok, 4])], 1)

    out = [np.zeros((0, 2), np.int64)]
    group = np.repeat(np.arange(size.size), size)
    small = np.repeat(size <= 16, size)
    for k in range(1, int(size[size <= 16].max(initial=1))):
        i = np.flatnonzero(small[:-k] & small[k:] & (group[:-k] == group[k:]))
        out.append(test(i, i + k))
    for g in np.flatnonzero(size > 16):
        own = np.arange(first[g], first[g] + size[g])
        n, pos = rows[own, 5], rows[own, 6]
        own = own[np.lexsort((pos, (8 * np.log2(n)).astype(np.int64)))]  # by size class, then position
        cut = [own[a : a + block] for a in range(0, own.size, block)]
        least = [int(rows[c, 5].min()) for c in cut]
        rest = [int((rows[c, 5] - rows[c, 6]).max()) for c in cut]
        for a in range(len(cut)):
            for b in range(a, len(cut)):
                if (100 + t) * min(rest[a], rest[b]) < t * (least[a] + least[b]):
                    continue  # no pair of these blocks can pass
                i, j = np.triu_indices(cut[a].size, 1) if a == b else np.indices((cut[a].size, cut[b].size)).reshape(2, -1)
                out.append(test(cut[a][i], cut[b][j]))
    return np.unique(np.concatenate(out), axis=0)


_META = ("token", "lo", "hi", "own", "sid", "n", "pos", "label", "lead", "d")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where its counted rows are few."""
    return F.broadcast(df) if 64 * df.count() <= common.BROADCAST_BYTES else df


def _remaining(lists: DataFrame, answers: DataFrame, labels: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """(x, s): pairs of lists that leaders have not settled, x < s."""
    labels = common.written(labels.select(F.col("node").alias("sid"), F.col("root").alias("label")), "labels")
    known = answers.select(F.col("x").alias("sid"), F.col("s").alias("lead"), "d")
    rows = lists.join(_small(labels), "sid", "left").join(_small(known), ["sid", "lead"], "left")
    rows = rows.withColumns({"label": F.coalesce("label", "sid"), "d": F.when(F.col("sid") == F.col("lead"), 0).otherwise(F.coalesce("d", F.lit(-1))), "parts": F.ceil(F.col("size") / chunk)})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")))
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, len(_META)), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in _META], 1)])
            differ = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1))
            if differ.size:
                end = int(differ[-1]) + 1  # the last list may go on
                yield out(_pairs(rest[:end], threshold))
                rest = rest[end:]
        if len(rest):
            yield out(_pairs(rest, threshold))
        common.release()

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["x", "s"])

    meta = dealt.select(*(F.col(c).cast("long").alias(c) for c in _META))
    found = meta.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(run, "x long, s long").distinct()
    tried = answers.select(F.least("x", "s").alias("x"), F.greatest("x", "s").alias("s"))
    return found.join(tried.distinct(), ["x", "s"], "left_anti")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE, chunk: int = CHUNK, seed: int | None = None, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the table's distinct sets: rows (id, n, sid), sets (sid, least id, copies) and links (u, v) that connect all that are similar as all links would."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold is a percentage")
    spark = common.prepare(docs.sparkSession)
    seed = secrets.randbits(63) if seed is None else seed
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    scan = common.written(_scan(texts, seed, shingle, bits), "shingle-sets", compression="zstd")
    cells = _merged(scan.filter("part is not null").select("part", "cells"), np.add)
    rows = scan.filter("part is null").select("id", "n", "hi", "lo")
    sets = common.written(rows.filter("hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct-sets")
    # sets that share 64 bits (n^2 / 2^65 are to be expected) go by the other half of their digest
    twice = [r["hi"] for r in sets.groupBy("hi").count().filter("count > 1").select("hi").collect()]
    sid = F.when(F.col("hi").isin(twice), F.col("lo")).otherwise(F.col("hi")) if twice else F.col("hi")
    rows, sets = rows.select("id", "n", sid.alias("sid")), sets.select(sid.alias("sid"), "least", "copies")
    heavy = min(max(1 << 16, 8 * int(cells.mean(dtype=np.float64))), MOST)
    sent = spark.sparkContext.broadcast((cells, frozenset(twice)))
    lists = common.written(_lists(_entries(texts, seed, shingle, bits, threshold, sent, heavy), spark, threshold), "index-lists")
    dealt = lists.filter("size = 0")
    if not dealt.isEmpty():
        lists = lists.filter("size > 0").unionByName(common.written(_heavy_lists(dealt, threshold), "heavy-lists"))
    stars = lists.select(F.col("sid").alias("x"), F.explode(F.array("lead", "lead2")).alias("s")).filter("x <> s").distinct()
    stars = common.written(stars, "leader-pairs")
    twice = frozenset(twice)
    both = lambda p: p.select(F.col("x").alias("sid")).unionAll(p.select(F.col("s").alias("sid"))).distinct()
    members = _members(texts, sets, both(stars), seed, shingle, bits, twice)
    answers = common.written(_verified(stars, members, threshold), "answers")
    first = answers.filter("link").select(F.col("x").alias("u"), F.col("s").alias("v"))
    rest = common.written(_remaining(lists, answers, components(first), threshold, chunk), "remaining-pairs")
    more = both(rest).join(members.select("sid"), "sid", "left_anti")
    if not more.isEmpty():  # sets that met no leader
        members = members.unionByName(_members(texts, sets, more, seed, shingle, bits, twice).join(members.select("sid"), "sid", "left_anti"))
    more = common.written(_verified(rest, members, threshold), "more-answers").filter("link").select(F.col("x").alias("u"), F.col("s").alias("v"))
    return rows, sets, first.unionByName(more)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE, chunk: int = CHUNK, seed: int | None = None, bits: int = 64) -> DataFrame:
    """(id_col, n_shingles, component_id), one row a row; component_id is the smallest id that links reach, the row's own included."""
    rows, sets, found = links(docs, id_col, text_col, threshold, shingle, chunk, seed, bits)
    spark = docs.sparkSession
    rooted = sets.join(components(found).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = common.written(rooted.select("sid", "root", "least", "copies"), "rooted-sets")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(rooted.join(least, "root").select("sid", "copies", "component_id"), "named-sets")
    # sets of very many rows, two for each partition at most, go to their rows; other rows go to their sets
    share = max(1000, rows.count() // (2 * common.partitions(spark)))
    hot = F.broadcast(named.filter(F.col("copies") > share).select("sid", "component_id"))
    few = rows.filter("sid is not null").join(hot, "sid", "left_anti").join(named.select("sid", "component_id"), "sid")
    none = rows.filter("sid is null").select("sid", "id", "n", F.col("id").alias("component_id"))
    out = few.unionByName(rows.join(hot, "sid")).unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
