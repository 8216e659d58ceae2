"""SimHash near-dedup: fingerprints, pivot distance tables and linked groups.

A bit of a fingerprint is 1 if it is set in over half the XXH64 hashes of a
text's word shingles.  Equal fingerprints collapse first, by an aggregation
that combines before its shuffle.

Distinct fingerprints are then linked.  A table of the Hamming distances of
each to N_PIVOTS reference fingerprints (pivots) is computed once and goes
with it; by the triangle inequality a pair whose tables differ by more than
the radius at any pivot is no link, and only pairs that pass are compared bit
by bit.  Pivots over all 64 bits cannot say alone where to look (README has
figures), so pairs to be tested are those that agree in two of six bit
blocks: of six blocks at most `radius` = 4 can hold a differing bit, so every
link agrees in two.  The more fingerprints, the more blocks: three of seven,
and so on up to six of ten, chosen by their measured number so that a bucket
stays small.  A
bucket is one choice of such blocks and their bits.  Large buckets are cut
into chunks by a hash, and each pair of chunks is a task of bounded size, so
a bucket that holds a large share of all rows is spread too.

In a bucket, sorted by the first pivot's distance, links are followed with a
shrinking set of fingerprints not yet reached, and only the edges of the resulting trees leave
the task; groups of copies are never expanded into pairs.

Defined results: texts without words have fingerprint zero and are linked
like any other; null counts as empty; each row of the input, repeated or not,
gives one row; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints that one is tested against by chance, on average, at most; more blocks are taken as fingerprints grow in number.
PAIRS = 2.0
N_PIVOTS = 16
CHUNK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's lower-cased words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = len(words) - shingle + 1
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        b = min(n, a + (1 << 16))
        spans = map(slice, start[a:b].tolist(), end[a + shingle - 1 : b + shingle - 1].tolist())
        h = np.fromiter((xxh64_intdigest(joined[s], seed) for s in spans), "<u8", b - a)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprinted(spark: SparkSession, shingle: int = SHINGLE, seed: int = SEED):
    """A column function of binary texts: the fingerprint as a signed long.  Nothing else of a row goes to Python."""
    common.prepare(spark)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in common.raw_texts(batch)], np.uint64)
            yield pa.array(fp.view(np.int64))
        common.release()

    return run


def blocks(n: int) -> list[int]:
    """Masks that cut 64 bits into n blocks."""
    edges = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return common.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fp: str = "fp") -> Column:
    """The distances of a fingerprint to all pivots, one byte each."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.bit_count(F.col(fp).bitwiseXOR(F.lit(int(p))))), 2, "0")) for p in pivots().view(np.int64)))


def survive(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of pivot tables' rows differ by at most radius at every pivot; others are no links."""
    return np.maximum(a, b).__isub__(np.minimum(a, b)).max(axis=1) <= radius


def trees(fp: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of trees that span the links among distinct fingerprints; table: their distances to the pivots."""
    n = fp.size
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first = table[:, 0].astype(np.int64)
    left = np.arange(n)
    edges = []
    queue: list[int] = []
    while left.size:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        a, b = np.searchsorted(first[left], (first[at] - radius, first[at] + radius + 1))  # only these can pass at the first pivot
        near = left[a:b]
        near = near[survive(table[near], table[at][None, :], radius)]
        near = near[np.bitwise_count(fp[near] ^ fp[at]) <= radius]
        if near.size:
            queue += near.tolist()
            edges += [(int(order[at]), int(order[x])) for x in near.tolist()]
            left = left[~np.isin(left, near, assume_unique=True)]
    return edges


def _links(key: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one sorted run of buckets, small ones side by side and large ones as trees."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    us, vs = [], []
    small = size <= 16
    group = np.repeat(np.arange(size.size), size)
    ok = np.repeat(small, size)
    for k in range(1, int(size[small].max(initial=1))):
        a = np.flatnonzero(ok[:-k] & ok[k:] & (group[:-k] == group[k:]))
        if not a.size:
            break
        a = a[survive(table[a], table[a + k], radius)]
        x, y = fp[a], fp[a + k]
        link = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        us.append(x[link])
        vs.append(y[link])
    for g in np.flatnonzero(~small).tolist():
        own, at = np.unique(fp[first[g] : first[g] + size[g]], return_index=True)
        e = np.array(trees(own, table[first[g] + at], radius), np.int64).reshape(-1, 2)
        us.append(own[e[:, 0]])
        vs.append(own[e[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def block_count(n: int, radius: int = RADIUS, most: float = PAIRS) -> int:
    """The fewest blocks with which n random fingerprints are tested against at most `most` others each; six beyond the radius at most."""
    for agree in range(2, 6):
        blocks = radius + agree
        if n * math.comb(blocks, agree) <= most * 2.0 ** (64 * agree // blocks):
            return blocks
    return radius + 6


def link(distinct: DataFrame, radius: int = RADIUS, n_blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(u, v): edges that connect distinct fingerprints as their links within radius do; distinct has fp and its pivot_table as `table`."""
    n_blocks = n_blocks or block_count(distinct.count(), radius)
    agree = n_blocks - radius
    if agree < 1:
        raise ValueError("n_blocks must exceed radius")
    masks = [sum(m) for m in combinations(blocks(n_blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)]))
    rows = distinct.select("fp", "table", key.alias("k")).select("k.b", "k.bits", "fp", "table")
    # buckets beyond one chunk, with the number of chunks they are cut into; counted before the shuffle
    large = rows.groupBy("b", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk).select("b", "bits", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    large = common.written(large, "large-buckets")
    cut = rows.join(F.broadcast(large) if 64 * large.count() <= common.BROADCAST_BYTES else large, ["b", "bits"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    # every pair of chunks, and so every pair of rows, meets once
    dealt = cut.select("b", "bits", "fp", "table", "own", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("with")).select(
        "b", "bits", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "fp", "table"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("b", "bits", "lo", "hi", "fp")], 1)
            table = np.frombuffer(b"".join(batch.column("table").to_pylist()), np.uint8).reshape(len(rows), -1)
            if rest is not None:
                rows, table = np.concatenate([rest[0], rows]), np.concatenate([rest[1], table])
            differ = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            end = int(differ[-1]) + 1 if differ.size else 0  # the last bucket may go on
            rest = rows[end:], table[end:]
            if end:
                yield pairs(rows[:end], table[:end])
        if rest is not None:
            yield pairs(*rest)

    def pairs(rows: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        u, v = _links(rows[:, :4], np.ascontiguousarray(rows[:, 4]).view(np.uint64), table, radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    bucket = ["b", "bits", "lo", "hi"]
    return dealt.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(run, "u long, v long")


def _grouped(rows: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, n, least, root) of each distinct fingerprint of rows: how many rows, the smallest id, the group's root."""
    counted = rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = common.written(counted.withColumn("table", pivot_table()), "simhash-distinct")
    roots = components(link(distinct.select("fp", "table"), radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: the id, fp, component_id.

    component_id is the smallest id that links reach, the row's own included.
    """
    spark = docs.sparkSession
    text = common.field("text").cast("binary")
    rows = common.written(common.boxed(docs).select(common.field(id_col).alias(id_col), fingerprinted(spark, shingle, seed)(text).alias("fp")), "simhash")
    groups = _grouped(rows, id_col, radius)
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(groups.join(least, "root").select("fp", "n", "component_id"), "simhash-named")
    # fingerprints of very many rows, two for each partition at most, go to their rows; other rows go to their fingerprints
    share = max(1000, rows.count() // (2 * common.partitions(spark)))
    hot = F.broadcast(named.filter(F.col("n") > share).select("fp", "component_id"))
    few = rows.join(hot, "fp", "left_anti").join(named.select("fp", "component_id"), "fp")
    return few.unionByName(rows.join(hot, "fp")).select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of linked documents, that of the smallest id, with its columns.

    Rows without an id come after all others; of rows that repeat the smallest
    id, the one with the smallest fingerprint stays.
    """
    spark = docs.sparkSession
    text = common.field("text").cast("binary")
    rows = common.boxed(docs).select(
        common.field(id_col).alias("id"), common.row_key(id_col, "text").alias("key"), fingerprinted(spark, shingle)(text).alias("fp")
    )
    rows = common.written(rows, "simhash-rows")  # ids, keys and fingerprints; no text
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "key")).alias("first"))
    best = _grouped(rows, "id", radius).select("fp", "root").join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return common.keep_rows(docs, id_col, "text", rows.select("key"), best.select("first.key"))


def hex_digits(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
