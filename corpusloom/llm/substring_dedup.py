"""Substring dedup with automata of repeated phrases.

Documents are dealt by a hash of doc_id and text into units of about UNIT_BYTES of text, and each
unit is a shard of the automata.

1. A unit hashes its 13-word windows and sends each distinct window once, with
   the smallest doc_id that holds it there, to the window shard of its hash,
   as one compressed block per (unit, shard).  A window that very many
   documents share is one entry a unit, so nothing grows with its copies.
2. A window shard confirms which windows a smaller document in another unit
   holds, and answers each block with one bit an entry.
3. The unit's confirmed windows join to passages.  The distinct passages, cut
   into pieces of at most PIECE words so that the states stay few and the
   matches at a word are bounded, are compiled into Aho-Corasick automata of
   about STATES letters each.  Every document of the unit runs through them
   (all but words that no passage has), and the words that go are those of the occurrences they find of a passage
   that a smaller document precedes; nothing else says where words go.

Windows are judged on the input and known by 64-bit hashes; of N windows a
share of about N / 2**64 meets another by chance.

Defined results: null texts have no words; documents without doc_id count as
larger than all others; rows that repeat a doc_id do not remove each other's
words; an empty table gives no rows.  Columns but doc_id and text are not
read.  A unit is in memory at a time: UNIT_BYTES of text on average, more only
for a text that is longer itself or a (doc_id, text) that repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

WINDOW = 13
PIECE = 32
STATES = 2_000_000
UNIT_BYTES = 8 << 20
#: Text whose windows a window shard gets.
SHARD_BYTES = 16 << 20
#: A word is some letters of so many kinds, since a state's edges are searched one after the other.
_KINDS = 64
_NO_ID = np.iinfo(np.int64).max
_FACTOR = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_FACTOR, n, 1 << 64))


def window_hashes(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of each `window` consecutive word hashes, by doubling."""
    if h.size < window:
        return np.zeros(0, np.uint64)
    out, done, step, k = None, 0, h, 1
    while True:
        if window & k:
            out = step if out is None else out[: h.size - done - k + 1] + _power(done) * step[done : done + h.size - done - k + 1]
            done += k
        if 2 * k > window:
            break
        step = step[:-k] + _power(k) * step[k:]
        k *= 2
    return common.mix(out[: h.size - window + 1])


class Unit:
    """The windows of one unit's documents."""

    def __init__(self, table: pa.Table, window: int):
        from xxhash import xxh64_intdigest

        ids = [_NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.table, self.window = table.take(pa.array(order)), window
        ids = np.array(ids, np.int64)[order]
        self.ids, self.rank = np.unique(ids, return_inverse=True)  # rank: of each row's doc_id
        parts = []
        for t in self.texts():
            w = t.split()
            parts.append(np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w)))
        self.n_words = np.array([p.size for p in parts], np.int64)
        self.first = np.cumsum(self.n_words) - self.n_words
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(parts)), self.n_words)
        h = window_hashes(self.words, window)
        at = np.flatnonzero(self.row[: h.size] == self.row[window - 1 :]) if h.size else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")  # stable: rows are in order of doc_id, so the smallest comes first
        self.at, h = at[order], h[at][order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if h.size else np.zeros(0, bool)
        self.hash, self.run = h[new], np.cumsum(new) - 1
        self.least = self.rank[self.row[self.at[new]]]

    def texts(self):
        for x in self.table.column("text"):
            yield b"" if not x.is_valid else x.as_buffer().to_pybytes()

    def shards(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(shard, first, end) of the sorted windows of each of n window shards that has some."""
        of = (self.hash >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if of.size else np.zeros(0, np.int64)
        yield from zip(of[first].astype(np.int64).tolist(), first.tolist(), np.append(first[1:], of.size).tolist())


def _squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(x.size, -1).T).tobytes())


def _expand(b: bytes, n: int, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(b, max_output_size=n * size)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


_BLOCK = pa.schema([("unit", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("ranks", pa.binary()), ("ids", pa.binary())])
_ANSWER = pa.schema([("unit", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'binary': 'binary', 'string': 'string'})[str(f.type)]}" for f in schema)


def _passages(go: np.ndarray, unit: Unit, limit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first word, words, limit) of pieces that make up each run of removable windows; go and limit by word position."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], go, [False]]).astype(np.int8)))
    span = PIECE - unit.window + 1
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        # windows a..b-1; a run may pass from one document to the next
        while a < b:
            e = min(b, a + span, int(unit.first[unit.row[a]] + unit.n_words[unit.row[a]]) - unit.window + 1)
            yield a, e - a + unit.window - 1, int(limit[a:e].max())
            a = e


def _spelled(code: np.ndarray, names: int) -> tuple[str, int]:
    """Word codes below `names` in letters, and how many letters each has; the letters of each place in a word are others than those of the next."""
    n = 1
    while _KINDS**n < names:
        n += 1
    letters = np.empty((code.size, n), np.uint32)
    for k in range(n):
        letters[:, k] = 0x100 + k * _KINDS + code // _KINDS**k % _KINDS
    return letters.tobytes().decode("utf-32-le"), n


def _stretches(unit: Unit, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first word, end, rank of its document) of all stretches of known words that can hold a window."""
    n = known.size
    if not n:
        return
    new = np.ones(n + 1, bool)
    new[1:-1] = unit.row[1:] != unit.row[:-1]
    before, after = np.concatenate([[False], known[:-1]]), np.concatenate([known[1:], [False]])
    first, end = np.flatnonzero(known & (new[:-1] | ~before)), np.flatnonzero(known & (new[1:] | ~after)) + 1
    long = end - first >= unit.window
    yield from zip(first[long].tolist(), end[long].tolist(), unit.rank[unit.row[first[long]]].tolist())


def _automata(pieces: Iterator[tuple[int, int, int]], text: str, letters: int) -> Iterator[ahocorasick.Automaton]:
    """Automata of the distinct pieces; each gives (words, limit) at the end of an occurrence."""
    machine, used = ahocorasick.Automaton(), 0
    for a, m, top in pieces:
        # a passage that is known already has the same limit, as it has the same windows
        if machine.add_word(text[letters * a : letters * (a + m)], (m, top)):
            used += letters * m
        if used >= STATES:
            machine.make_automaton()
            yield machine
            machine, used = ahocorasick.Automaton(), 0
    if used:
        machine.make_automaton()
        yield machine


def _locate(unit: Unit, found: np.ndarray) -> np.ndarray:
    """Which words are in occurrences of confirmed passages; found: by distinct window, a smaller document elsewhere has it."""
    n = unit.words.size
    limit_of = np.where(found, -1, unit.least)  # a document of a higher rank loses the window
    mine = unit.rank[unit.row[unit.at]] > limit_of[unit.run]
    go, limit = np.zeros(n, bool), np.zeros(n, np.int64)
    go[unit.at[mine]] = True
    limit[unit.at[mine]] = limit_of[unit.run[mine]]
    edge = np.zeros(n + 1, np.int64)
    if mine.any():
        pieces = list(_passages(go, unit, limit))
        part = np.zeros(n + 1, np.int64)
        for a, m, _ in pieces:
            part[a] += 1
            part[a + m] -= 1
        names = np.unique(unit.words[np.cumsum(part)[:n] > 0])
        code = np.minimum(np.searchsorted(names, unit.words), names.size - 1)
        text, letters = _spelled(code, names.size)
        # a word of no passage would put an automaton back to its start, so the stretches between such words run through it
        stretches = list(_stretches(unit, names[code] == unit.words))
        for machine in _automata(iter(pieces), text, letters):
            for a, z, k in stretches:
                for end, (size, top) in machine.iter(text[letters * a : letters * z]):
                    if top < k:
                        e = a + end // letters + 1
                        edge[e - size] += 1
                        edge[e] -= 1
    return np.cumsum(edge)[:n] > 0


def _run(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    spark = common.prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # two units for each partition at least, one after the other, as a unit's windows take several times its text in memory
    units = max(2 * common.partitions(spark), -(-size // UNIT_BYTES))
    parts = max(common.partitions(spark), -(-size // SHARD_BYTES))
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(units)).cast("int")
    rows = docs.select(unit.alias("unit"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        u = Unit(table, window)
        out = []
        for s, a, b in u.shards(parts):
            gap = np.diff(u.hash[a:b], prepend=np.uint64(0))
            ids, rank = np.unique(u.least[a:b], return_inverse=True)
            kind = np.uint16 if ids.size < 1 << 16 else np.uint32
            out.append((key[0].as_py(), s, b - a, _squeeze(gap), _squeeze(rank.astype(kind)), u.ids[ids].tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.to_pylist()
        hashes, least = [], []
        for b in blocks:
            hashes.append(np.cumsum(_expand(b["hashes"], b["n"], np.uint64), dtype=np.uint64))
            ids = np.frombuffer(b["ids"], np.int64)
            least.append(ids[_expand(b["ranks"], b["n"], np.uint16 if ids.size < 1 << 16 else np.uint32)])
        h, d = np.concatenate(hashes), np.concatenate(least)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.minimum.reduceat(d, np.flatnonzero(new))
        before = np.empty(h.size, bool)
        before[order] = first[np.cumsum(new) - 1] < d
        ends = np.cumsum([b["n"] for b in blocks])
        bits = [np.packbits(before[e - b["n"] : e]).tobytes() for b, e in zip(blocks, ends.tolist())]
        return pa.Table.from_arrays([pa.array([b["unit"] for b in blocks], pa.int32()), pa.array([b["shard"] for b in blocks], pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWER)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = _TEXTS if texts else _RESULT
        u = Unit(table, window)
        found = np.zeros(u.hash.size, bool)
        bits = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist()))
        for s, a, b in u.shards(parts):
            found[a:b] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a).astype(bool)
        gone = _locate(u, found)
        ids, removed, kept = u.table.column("doc_id"), [], []
        for t, a, n in zip(u.texts(), u.first.tolist(), u.n_words.tolist()):
            cut = gone[a : a + n]
            removed.append(int(cut.sum()))
            words = t.split()
            text = b" ".join(compress(words, (~cut).tolist()) if removed[-1] else words)
            kept.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
        ids, words, removed, kept = ids.combine_chunks(), pa.array(u.n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())
        return pa.Table.from_arrays([ids, kept, words, removed] if texts else [ids, words, removed, kept], schema=schema)

    blocks = rows.groupBy("unit").applyInArrow(ask, _ddl(_BLOCK))
    answers = blocks.groupBy("shard").applyInArrow(answer, _ddl(_ANSWER))
    return rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(remove, _ddl(_TEXTS if texts else _RESULT))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row."""
    return _run(docs, window, texts=False)


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed): the words that stay, joined by one space."""
    return _run(docs, window, texts=True)
