"""Cross-tokenizer alignment of a byte-level BPE (A) and a piece model (B).

Both read a text with one space in front of it, which B adds by itself.  Each
token covers a range of bytes; where tokens of both end, a group ends, and the
two tokens that end there are linked.

For each Arrow batch of a partition the tokens of both sides become interval
tables of DuckDB, with the texts one behind the other on one line of offsets.
A join finds the tokens that end together, a window sum numbers the groups,
and an ASOF join takes every token to the first common end at or behind its
own.  Tables hold SLICE tokens a side at a time, cut at a common end, so a
text of any length passes through bounded tables.  Pairs are counted by a
task; Spark adds the partial counts.

Counts go back to the texts' links through the most frequent pairs, at most
TOP of them, which are broadcast; rarer pairs are joined by pair, each once a
text with its multiplicity, so that no pair that many texts hold is a join
key.

Defined results: a null or empty text, and one whose tokens' bytes on either
side are not the text's (a character that stands for the space in B's
vocabulary, say), has no tokens: zeros and an empty string.  Rows with equal
or null doc_id are rows of their own.  Strings of special tokens are plain
text.  Other columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common

#: Tokens of A in DuckDB's tables at a time.
SLICE = 1 << 18
#: Pairs that are broadcast: 17 bytes each.
TOP = 1 << 19
#: Distinct pairs that a task holds before it passes them on.
HELD = 1 << 20
#: The low bits of a pair hold B's id.
B_BITS = 24
SPACE = "▁"
_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, pair long, n long"


class PlainBPE(bpe.CachedBPE):
    """A byte-level tokenizer that reads special tokens' strings as plain text."""

    def __init__(self, path: str, bits: int | None = None):
        super().__init__(path, bits)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    def token_bytes(self) -> list[bytes]:
        from tokenizers.decoders import ByteLevel

        letters = _byte_letters()
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else ByteLevel().decode([token]).encode()
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class CachedPieces(bpe.CachedBPE):
    """A piece model with the word table of CachedBPE.

    No piece holds a space behind another character, so texts are cut before
    spaces that follow one; without that property texts are encoded whole.
    A text comes with the space in front that the model itself would add.
    """

    def __init__(self, path: str, bits: int | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.added = [SPACE]  # a text that holds the sign itself is encoded whole
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.lone = self.model.piece_to_id(SPACE)
        self.bits = bits or bpe.TABLE_BITS
        self.clear()

    @staticmethod
    def cut(b: np.ndarray, first: np.ndarray) -> np.ndarray:
        starts = b == 0x20
        starts[1:] &= b[:-1] != 0x20
        starts[first] = True
        return np.flatnonzero(starts)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text[1:], num_threads=1), np.uint32).tobytes()

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for i, ids in enumerate(self.model.encode([p[1:] for p in pieces], num_threads=1)):
            ids = np.array(ids if pieces[i] != " " else [self.lone], np.uint32)
            at[i], n[i] = self._store(ids), ids.size
        return at, n

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]


class Side:
    """One tokenizer: ids of texts, and the bytes of its tokens."""

    def __init__(self, coder: bpe.CachedBPE):
        self.coder = coder
        raw = coder.token_bytes()
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        digits = [str(i).encode() for i in range(len(raw))]
        self.width = np.fromiter(map(len, digits), np.int64, len(raw))
        self.digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in digits), np.uint8).reshape(-1, 8)

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32) for x in self.coder.encode(texts)]

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens' bytes are the text's."""
        n = self.size[ids]
        end = np.cumsum(n)
        if not ids.size or end[-1] != len(raw):
            return False
        for a in range(0, ids.size, SLICE):  # bounded memory for very long texts
            z = min(ids.size, a + SLICE)
            low = int(end[a] - n[a])
            at = np.repeat(self.start[ids[a:z]] - (end[a:z] - n[a:z]), n[a:z]) + np.arange(low, int(end[z - 1]))
            if self.pool[at].tobytes() != raw[low : int(end[z - 1])]:
                return False
        return True


_SIDES: dict[tuple[str, str], Side] = {}


def side(kind: type, path: str) -> Side:
    """One a worker process and file."""
    if (kind.__name__, path) not in _SIDES:
        _SIDES[kind.__name__, path] = Side(kind(path))
    return _SIDES[kind.__name__, path]


class Aligner:
    """Interval tables and joins over the tokens of one task."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        self.db.execute("create table counts (pair bigint, n bigint)")
        

    def groups(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the (ids, ends) of both sides: the group of each token of A and of B, -1 behind the last common end, and the pair of each group's link."""
        db = self.db
        for name, (ids, end) in (("a", a), ("b", b)):
            db.register(name, pa.table({"id": ids.astype(np.int64), "e": end, "k": np.arange(ids.size)}))
        db.execute("create or replace temp table met as select e, sum(1) over (order by e rows between unbounded preceding and current row)::bigint - 1 as g, pair "
                   f"from (select a.e, (a.id << {B_BITS}) | b.id as pair from a join b on a.e = b.e)")  # fmt: skip
        pairs = db.sql("select pair from met order by g").to_arrow_table().column(0).to_numpy()
        out = [db.sql(f"select coalesce(g, -1) as g from {t} asof left join met on {t}.e <= met.e order by k").to_arrow_table().column(0).to_numpy() for t in ("a", "b")]
        db.execute("insert into counts select pair, count(*) from met group by pair")
        for t in ("a", "b"):
            db.unregister(t)
        return out[0], out[1], pairs

    def counts(self, least: int = 0) -> pa.Table | None:
        """What was counted so far, if it is at least so many rows; it is then forgotten."""
        if self.db.execute("select count(*) from counts").fetchall()[0][0] < max(1, least):
            return None
        got = self.db.sql("select pair, sum(n)::bigint as n from counts group by pair").to_arrow_table()
        self.db.execute("delete from counts")
        if got.num_rows < least // 2:  # mostly repeats: they stay
            self.db.register("got", got)
            self.db.execute("insert into counts select * from got")
            self.db.unregister("got")
            return None
        return got


def _written(a: Side, b: Side, ia: np.ndarray, ib: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` for each group, as bytes, and where each group's end."""
    n = int(ga[-1]) + 1
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    place = np.empty(ia.size + ib.size, np.int64)  # of the tokens in the order written
    pa_, pb = np.arange(ia.size) + (np.cumsum(nb) - nb)[ga], np.arange(ib.size) + np.cumsum(na)[gb]
    place[pa_], place[pb] = np.arange(ia.size), ia.size + np.arange(ib.size)
    sign = np.full(place.size, ord(","), np.uint8)
    last_a, last_b = np.cumsum(na + nb) - nb - 1, np.cumsum(na + nb) - 1
    sign[last_a], sign[last_b] = ord("|"), ord(";")
    digits = np.concatenate([a.digits[ia], b.digits[ib]])[place]
    width = np.concatenate([a.width[ia], b.width[ib]])[place]
    digits[np.arange(place.size), width] = sign
    flat = digits[np.arange(digits.shape[1])[None, :] <= width[:, None]]
    return flat, np.cumsum(width + 1)[last_b]


class _Docs:
    """The aligned texts of a batch, fed slice by slice."""

    def __init__(self, n: int, keep: bool):
        self.sha, self.links, self.n_groups = [None] * n, [[] for _ in range(n)], np.zeros(n, np.int64)
        self.text = [[] for _ in range(n)] if keep else None

    def add(self, doc: int, chunk: bytes, pairs: np.ndarray, last: bool) -> None:
        if self.sha[doc] is None:
            self.sha[doc] = hashlib.sha256()
        chunk = chunk[:-1] if last else chunk
        self.sha[doc].update(chunk)
        if self.text is not None:
            self.text[doc].append(chunk)
        self.links[doc].append(pairs)
        self.n_groups[doc] += pairs.size


def _align(a: Side, b: Side, own: Aligner, texts: list[str], keep: bool, tokens: int = SLICE) -> tuple[np.ndarray, np.ndarray, _Docs]:
    spaced = [" " + x if x else "" for x in texts]
    ids_a, ids_b = a.ids(spaced), b.ids(spaced)
    good = [bool(x) and a.spells(ids_a[k], raw := x.encode()) and b.spells(ids_b[k], raw) for k, x in enumerate(spaced)]
    n_a = np.array([ids_a[k].size if g else 0 for k, g in enumerate(good)], np.int64)
    n_b = np.array([ids_b[k].size if g else 0 for k, g in enumerate(good)], np.int64)
    out = _Docs(len(texts), keep)
    some = np.flatnonzero(n_a)
    if not some.size:
        return n_a, n_b, out
    ia, ib = np.concatenate([ids_a[k] for k in some]), np.concatenate([ids_b[k] for k in some])
    del ids_a, ids_b
    ea, eb = np.cumsum(a.size[ia]), np.cumsum(b.size[ib])
    doc_end = ea[np.cumsum(n_a[some]) - 1]  # each text's end on the line
    at = bt = 0
    while at < ia.size:
        size = tokens
        while True:
            z = min(ia.size, at + size)
            y = int(np.searchsorted(eb, ea[z - 1], "right"))
            ga, gb, pairs = own.groups((ia[at:z], ea[at:z]), (ib[bt:y], eb[bt:y]))
            if pairs.size:
                break
            size *= 2  # a group beyond the slice
        ka, kb = int(np.searchsorted(ga == -1, True)), int(np.searchsorted(gb == -1, True))
        flat, ends = _written(a, b, ia[at : at + ka], ib[bt : bt + kb], ga[:ka], gb[:kb])
        group_end = ea[at:z][:ka][np.flatnonzero(np.diff(np.append(ga[:ka], pairs.size)))]  # where each group ends on the line
        doc = np.searchsorted(doc_end, group_end)  # the text of each group
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for f, g in zip(first, np.append(first[1:], doc.size)):
            chunk = flat[ends[f - 1] if f else 0 : ends[g - 1]].tobytes()
            out.add(int(some[doc[f]]), chunk, pairs[f:g], bool(group_end[g - 1] == doc_end[doc[f]]))
        at, bt = at + ka, bt + kb
    return n_a, n_b, out


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, tokens: int = SLICE) -> DataFrame:
    """Rows of two kinds: texts (pair is null) with their groups and links, and partial counts of pairs (pair, n).

    links holds a text's links in order, eight bytes each, little-endian: A's
    id above the low B_BITS bits of B's.  groups is there if it is kept.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, own = side(PlainBPE, path_a), side(CachedPieces, path_b), Aligner()
        row = TaskContext.get().partitionId() << 40

        def counted(least: int) -> Iterator[pa.RecordBatch]:
            got = own.counts(least)
            for part in got.to_batches() if got is not None else ():
                yield _rows(part.num_rows, pair=part.column("pair"), n=part.column("n"))

        for batch in batches:
            texts = common.texts(batch.column("text"))
            n_a, n_b, found = _align(a, b, own, texts, keep_groups, tokens)
            yield _rows(
                len(texts), row=pa.array(range(row, row + len(texts)), pa.int64()), doc_id=batch.column("doc_id"), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(found.n_groups), n_links=pa.array(found.n_groups),
                groups_sha256=pa.array([x.hexdigest() if x else "" for x in found.sha]), links=pa.array([np.concatenate(x).tobytes() if x else b"" for x in found.links], pa.binary()),
                groups=pa.array([b"".join(x).decode() for x in found.text]) if keep_groups else None,
            )
            row += len(texts)
            yield from counted(HELD)
        yield from counted(1)
        common.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _ROW)


def _rows(size: int, **columns: pa.Array | None) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in _ROW.split(", ")]
    arrays = [columns[c].cast(kinds[k]) if columns.get(c) is not None else pa.nulls(size, kinds[k]) for c, k in names]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in names])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): each pair's links in the corpus, and whether no pair of its B id has more."""
    counts = aligned.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(docs: DataFrame, path_a: str, path_b: str, top: int = TOP, tokens: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a text."""
    spark = docs.sparkSession
    aligned = common.written(align(docs, path_a, path_b, tokens=tokens), "aligned", compression="zstd")
    counts = common.written(pair_counts(aligned), "pair-counts")
    table = counts.orderBy(F.desc("n"), "pair").limit(top).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = spark.sparkContext.broadcast((table.column("pair").to_numpy()[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
    rare = counts.count() > top
    texts = aligned.filter("pair is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            out = []
            for x in batch.column("links").to_pylist():
                own = np.frombuffer(x, np.int64)
                at = np.minimum(np.searchsorted(pairs, own), max(0, pairs.size - 1))
                hit = pairs[at] == own if pairs.size else np.zeros(own.size, bool)
                more, times = np.unique(own[~hit], return_counts=True)
                out.append((int(n[at[hit]].sum()), int(best[at[hit]].sum()), more.tolist(), times.tolist()))
            columns = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            for k, (c, kind) in enumerate((("count_sum", pa.int64()), ("n_best", pa.int64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())))):
                columns[c] = pa.array([x[k] for x in out], kind)
            yield pa.RecordBatch.from_pydict(columns)

    found = texts.mapInArrow(sums, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long, rare array<long>, times array<long>")
    if rare:
        found = common.written(found, "aligned-sums")
        links = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
        rest = links.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        found = found.join(rest, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
