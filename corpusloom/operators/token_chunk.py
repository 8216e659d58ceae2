"""Recursive splitting with sizes in a tokenizer's ids.

A word is tokenized once.  The number of tokens that start before each of its
characters is a prefix sum, so the size of any piece is a difference of two
numbers, and sizes of pieces side by side add up exactly.  Pieces that are
joined lie side by side, so a chunk is a pair of places that move over the
text's cuts; no piece is copied or tokenized again.

Defined results: null, empty and blank texts have no chunks; chunks are
stripped, and blank ones left out; n_tokens counts the text's own tokens that
start in the chunk before stripping; a character of several tokens stays
whole, so a single one may exceed a size below its tokens.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusloom.functions import bpe
from corpusloom.operators.chunk import SEPARATORS
from corpusloom.session import bounded


def offsets_before(starts: list[int], length: int) -> np.ndarray:
    """How many tokens start before each place of a text, its end included."""
    return np.append(0, np.cumsum(np.bincount(np.asarray(starts, np.int64), minlength=length)[:length])) if length else np.zeros(1, np.int64)


def _cuts(text: str, a: int, b: int, mark: str) -> list[int]:
    """Places behind each mark in a stretch, with its own ends."""
    if not mark:
        return list(range(a, b + 1))
    out, at = [a], text.find(mark, a, b)
    while at != -1 and at + len(mark) <= b:
        out.append(at + len(mark))
        at = text.find(mark, at + len(mark), b)
    return out if out[-1] == b else [*out, b]


def spans(text: str, size: int, overlap: int, before: Sequence[int] | None = None, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Chunks as (start, end); sizes in tokens by `before`, or in characters without it."""

    def measure(a: int, b: int) -> int:
        return b - a if before is None else int(before[b] - before[a])

    def split(a: int, b: int, marks: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        k = next((i for i, m in enumerate(marks) if not m or text.find(m, a, b) != -1), len(marks) - 1)
        mark = marks[k]
        cut = _cuts(text, a, b, mark)
        low = at = a  # the chunk that is being made starts at `low` and ends at `at`
        starts = [a]  # the cuts in it
        for end in cut[1:]:
            if mark and measure(at, end) > size:
                if at > low:
                    yield low, at
                yield from whole(at, end, marks[k + 1 :] or ("",))
                low, starts = end, []
            else:
                if measure(low, end) > size and at > low:
                    yield low, at
                    # the tail that is repeated: at most `overlap`, and with room for what comes
                    i = next((i for i, s in enumerate(starts) if s > low and measure(s, at) <= overlap and measure(s, end) <= size), None)
                    low = at if i is None else starts[i]
                    starts = [] if i is None else starts[i:]
                starts.append(at)
            at = end
        if at > low:
            yield low, at

    def whole(a: int, b: int, marks: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        if not text[a:b].strip():
            return
        if measure(a, b) <= size:
            yield a, b
        else:
            yield from split(a, b, marks)

    return list(whole(0, len(text), separators))


def fewest(before: Sequence[int], size: int) -> int:
    """How many chunks without overlap a text needs at least."""
    out = at = 0
    while at < len(before) - 1:
        at = max(at + 1, bisect_right(before, before[at] + size) - 1)
        out += 1
    return out


class TokenCounts:
    """How many tokens start before each character of a text, its end included.

    A byte-level tokenizer's ids come from the table of words, and their
    lengths in bytes say where they start; other tokenizers, and texts whose
    lengths do not add up, are asked for the places.
    """

    def __init__(self, path: str):
        self.coder = bpe.CachedBPE(path)
        self.coder.tokenizer.encode_special_tokens = True
        vocabulary = self.coder.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = list(map(len, vocabulary))  # a letter stands for a byte

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.coder.by_word:
            return [self._asked(t) for t in texts]
        return [self._counted(t, np.frombuffer(ids, np.uint32)) for t, ids in zip(texts, self.coder.encode(texts))]

    def _counted(self, text: str, ids: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        end = np.cumsum(self.size[ids])
        if not text or not ids.size or end[-1] != raw.size:
            return self._asked(text)
        start = end - self.size[ids]
        place = start if raw.size == len(text) else (np.cumsum((raw & 0xC0) != 0x80) - 1)[start]
        return offsets_before(place, len(text))

    def _asked(self, text: str) -> np.ndarray:
        return offsets_before([a for a, _ in self.coder.tokenizer.encode(text, add_special_tokens=False).offsets], len(text))


_LOADED: dict[str, TokenCounts] = {}


def tokens_of(path: str) -> TokenCounts:
    if path not in _LOADED:
        _LOADED[path] = TokenCounts(path)
    return _LOADED[path]


def token_chunks(docs: DataFrame, text: str, keep: list[str], tokenizer: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """keep, chunk_index, chunk, start and n_tokens; tokenizer is a file of the tokenizers library."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    bounded(docs.sparkSession)
    more = [StructField("chunk_index", IntegerType()), StructField("chunk", StringType()), StructField("start", LongType()), StructField("n_tokens", LongType())]
    schema = StructType([*(docs.schema[c] for c in keep), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tokens_of(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                some = [(i, t) for i, t in enumerate(part.column("__t").to_pylist()) if t and t.strip()]
                at, rows = [], []
                for (i, t), at_each in zip(some, counts([t for _, t in some])):
                    before = at_each.tolist()  # places are looked up one by one
                    found = [(a, b) for a, b in spans(t, size, overlap, before, separators) if t[a:b].strip()]
                    at += [i] * len(found)
                    rows += [(k, t[a:b].strip(), a, before[b] - before[a]) for k, (a, b) in enumerate(found)]
                own = part.select(keep).take(pa.array(at, pa.int64()))
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *cols], schema.fieldNames())

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, schema)
