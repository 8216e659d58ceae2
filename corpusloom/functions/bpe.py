"""Byte-level BPE with a word table around the ``tokenizers`` library.

The byte-level pre-tokenizer never joins across certain places of a text:
before a space that a visible character follows, at a line break between
visible characters, and at a comma or full stop between a letter and white
space.  Texts are cut there, over all texts of a group at once by array
operations on their bytes.  A piece is known by its length and two
polynomial hashes (96 bits together), whose bases each process draws for
itself, so that no text can be made to collide; a fixed-size hash table gives
its ids, and only pieces that are not in it go to the library, each once a
group.

Texts that hold an added token's string are encoded whole, and so is
everything where the tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Sequence

import numpy as np

#: Slots of the table, 2 to this power; a full table is emptied.
TABLE_BITS = 20
#: Longer pieces are encoded each time.
PIECE_BYTES = 48
#: Texts are encoded in groups of about so many characters, to bound what a group needs.
GROUP_CHARS = 200_000
_PROBES = 16
_LOAD = 0.7


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Lead bytes of U+00C0 to U+023F: all visible, all letters but two.
_LEAD = _class((0xC3, 0xC8))
_OPEN = _class((0x21, 0x7E)) | _LEAD
_ASCII = _class((0x21, 0x7E))
_LETTER = _class((0x41, 0x5A), (0x61, 0x7A))
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True


def _powers(base: int) -> np.ndarray:
    return np.array([pow(base, k, 1 << 64) for k in range(PIECE_BYTES + 1)], np.uint64)


def _base() -> int:
    return int.from_bytes(os.urandom(8), "little") | 5  # odd, and no root of unity of a low order


_P1, _P2 = _powers(_base()), _powers(_base())


def cut(b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts that start at `first`; a zero byte follows each text."""
    n = b.size
    after, before = np.empty_like(b), np.empty_like(b)
    after[:-1], after[-1] = b[1:], 0
    before[1:], before[0] = b[:-1], 0
    starts = (b == 0x20) & _OPEN[after]
    rare = np.flatnonzero((b == 0x0A) | _MARK[b])
    rare = rare[(rare > 1) & (rare < n - 1)]
    c, prev, lead = b[rare], before[rare], _LEAD[b[rare - 2]]
    wide = (prev >= 0x80) & lead
    letter = _LETTER[prev] | wide & ~((b[rare - 2] == 0xC3) & ((prev == 0x97) | (prev == 0xB7)))
    line = (c == 0x0A) & _OPEN[after[rare]] & (_ASCII[prev] | wide)
    mark = (c != 0x0A) & letter & ((after[rare] == 0x20) | (after[rare] == 0x0A))
    starts[rare[line | mark]] = True
    starts[first] = True
    return np.flatnonzero(starts)


class CachedBPE:
    """Encodes texts to little-endian uint32 id bytes, equal to ``Tokenizer.encode``."""

    def __init__(self, path: str, bits: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread its own memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        kind = spec.get("pre_tokenizer") or {}
        self.by_word = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex") and not spec.get("normalizer")
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.lone_x = self.tokenizer.encode(" x", add_special_tokens=False).ids[0]
        self.bits = bits or TABLE_BITS
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.at, self.n = np.zeros(n, np.int32), np.zeros(n, np.uint8)  # a short piece has PIECE_BYTES ids at most
        self.pool, self.used, self.filled = np.zeros(1 << 16, np.uint32), 0, 0

    @staticmethod
    def cut(b: np.ndarray, first: np.ndarray) -> np.ndarray:
        return cut(b, first)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(x) for x in texts]
        out: list[bytes] = []
        first = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size > GROUP_CHARS:
                out += self._group(texts[first : i + 1])
                first, size = i + 1, 0
        return out + self._group(texts[first:])

    def _group(self, texts: Sequence[str]) -> list[bytes]:
        out = [b""] * len(texts)
        own, raw = [], []
        for i, x in enumerate(texts):
            if any(a in x for a in self.added) or "\0" in x:
                out[i] = self.whole(x)
            elif x:
                own.append(i)
                raw.append(x.encode())
        if not own:
            return out
        joined = b"\0".join(raw) + b"\0"
        b = np.frombuffer(joined, np.uint8)
        length = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        first = np.cumsum(length) - length
        start = self.cut(b, first)
        end = np.append(start[1:], b.size)
        piece = np.searchsorted(start, first)  # the first piece of each text
        end[np.append(piece[1:], start.size) - 1] -= 1  # without the zero byte
        at, n = self._ids(joined, b, start, end)
        total = np.cumsum(n)
        if total[-1]:
            ids = self.pool[np.repeat(at - (total - n), n) + np.arange(total[-1])].tobytes()
        else:
            ids = b""
        edge = (4 * np.append(0, total)[np.append(piece, start.size)]).tolist()
        for i, a, z in zip(own, edge, edge[1:]):
            out[i] = ids[a:z]
        return out

    def _ids(self, joined: bytes, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece lie in the pool, and how many they are."""
        size = end - start
        span = np.diff(np.append(start, b.size))
        within = np.arange(b.size) - np.repeat(start, span)
        np.minimum(within, PIECE_BYTES, out=within)
        h = np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _P1[within], start)
        g = np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _P2[within], start)
        h += size.astype(np.uint64)
        h = h ^ (h >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h |= np.uint64(1)  # zero marks an empty slot
        check = (g >> np.uint64(32)).astype(np.uint32)
        short = size <= PIECE_BYTES
        slot = self._find(h, check)
        miss, long = np.flatnonzero((slot < 0) & short), np.flatnonzero(~short)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)  # of no use yet where slot is -1
        if miss.size or long.size:
            order = np.lexsort((check[miss], h[miss]))
            k, c = h[miss][order], check[miss][order]
            differ = np.ones(miss.size, bool)
            differ[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            back = np.empty(miss.size, np.int64)
            back[order] = np.cumsum(differ) - 1
            new = miss[order[differ]]
            if self.filled and self.filled + new.size > _LOAD * (1 << self.bits):
                self.clear()  # and encode all pieces of this group anew
                return self._ids(joined, b, start, end)
            some = np.concatenate([new, long])
            new_at, new_n = self._encode([joined[a:z].decode() for a, z in zip(start[some].tolist(), end[some].tolist())])
            k = new.size
            if self.filled + k <= _LOAD * (1 << self.bits):
                self._put(h[new], check[new], new_at[:k], new_n[:k])
            at[miss], n[miss] = new_at[:k][back], new_n[:k][back]
            at[long], n[long] = new_at[k:], new_n[k:]
        return at, n

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        home = (h >> shift).astype(np.int64)
        out = np.full(h.size, -1, np.int64)
        todo = np.arange(h.size)
        for k in range(_PROBES):
            s = (home[todo] + k) & mask
            key = self.key[s]
            same = (key == h[todo]) & (self.check[s] == check[todo])
            out[todo[same]] = s[same]
            todo = todo[~same & (key != 0)]
            if not todo.size:
                break
        return out

    def _put(self, h: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """New pieces, each once.  One that finds no slot in reach is left out and encoded again when met."""
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        home = (h >> shift).astype(np.int64)
        todo = np.arange(h.size)
        for k in range(_PROBES):
            s = (home[todo] + k) & mask
            free = self.key[s] == 0
            _, one = np.unique(s[free], return_index=True)
            chosen = np.flatnonzero(free)[one]
            i, t = todo[chosen], s[chosen]
            self.key[t], self.check[t], self.at[t], self.n[t] = h[i], check[i], at[i], n[i]
            self.filled += i.size
            rest = np.ones(todo.size, bool)
            rest[chosen] = False
            todo = todo[rest]
            if not todo.size:
                break

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of pieces in the pool."""
        at, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        plain, lines, rest = [], [], []
        for i, p in enumerate(pieces):
            (rest if " " in p[1:] else plain if p[0] == " " else lines if p[0] == "\n" else rest).append(i)
        # pieces in a row: those that start with a space show where they start by their first token
        for lead, part in (("", plain), (" x", lines)):
            skip = int(bool(lead))
            joined = ["".join([lead + pieces[i] for i in part[k : k + 512]]) for k in range(0, len(part), 512)]
            for k, enc in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                group = np.array(part[512 * k : 512 * (k + 1)])
                ids = np.array(enc.ids, np.uint32)
                starts = np.flatnonzero(self.opens[ids])
                if starts.size == group.size and starts[0] == 0 and (not skip or (ids[starts] == self.lone_x).all()):
                    base = self._store(ids)
                    at[group], n[group] = base + starts + skip, np.diff(np.append(starts, ids.size)) - skip
                else:
                    rest += group.tolist()
        for i, enc in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            ids = np.array(enc.ids, np.uint32)
            at[i], n[i] = self._store(ids), ids.size
        return at, n

    def _store(self, ids: np.ndarray) -> int:
        base = self.used
        if base + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(max(self.pool.size, ids.size), np.uint32)])
        self.pool[base : base + ids.size] = ids
        self.used += ids.size
        return base


_LOADED: dict[str, CachedBPE] = {}


def load(path: str) -> CachedBPE:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = CachedBPE(path)
    return _LOADED[path]
