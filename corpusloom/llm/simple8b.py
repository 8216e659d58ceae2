"""Simple-8b: a varying count of ids in each 64-bit word, and a shard format around it.

A word holds a 4-bit selector above 60 bits of payload.  The selector gives a
count and a width with count * width <= 60.  Selector 0 is the escape: the
next word is one value of up to 64 bits.  A block holds BLOCK values and
starts at a word whose offset the header keeps, so all blocks of a shard are
encoded, and decoded, at once with array operations.

Ids enter as ranks by frequency within the shard, so common ids take few
bits; the header keeps the id of each rank.

Shard layout, little-endian: magic "S8B1"; uint32 n_values, n_blocks, n_ids
(dictionary entries), n_words; uint32 ids[n_ids]; uint32 word_offset[n_blocks];
uint64 words[n_words].
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8B1"
BLOCK = 128
#: Fixed values of the format: selector -> (count, width); 0 is the escape.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
_COUNT = np.zeros(16, np.int64)
for _s, (_n, _w) in SELECTORS.items():
    _COUNT[_s] = _n
_COUNT[0] = 1
_WORDS = np.where(np.arange(16) == 0, 2, 1)


_BITS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1))).astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1."""
    top = int(values.max(initial=0))
    if top < 1 << 16:
        return _BITS[values.astype(np.uint16)]
    out = np.ones(values.size, np.uint8)
    for b in range(1, top.bit_length()):
        out += values >= np.uint64(1 << b)
    return out


def _choose(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The selector with most values that fits at each position; left: values from there to its block's end, 255 at most."""
    w = _widths(values)
    reach, last, widest = {1: w}, 1, dict(SELECTORS.values())
    for n in sorted({c for c, _ in SELECTORS.values()})[1:]:
        # n is at most twice the count before it, so two of its spans cover n values
        a, ahead = reach[last], np.full(w.size, 255, np.uint8)
        if n <= w.size:
            ahead[: w.size - (n - last)] = a[n - last :]
        reach[n], last = np.maximum(a, ahead), n
        if not (reach[n] <= widest[n]).any():  # then no longer span fits either
            break
    # where a count fits, so does every smaller one: the number that fit tells the selector
    fit = np.zeros(values.size, np.uint8)
    for n, width in SELECTORS.values():
        if n in reach:
            fit += (reach[n] <= width) & (left >= n)
    best = np.uint8(len(SELECTORS) + 1) - fit
    best[fit == 0] = 0
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = values.size
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    blocks = -(-n // BLOCK)
    at = np.arange(n, dtype=np.int64)
    left = np.minimum(np.minimum((at // BLOCK + 1) * BLOCK, n) - at, 255).astype(np.uint8)
    best = _choose(values, left)
    pos, end = np.arange(blocks, dtype=np.int64) * BLOCK, np.minimum(np.arange(1, blocks + 1, dtype=np.int64) * BLOCK, n)
    block, starts, which = np.arange(blocks), [], []
    while block.size:  # one word of every block that is not at its end
        starts.append(pos)
        which.append(block)
        pos = pos + _COUNT[best[pos]]
        on = pos < end[block]
        pos, block = pos[on], block[on]
    first, block = np.concatenate(starts), np.concatenate(which)
    order = np.argsort(first, kind="stable")
    first, block = first[order], block[order]
    s = best[first]
    size = _WORDS[s]
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), "<u8")
    for k in np.unique(s).tolist():
        rows = np.flatnonzero(s == k)
        if k == 0:
            words[place[rows] + 1] = values[first[rows]]
            continue
        count, width = SELECTORS[k]
        word = np.full(rows.size, k << 60, np.uint64)
        p = first[rows]
        for j in range(count):
            word |= values[p + j] << np.uint64(j * width)
        words[place[rows]] = word
    offsets = place[np.searchsorted(block, np.arange(blocks))].astype("<u4")
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The values of all blocks, walked side by side from their offsets."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    blocks = offsets.size
    block = np.arange(blocks)
    place, pos = offsets.astype(np.int64), np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    places, starts = [], []
    while place.size:
        places.append(place)
        starts.append(pos)
        s = (words[place] >> np.uint64(60)).astype(np.int64)
        place, pos = place + _WORDS[s], pos + _COUNT[s]
        on = pos < end
        place, pos, end = place[on], pos[on], end[on]
    place, pos = np.concatenate(places), np.concatenate(starts)
    s = (words[place] >> np.uint64(60)).astype(np.int64)
    for k in np.unique(s).tolist():
        rows = np.flatnonzero(s == k)
        if k == 0:
            out[pos[rows]] = words[place[rows] + 1]
            continue
        count, width = SELECTORS[k]
        word, p, mask = words[place[rows]], pos[rows], np.uint64((1 << width) - 1)
        for j in range(count):
            out[p + j] = (word >> np.uint64(j * width)) & mask
    return out


def pack(ids: np.ndarray) -> bytes:
    """A shard of ids below 2**32."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max(initial=0)) + 1
    if top <= 1 << 20:
        count = np.bincount(ids, minlength=top)
        used = np.flatnonzero(count)
        used = used[np.argsort(-count[used], kind="stable")]
        rank = np.zeros(top, np.uint64)
        rank[used] = np.arange(used.size, dtype=np.uint64)
        ranks = rank[ids]
    else:
        values, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        used, rank = values[order], np.zeros(values.size, np.uint64)
        rank[order] = np.arange(values.size, dtype=np.uint64)
        ranks = rank[inverse]
    words, offsets = encode(ranks)
    head = np.array([ids.size, offsets.size, used.size, words.size], "<u4")
    return MAGIC + head.tobytes() + used.astype("<u4").tobytes() + offsets.tobytes() + words.tobytes()


def unpack(shard: bytes) -> np.ndarray:
    """The ids of a shard, uint32."""
    if shard[:4] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    n, n_blocks, n_ids, n_words = np.frombuffer(shard, "<u4", 4, 4).tolist()
    at = 20
    used = np.frombuffer(shard, "<u4", n_ids, at)
    at += 4 * n_ids
    offsets = np.frombuffer(shard, "<u4", n_blocks, at)
    at += 4 * n_blocks
    words = np.frombuffer(shard[at : at + 8 * n_words], "<u8")
    return used[decode(words, offsets, n).astype(np.int64)].astype("<u4") if n else np.zeros(0, "<u4")
