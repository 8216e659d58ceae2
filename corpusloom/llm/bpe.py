"""The core's word table around the ``tokenizers`` library."""

from corpusloom.functions.bpe import GROUP_CHARS, PIECE_BYTES, TABLE_BITS, CachedBPE, cut, load

__all__ = ["GROUP_CHARS", "PIECE_BYTES", "TABLE_BITS", "CachedBPE", "cut", "load"]
