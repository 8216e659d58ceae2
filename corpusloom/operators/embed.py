"""Embeddings through a provider; the default one hashes words and needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import bounded

#: Dimensions of known remote models.
DIMENSIONS = {"text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072}
DEFAULT_DIMENSION = 1536
SIZE = 384
_WORDS = re.compile(r"\w+")


def dimension(model: str) -> int:
    return DIMENSIONS.get(model, DEFAULT_DIMENSION)


def dimensions(model: Column) -> Column:
    """The same for a column of models."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, size in DIMENSIONS.items():
        out = out.when(model == name, size)
    return out.otherwise(DEFAULT_DIMENSION)


def hashing_provider(size: int = SIZE) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of lower-cased words by the first 32 bits of their MD5, unit length; word-less texts give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        found = [_WORDS.findall(t.lower()) for t in texts]
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), np.int64)
        h = np.fromiter((int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) for w in number), np.int64, len(number))[code]  # each word once a batch
        at = np.repeat(np.arange(len(texts)), list(map(len, found))) * size + (h >> 1) % size
        out = np.bincount(at, np.where(h & 1, 1.0, -1.0), len(texts) * size).reshape(-1, size)
        n = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0).astype(np.float32)

    return embed


def embed(docs: DataFrame, text: str, provider: Callable[[list[str]], np.ndarray] | None = None, size: int = SIZE, batch: int = 128, column: str = "embedding", error: str | None = None) -> DataFrame:
    """Adds the vectors.  Blank texts count as one space; a batch that fails gets zeros, and its error in the column `error` if that is named."""
    bounded(docs.sparkSession)
    provider = provider or hashing_provider(size)

    @F.pandas_udf("vector array<float>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out, errors = [], []
            texts = [t if isinstance(t, str) and t.strip() else " " for t in s]
            for k in range(0, len(texts), batch):
                some = texts[k : k + batch]
                try:
                    out += list(np.asarray(provider(some), np.float32))
                    errors += [None] * len(some)
                except Exception as e:  # noqa: BLE001  whatever the provider raises
                    out += list(np.zeros((len(some), size), np.float32))
                    errors += [f"{type(e).__name__}: {e}"] * len(some)
            yield pd.DataFrame({"vector": out, "error": pd.Series(errors, dtype=object)})

    found = docs.withColumn("__found", run.asNondeterministic()(F.col(text)))  # so that it runs once
    columns = {column: F.col("__found")["vector"]} | ({error: F.col("__found")["error"]} if error else {})
    return found.withColumns(columns).drop("__found")


def zeros(size: int = SIZE) -> Column:
    """The stand-in vector of tests."""
    return F.array_repeat(F.lit(0.0).cast("float"), size)


def with_metadata(chunks: DataFrame, model: str, size: int, longest: int) -> DataFrame:
    """The embedding's settings in the metadata map; the chunk's own entries win."""
    own = F.create_map(*map(F.lit, ("embedding_model_id", model, "embedding_size", str(size), "max_input_length", str(longest))))
    keep = F.map_filter(own, lambda k, v: ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), k))
    return chunks.withColumn("metadata", F.map_concat(keep, F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
