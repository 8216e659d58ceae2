"""Strategies by name: cleaners, chunkers and embedders, for flows that take them as settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from corpusloom.functions import text as T
from corpusloom.operators import chunk, embed

#: Column -> Column.
CLEANERS: dict[str, Callable[[Column], Column]] = {"web": T.clean_web, "typed": T.clean_typed, "prose": T.clean_prose, "none": T.or_empty}
#: Options -> (Column -> array Column); they stay in the JVM.
COLUMN_CHUNKERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "fixed": lambda size=500, overlap=50: lambda c: chunk.fixed(c, size, overlap),
    "sentences": lambda least=50, most=2000: lambda c: chunk.by_sentences(c, least, most),
    "words": lambda full=800: lambda c: chunk.by_words(c, full),
    "paragraphs": lambda each=3: lambda c: chunk.paragraph_groups(c, each),
    "headings": lambda least=50: lambda c: chunk.heading_sections(c, least),
}
#: Methods of `chunk.python_chunks`.
PYTHON_CHUNKERS = ("recursive", "walk", "two_stage", "tokens")
#: Size -> provider.
EMBEDDERS: dict[str, Callable[[int], Callable]] = {"hashing": embed.hashing_provider}


def register(table: dict[str, Callable], name: str, made: Callable) -> None:
    """Adds a strategy; a name that is taken is an error."""
    if name in table or table is COLUMN_CHUNKERS and name in PYTHON_CHUNKERS:
        raise ValueError(f"{name} is registered already")
    table[name] = made


def find(table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise ValueError(f"{name} is not one of {', '.join(sorted(table))}")
    return table[name]


def chunked(docs: DataFrame, text: str, keep: list[str], name: str, **options) -> DataFrame:
    """keep, chunk_index and chunk by the chunker of that name."""
    if name in PYTHON_CHUNKERS:
        return chunk.python_chunks(docs, text, keep, name, **options).filter("chunk is not null").drop("error")
    return chunk.explode(docs, find(COLUMN_CHUNKERS, name)(**options)(docs[text]), keep)
