"""Whole flows: ingestion, feature engineering, retrieval and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chunk, clean, datasets, embed, rag, store, strategies, vector_store


def ingest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 800, overlap: int = 200, stored: DataFrame | None = None) -> DataFrame:
    """Clean, split recursively, embed; chunks already stored by content are left out."""
    return ingest_by(docs, text, doc_id, chunk_options={"size": size, "overlap": overlap}, stored=stored)


def ingest_by(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cleaner: str = "web", chunker: str = "recursive", embedder: str = "hashing", chunk_options: dict | None = None, dimension: int = embed.SIZE, stored: DataFrame | None = None) -> DataFrame:
    """The same by strategies' names.  Texts that a chunker fails on have no chunks; ingest_errors has them."""
    cleaned = docs.select(doc_id, strategies.find(strategies.CLEANERS, cleaner)(F.col(text)).alias("clean"))
    chunks = chunk.with_ids(strategies.chunked(cleaned, "clean", [doc_id], chunker, **(chunk_options or {})), doc_id)
    if stored is not None:
        chunks = store.not_seen(chunks, stored, "content_hash")
    return embed.embed(chunks, "chunk", strategies.find(strategies.EMBEDDERS, embedder)(dimension), dimension)


def ingest_errors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cleaner: str = "web", chunker: str = "recursive", chunk_options: dict | None = None) -> DataFrame:
    """(doc_id, error): the texts that the chunker failed on."""
    cleaned = docs.select(doc_id, strategies.find(strategies.CLEANERS, cleaner)(F.col(text)).alias("clean"))
    if chunker not in strategies.PYTHON_CHUNKERS:  # columns do not fail
        return cleaned.select(doc_id, F.lit(None).cast("string").alias("error")).limit(0)
    return chunk.python_chunks(cleaned, "clean", [doc_id], chunker, **(chunk_options or {})).filter(F.col("error").isNotNull()).select(doc_id, "error")


def features(names: DataFrame, users: DataFrame, articles: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Authors' articles, cleaned, split and embedded."""
    docs = clean.feature_documents(store.author_articles(names, users, articles))
    chunks = chunk.python_chunks(docs.withColumnRenamed("id", "doc_id"), "text", ["doc_id", "author_id"], "recursive", size=size, overlap=overlap)
    return embed.embed(chunk.with_ids(chunks.filter(F.col("chunk").isNotNull())), "chunk")


def ask(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """questions (query_id, question) answered from embedded chunks (vec_id, chunk, embedding).

    The chunks are read twice, for the search and for the hits' texts: give a written table.
    """
    queries = embed.embed(questions, "question")
    hits = vector_store.search_many(chunks, queries.select("query_id", "embedding"), k)
    found = hits.join(chunks.select("vec_id", F.col("chunk").alias("text")), "vec_id")
    return rag.answers(found, questions)


def instructions(articles: DataFrame, content: str = "content", share: float = 0.1, keep: str = "id") -> DataFrame:
    """Extracts, rule-based pairs and a split by hash."""
    pieces = articles.select(keep, F.posexplode(chunk.extracts(F.col(content))).alias("piece", "extract"))
    pairs = pieces.select(keep, "piece", F.inline(datasets.rule_pairs(F.col("extract"))))
    return datasets.split(pairs.withColumn("key", F.concat_ws(":", keep, "piece", "instruction")), "key", share)
