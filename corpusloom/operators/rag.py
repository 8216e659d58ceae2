"""Retrieval results as prompt context and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

NOTHING = "No relevant documents found."
UNKNOWN_SOURCE = "Unknown source"
#: Labels of source fields, in order.
SOURCE_FIELDS = (("Repo", "repository_name"), ("File", "file_path"), ("Title", "title"), ("URL", "url"))


def source(df: DataFrame) -> Column:
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in SOURCE_FIELDS if c in df.columns]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit(UNKNOWN_SOURCE)) if parts else F.lit(UNKNOWN_SOURCE)


def context_part(df: DataFrame) -> Column:
    return F.concat(
        F.lit("\nDocument "), F.col("rank").cast("string"), F.lit(" (Score: "), F.format_string("%.3f", F.col("score")), F.lit(")\nSource: "), source(df), F.lit("\nContent: "), T.or_empty(F.col("text")), F.lit("\n---")
    )


def _ranked(results: DataFrame, question: str) -> DataFrame:
    """(question, n, context, sources): the ranked hits of each question, as one text and as rows; hits are taken once for both."""
    text = T.truncate(T.or_empty(F.col("text")), 200, always=True)
    hit = F.struct("rank", context_part(results).alias("c"), text.alias("text"), F.col("score"))
    hits = results.groupBy(question).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(hit)).alias("hits"))
    context = F.array_join(F.transform("hits", lambda h: h["c"]), "\n")
    return hits.select(question, "n", context.alias("context"), F.transform("hits", lambda h: F.struct(h["rank"].alias("rank"), h["text"].alias("text"), h["score"].alias("score"))).alias("sources"))


def contexts(results: DataFrame, questions: DataFrame | None = None, question: str = "query_id") -> DataFrame:
    """(question, n, context): the ranked hits of each question as one text; questions without hits say so."""
    out = _ranked(results, question).select(question, "n", "context")
    if questions is not None:
        out = questions.select(question).join(out, question, "left").select(question, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("context", F.lit(NOTHING)).alias("context"))
    return out


def answers(results: DataFrame, questions: DataFrame, question: str = "query_id", text: str = "question") -> DataFrame:
    """The whole result of each question; without a language model the answer repeats the context."""
    found = questions.join(_ranked(results, question), question, "left")
    context = F.coalesce("context", F.lit(NOTHING))
    return found.select(question, text, F.coalesce("n", F.lit(0)).alias("context_documents"), context.alias("context"), F.concat(F.lit("Based on the available context:\n\n"), context).alias("answer"), "sources")
