"""python -m corpusloom: queries, ingestion, questions, page extraction, training pairs and the cache."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import (
    index_queries,  # noqa: F401  registers its queries
    ingest_queries,  # noqa: F401  registers its queries
    queries,
)
from corpusloom.functions import html, urls
from corpusloom.operators import cache, strategies
from corpusloom.plans import flows
from corpusloom.session import build, shared_path, ship
from corpusloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query", choices=sorted(queries.QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", help="a folder for Parquet; without it twenty rows are shown")
    ingest = sub.add_parser("ingest", help="clean, split and embed documents")
    ingest.add_argument("documents", help="Parquet with doc_id and text")
    ingest.add_argument("out")
    ingest.add_argument("--cleaner", default="web", choices=sorted(strategies.CLEANERS))
    ingest.add_argument("--chunker", default="recursive", choices=sorted((*strategies.COLUMN_CHUNKERS, *strategies.PYTHON_CHUNKERS)))
    ingest.add_argument("--no-cache", action="store_true", help="chunks that are stored in out already are made again, and replace them")
    ask = sub.add_parser("ask", help="questions answered from documents, or from chunks that were ingested")
    ask.add_argument("documents", help="Parquet with doc_id and text, or chunks with embedding")
    ask.add_argument("questions", nargs="?", help="a file with a question on each line")
    ask.add_argument("out", nargs="?", help="a folder for JSON; without it the answers are shown")
    ask.add_argument("--question", help="a single question")
    ask.add_argument("-k", type=int, default=5)
    extract = sub.add_parser("extract", help="title and content of pages")
    extract.add_argument("pages", help="Parquet with url and html")
    extract.add_argument("out")
    pairs = sub.add_parser("pairs", help="instruction pairs of documents")
    pairs.add_argument("documents", help="Parquet with doc_id and text")
    pairs.add_argument("out")
    pairs.add_argument("--format", default="json", choices=["json", "csv", "alpaca"])
    kept = sub.add_parser("cache", help="statistics of a cache table, or what stays of it")
    kept.add_argument("action", choices=["stats", "clear"])
    kept.add_argument("table", help="Parquet as in operators.cache")
    kept.add_argument("--type")
    kept.add_argument("--older-than-hours", type=float)
    kept.add_argument("--out", help="a folder for what stays")
    return p


def _ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = spark.read.parquet(a.documents)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(a.out)
    there = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    stored = spark.read.parquet(a.out) if there else None
    chunks = flows.ingest_by(docs, cleaner=a.cleaner, chunker=a.chunker, stored=None if a.no_cache else stored)
    if stored is None or not a.no_cache:
        chunks.write.mode("append").parquet(a.out)
        return
    # the chunks of these documents are replaced, those of others stay
    path = shared_path(spark, "ingested")
    chunks.unionByName(stored.join(docs.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True).write.parquet(path)
    writers.overwrite(spark.read.parquet(path), a.out)


def _ask(spark: SparkSession, a: argparse.Namespace) -> None:
    chunks = spark.read.parquet(a.documents)
    if "embedding" not in chunks.columns:
        path = shared_path(spark, "chunks")
        writers.overwrite(flows.ingest(chunks), path)
        chunks = spark.read.parquet(path)
    asked = spark.createDataFrame([(a.question,)], "question string") if a.question else readers.questions(spark, a.questions)
    answers = flows.ask(asked.withColumn("query_id", F.xxhash64("question")), chunks.withColumn("vec_id", F.xxhash64("chunk_id")), a.k)
    _out(answers, a.out)


def _out(df: DataFrame, path: str | None) -> None:
    writers.report(df, path) if path else df.show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "ask":
        if a.question and a.questions and not a.out:  # the only place named is the output
            a.questions, a.out = None, a.questions
        if bool(a.question) == bool(a.questions):
            p.error("ask takes a file of questions or --question")
    if a.command == "cache" and a.action == "clear" and not a.out:
        p.error("cache clear needs --out")
    if a.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return
    spark = build(master=a.master)
    if a.command == "run":
        df = queries.QUERIES[a.query](spark, a.tables)
        writers.overwrite(df, a.out) if a.out else df.show()
    elif a.command == "ingest":
        _ingest(spark, a)
    elif a.command == "ask":
        _ask(spark, a)
    elif a.command == "extract":
        ship(spark)
        pages = spark.read.parquet(a.pages)
        writers.overwrite(pages.select("url", html.extract_article(F.col("html"), urls.platform(F.col("url"))).alias("a")).select("url", "a.*"), a.out)
    elif a.command == "pairs":
        writers.pairs(flows.instructions(spark.read.parquet(a.documents), "text", keep="doc_id"), a.out, a.format)
    elif a.action == "stats":
        _out(cache.stats(spark.read.parquet(a.table)), a.out)
    else:
        writers.overwrite(cache.clear(spark.read.parquet(a.table), F.current_timestamp(), a.type, a.older_than_hours), a.out)


if __name__ == "__main__":
    main()
