"""Statistics and reports as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Title categories by parts of the title, in order.
TITLE_CATEGORIES = (("Education", ("University",)), ("Work Experience", ("Cisco", "KPMG", "Colt", "Visa")), ("Professional Info", ("Skills", "ML Engineer")))


def chunk_stats(chunks: DataFrame, document: str = "doc_id", chunk: str = "chunk") -> DataFrame:
    n = F.char_length(chunk)
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.avg(n).alias("mean_length"), F.countDistinct(document).alias("documents"))


def collection_authors(docs: DataFrame, collection: str, author: str) -> DataFrame:
    return docs.groupBy(collection).agg(F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_set(author)).alias("authors"))


def collection_author_rows(docs: DataFrame, collection: str = "collection", author: str = "author") -> DataFrame:
    """The distinct authors of each collection, a row each, however many they are."""
    return docs.select(F.col(collection).alias("collection"), F.col(author).alias("author")).filter("author is not null").distinct()


def domain_success(crawls: DataFrame, domain: str, ok: str) -> DataFrame:
    return crawls.groupBy(domain).agg(F.sum(F.col(ok).cast("long")).alias("successful"), F.count(F.lit(1)).alias("total"))


def crawl_report(crawls: DataFrame, platform: str, link: str, ok: str) -> DataFrame:
    """By platform: links tried, crawled, and the share crawled; and over all (platform null)."""
    good = F.sum(F.col(ok).cast("long"))
    return crawls.rollup(platform).agg(F.count(F.lit(1)).alias("links"), good.alias("crawled"), F.coalesce(good / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("success_rate"))


def crawled_links(crawls: DataFrame, platform: str, link: str) -> DataFrame:
    """(platform, link, count): each link with its platform's count; a table, as the lists have no bound."""
    counts = crawls.groupBy(platform).agg(F.count(F.lit(1)).alias("count"))
    return crawls.select(platform, link).join(counts, platform)


def title_category(title: Column, rules=TITLE_CATEGORIES, other: str = "Other") -> Column:
    out = F.lit(other)
    for name, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(title, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def counters(docs: DataFrame, kind: str) -> DataFrame:
    """Rows by kind, and over all (kind null)."""
    return docs.rollup(kind).agg(F.count(F.lit(1)).alias("n"))


def file_rollup(results: DataFrame, file: str) -> DataFrame:
    """Documents and chunks by file, and over all."""
    return results.rollup(file).agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"))


def ingest_bucket(kind: Column) -> Column:
    return F.when(kind == "code", "code").when(kind == "article", "article").otherwise("other")


def step_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks made and chunks embedded, over all documents."""
    return chunks.agg(F.count(F.lit(1)).alias("num_chunks"), F.count("embedding").alias("num_embedded"))
