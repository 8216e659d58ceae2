"""A cache of fetched content as a table: (cache_key, url, content_type, cached_at, bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import cache_key
from corpusloom.operators.store import upsert

HOURS = 24.0


def age_hours(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp_ltz")) - F.unix_micros(at.cast("timestamp_ltz"))) / 3.6e9


def fresh(at: Column, now: Column, hours: float = HOURS) -> Column:
    return F.coalesce(age_hours(at, now) < hours, F.lit(False))


def look_up(requests: DataFrame, cache: DataFrame, now: Column, hours: float = HOURS) -> DataFrame:
    """requests (content_type, url) with hit: whether a fresh entry is there."""
    keyed = requests.withColumn("cache_key", cache_key(F.col("content_type"), F.col("url")))
    return keyed.join(cache.select("cache_key", "cached_at"), "cache_key", "left").withColumn("hit", fresh(F.col("cached_at"), now, hours))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(cache, new.withColumn("cache_key", cache_key(F.col("content_type"), F.col("url"))), "cache_key")


def clear(cache: DataFrame, now: Column, content_type: str | None = None, older_than_hours: float | None = None) -> DataFrame:
    """What stays: entries of other types, or younger ones."""
    go = F.lit(True)
    if content_type is not None:
        go = go & F.col("content_type").eqNullSafe(F.lit(content_type))
    if older_than_hours is not None:
        go = go & F.coalesce(age_hours(F.col("cached_at"), now) >= older_than_hours, F.lit(False))
    return cache.filter(~go)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("total_entries"), F.count_if(F.col("content_type") == "github").alias("github_entries"), F.count_if(F.col("content_type") == "article").alias("article_entries"),
        F.round(F.sum("bytes") / (1 << 20), 2).alias("cache_size_mb"), F.min_by("url", F.struct("cached_at", "url")).alias("oldest_entry"), F.max_by("url", F.struct("cached_at", "url")).alias("newest_entry"),
    )
