"""Incremental ingestion and event windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 100, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).options(**options).option("maxFilesPerTrigger", per_trigger).load(path)


def new_links(stream: DataFrame, at: str = "ts", link: str = "link", late: str = "1 hour") -> DataFrame:
    """Each link once within the time that late rows may take."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([link])


def windows(events: DataFrame, every: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; works on streams and tables."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def transform(stream: DataFrame, column: str, rule: Callable[[Column], Column]) -> DataFrame:
    return stream.withColumn(column, rule(F.col(column)))


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str, order: Column | None = None, name: str = "stream", compact_every: int = 20):
    """Each batch's last row for a key (by `order`, such as the event time) replaces the stored one; a batch that is run again changes nothing.

    A batch adds its own rows to a log (operators.log_store), which is folded
    every `compact_every` batches, and what is then of no use goes.  Read the
    table by latest_version().
    """
    from corpusloom.operators.log_store import Log

    def write(batch: DataFrame, n: int) -> None:
        log = Log(batch.sparkSession, path, key)
        if log.write(batch, order, name, n) and n % compact_every == compact_every - 1:
            log.compact()
            log.vacuum()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest rows of a log; None before the first batch."""
    from corpusloom.operators.log_store import Log

    log = Log(spark, path, "")
    m = log.manifest()
    return Log(spark, path, m.key).read() if m.schema else None
