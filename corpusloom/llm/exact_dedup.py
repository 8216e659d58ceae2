"""Exact dedup by content sort.

The rows are range-partitioned by normalised text, which stands for itself by
its first HEAD characters and a hash, so that the sampled splitters are small
however long the texts are.  Sorting each range by the whole text puts equal
texts next to each other, and neighbours compared whole make up the runs, of
which the best row is kept.

A text with more copies than a share of a range (counted first, by hash,
combined before the shuffle) is hot: a salt deals its copies to several runs,
so that they may lie in several ranges.  There are at most two such texts for
each partition.  The first rows of hot runs are sorted by the whole text again
and neighbours compared, which says what run holds the row that stays.  The
texts move once; SHA-256 is an output and decides nothing.

Defined results: a null text counts as empty; rows with a null doc_id lose
ties against others; repeated doc_ids are rows of their own, and among equal
(length, doc_id) exactly one row is kept.  Other columns of the input stay
out, whatever their names.  An empty table gives no rows.  A text of any
length is one row, compared whole.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

HEAD = 32
#: Copies of a text that never count as many.
FEW = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _runs(docs: DataFrame, id_col: str, text_col: str, few: int, keyed: bool = False) -> DataFrame:
    """A row for each row of docs, sorted by content: what its run says, and the text of a hot run's first row."""
    text = common.field(text_col)
    rows = common.boxed(docs).select(
        common.field(id_col).alias("doc_id"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"), (common.row_key(id_col, text_col) if keyed else F.lit(None).cast("binary")).alias("key"), normalised(text).alias("norm"),
    ).withColumns({"head": F.substring("norm", 1, HEAD), "hash": F.xxhash64("norm")})
    share = docs.count() // (2 * common.partitions(docs.sparkSession))
    hot = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > max(few, share))
    hot = common.written(hot.select("hash", F.ceil(F.col("copies") / max(few, share)).cast("int").alias("runs")), "hot-texts")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("runs")).cast("int")
    dealt = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.when(F.col("runs").isNull(), 0).otherwise(salt))
    spread = dealt.repartitionByRange("head", "hash", "salt")
    own = Window.partitionBy("head", "hash", "salt", "norm")
    order = [F.col("n").desc(), F.col("doc_id").asc_nulls_last()]
    whole = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = spread.withColumns({"place": F.row_number().over(own.orderBy(*order)), "run_keep": F.first("doc_id").over(whole), "run_size": F.count(F.lit(1)).over(whole)})
    # texts of one hash and salt are told apart by their place in the sort
    placed = placed.withColumn("run", F.dense_rank().over(Window.partitionBy("head", "hash", "salt").orderBy("norm")))
    return placed.select(
        "doc_id", "n", "key", "hash", "salt", "run", "place", "run_keep", "run_size", "head", F.col("runs").isNotNull().alias("hot"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when(F.col("runs").isNotNull() & (F.col("place") == 1), F.col("norm")).alias("norm"),
    )


def _keepers(docs: DataFrame, id_col: str, text_col: str, few: int, keyed: bool = False) -> DataFrame:
    """(doc_id, key, keep_id, group_size, kept, text_sha256); key is common.row_key, or null if it is of no use."""
    found = common.written(_runs(docs, id_col, text_col, few, keyed), "content-runs")  # ids and digests: what follows sees no text but those of hot runs' first rows
    run = ["head", "hash", "salt", "run"]
    first = found.filter("norm is not null")
    best = Window.partitionBy("hash", "norm").orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_last(), "salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = first.select(*run, F.first("doc_id").over(best).alias("keep_id"), (F.first("salt").over(best) == F.col("salt")).alias("best"), F.sum("run_size").over(best).alias("group_size"))
    groups = common.written(groups, "hot-runs")  # a few rows for each partition at most
    out = found.join(F.broadcast(groups), run, "left")
    hot = F.col("best").isNotNull()
    return out.select(
        "doc_id", "key", F.when(hot, F.col("keep_id")).otherwise(F.col("run_keep")).alias("keep_id"), F.coalesce("group_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce("best", F.lit(True))).alias("kept"), "text_sha256",
    )


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Of equal texts the row with the longest original stays, then the smallest id.
    few: a text with so many copies or fewer is never dealt to several runs.
    """
    return _keepers(docs, id_col, text_col, few).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """The rows that stay, with their columns; of rows that repeat an id and a text, any one."""
    found = _keepers(docs, id_col, text_col, few, keyed=True)
    return common.keep_rows(docs, id_col, text_col, found.select("key"), found.filter("kept").select("key"))
