"""Document collections as tables: lookups, upserts, joins by link and author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(df: DataFrame, **values) -> Column:
    """AND of equalities; a column that is missing is null, and null equals null."""
    out = F.lit(True)
    for k, v in values.items():
        out = out & (F.col(k).eqNullSafe(F.lit(v)) if k in df.columns else F.lit(v is None))
    return out


def find_all(df: DataFrame, **values) -> DataFrame:
    return df.filter(matches(df, **values))


def find(df: DataFrame, order: str, **values) -> DataFrame:
    """The first match by insertion order."""
    return find_all(df, **values).orderBy(order).limit(1)


def hash_id(*columns: str) -> Column:
    """A stable id from natural keys."""
    return F.md5(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def get_or_create(df: DataFrame, order: str, **values) -> DataFrame:
    """The first match, or a new row with a stable id; nothing is saved."""
    spark = df.sparkSession
    want = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    new = want.withColumn("id", hash_id(*values))
    found = find(df, order, **values)
    return found.select(*new.columns).withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1))).orderBy("__n").limit(1).drop("__n")


def get_or_create_each(df: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """Each distinct row of `wanted` with the id of its first match, or with a stable new one; null equals null, nothing is saved."""
    keys = wanted.columns
    found = latest(df, keys, F.col(order).asc_nulls_last()).select(*(F.col(k).alias(f"__{n}") for n, k in enumerate(keys)), F.col("id").alias("__id"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{n}"))
    return wanted.distinct().join(found, same, "left").select(*keys, F.coalesce("__id", hash_id(*keys)).alias("id"))


def upsert(existing: DataFrame, new: DataFrame, key: str, now: Column | None = None, order: Column | None = None) -> DataFrame:
    """New rows replace those of equal key; updated_at is set where it is a column.

    Of new rows that repeat a key the last counts: by `order`, else as they come.
    """
    new = last_of_each(new, key, order)
    if now is not None and "updated_at" in existing.columns:
        new = new.withColumn("updated_at", now)
    return existing.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of_each(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The last row of each key: by `order`, and among equals as the rows come."""
    ranked = df.withColumns({"__o": F.lit(0) if order is None else order, "__i": F.monotonically_increasing_id()})
    return latest(ranked, [key], F.col("__o").desc_nulls_last(), F.col("__i").desc()).drop("__o", "__i")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def not_seen(links: DataFrame, stored: DataFrame, on: str = "link") -> DataFrame:
    return links.join(stored.select(on).distinct(), on, "left_anti")


def seen(links: DataFrame, stored: DataFrame, on: str = "link") -> DataFrame:
    return links.join(stored.select(on).distinct(), on, "left_semi")


def author_articles(names: DataFrame, users: DataFrame, articles: DataFrame, order: str = "id") -> DataFrame:
    """Articles of the first user of each name; names without a user give none."""
    first = latest(users, ["full_name"], F.col(order)).select("full_name", F.col("id").alias("author_id"))
    return names.join(first, "full_name").join(articles, "author_id")


def warehouse(author: DataFrame, **collections: DataFrame) -> DataFrame:
    """All rows of the authors from each collection, with its name."""
    out = None
    for name, df in collections.items():
        rows = df.join(author, "author_id", "left_semi").withColumn("collection", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def concat_sets(first: DataFrame, second: DataFrame, order: str, head: int = 10_000, local: DataFrame | None = None) -> DataFrame:
    """Training sets one after the other; of the second the first rows."""
    out = first.unionByName(second.orderBy(order).limit(head))
    return out if local is None else out.unionByName(local)


def checked(items: DataFrame, schema: str, required: list[str], item: str = "item") -> DataFrame:
    """(row, error): JSON items read one by one.

    An item that is no object of this schema, or lacks a required field, has
    an error that names it and does not stop the others.
    """
    row = F.from_json(item, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = items.select(F.col(item), row.alias("row"))
    missing = F.array_compact(F.array(*(F.when(F.col(f"row.{c}").isNull(), F.lit(c)) for c in required)))
    error = F.when(F.col("row").isNull() | F.col("row._broken").isNotNull(), "not readable").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.select(item, F.struct(*(F.col(f"row.{n}").alias(n) for n in names)).alias("row"), error.alias("error"))


def ingest(existing: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The store with the good rows of `checked`, one by key."""
    return upsert(existing, rows.filter("error is null").select("row.*"), key, order=order)


def ingest_counts(kind: str, rows: DataFrame) -> DataFrame:
    """(kind, ingested, failed)."""
    return rows.agg(F.count_if(F.col("error").isNull()).alias("ingested"), F.count_if(F.col("error").isNotNull()).alias("failed")).select(F.lit(kind).alias("kind"), "ingested", "failed")
