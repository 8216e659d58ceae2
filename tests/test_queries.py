"""Every query against its SQL counterpart, and those without one for rows and a stable schema."""

import pytest
from compare import duck, rows

from corpusloom import index_queries, ingest_queries  # noqa: F401  register their queries
from corpusloom import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, data, name):
    assert rows(q.QUERIES[name](spark, data)) == duck(data, q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, data, name):
    a, b = q.QUERIES[name](spark, data), q.QUERIES[name](spark, data)
    assert a.schema == b.schema
    assert rows(a) == rows(b)
    assert a.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("n", ["1", "7"])
def test_partitions_do_not_matter(spark, data, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["dedup_by_link", "vector_many_queries", "collection_authors", "repository_files"]
    want = [rows(q.QUERIES[x](spark, data)) for x in names]
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        assert [rows(q.QUERIES[x](spark, data)) for x in names] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
