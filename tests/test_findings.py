"""Odd and larger tables: what queries over the plain ones did not show."""

import pytest
from compare import duck, rows

from corpusloom import index_queries, ingest_queries  # noqa: F401  register their queries
from corpusloom import queries as q

TEXTS = ["", " ", "   \n   \n  ", " " * 9, "\n" * 12, "a" + "\n" * 9, "Re.", "abcd", "abcde", "ab\n\n", "Éaux.", "\tlong enough\t", "one line\nand another", None]


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    langs = ["en", "", None]
    data = [(i, t, langs[i // 2 % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(t for t in TEXTS for _ in range(6))]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def same(spark, d, name):
    found = rows(q.QUERIES[name](spark, d))
    assert found == duck(d, q.ORACLES[name])
    return found[1]


def test_short_articles(spark, odd_documents):
    assert 0 < len(same(spark, odd_documents, "article_text_assemble")) < 6 * len(TEXTS)


HEADS = ["A &amp", "A &lt", "&ampx", "A & B &amp; C", "x &copy 2024", "&quot;q&quot", "R&D &middot", "&", "&;", "plain"]


@pytest.fixture(scope="module")
def open_references(spark, tmp_path_factory):
    """Pages whose headings end in the middle of an entity."""
    d = str(tmp_path_factory.mktemp("pages"))
    page = '<html><head><title>{h}</title><script>if (a &amp b && "</p>") c();</script></head><body><article><h1>{h}</h1><p>Text of some length: {h}</p></article></body></html>'
    spark.createDataFrame([(i, f"https://blog{i}.example.com/{i}", page.format(h=h)) for i, h in enumerate(HEADS)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["html_fallback", "html_feed_posts", "html_selectors"])
def test_open_references(spark, open_references, name):
    assert len(same(spark, open_references, name)) == len(HEADS)


def test_open_references_elsewhere():
    from corpusloom.functions import html as H

    root = H.parse('<!-- &amp <script> --><a href="/?a=1&b=2&copy=3">&amp &amp; &#38 &#38;</a><script>a &amp b && c</script><style>&lt</style>', frozenset())
    a, script, style = (n for n in root.walk() if n.tag)
    assert a.attrs["href"] == "/?a=1&b=2&copy=3" and a.text() == "&amp & &#38 &"
    assert (script.text(), style.text()) == ("a &amp b && c", "&lt")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_many_queries_in_bounded_memory(spark, monkeypatch, metric):
    """10,000 rows in one batch and 3,000 queries: their matrix would take 240 MB.  Few different vectors, so that many rows tie."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from corpusloom.operators import vector_store

    r = np.random.default_rng(5)
    x, q = r.integers(-2, 3, (10_000, 3)).astype(float), r.integers(-3, 4, (3_000, 3)).astype(float)
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    found = []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: found.append(f) or plain(self, f, *a, **k))
    vector_store.search_many(df, queries, 4, metric)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)[::-1]), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    tracemalloc.start()
    try:
        out = list(found[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20
    got = {}
    for b in out:
        for i, v, s in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(i, []).append((v, s))
    for i in range(0, 3_000, 37):
        s = x @ q[i]
        if metric == "euclid":
            s = -np.sqrt(((x - q[i]) ** 2).sum(1))
        elif metric == "cosine":
            n = np.sqrt((x**2).sum(1) * (q[i] ** 2).sum())
            s = np.where(n > 0, s / np.where(n > 0, n, 1), -np.inf)
        s, ids = np.round(s, 12), np.arange(10_000)[::-1]
        order = [j for j in np.lexsort((ids, -s))[:4] if s[j] > -np.inf]
        assert [v for v, _ in got.get(i, [])] == [int(ids[j]) for j in order]


def test_hits_are_taken_once(spark):
    """Context and sources of an answer come from one pass over the hits."""
    import contextlib
    import io

    from corpusloom.operators import rag

    hits = spark.createDataFrame([(1, 2, 0.5, "b"), (1, 1, 0.9, "a" * 300)], "query_id long, rank int, score double, text string")
    questions = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, question string")
    taken = hits.filter("rank < 1000")
    answers = rag.answers(taken, questions)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        answers.explain("extended")
    assert text.getvalue().split("== Optimized")[0].split("== Analyzed")[1].count("1000") == 1
    a, b = sorted(answers.collect())
    assert a["context_documents"] == 2 and [tuple(s) for s in a["sources"]] == [(1, "a" * 200 + "...", 0.9), (2, "b...", 0.5)] and a["context"].index("Document 1") < a["context"].index("Document 2")
    assert (b["context_documents"], b["context"], b["sources"]) == (0, rag.NOTHING, None)


def captured(spark, monkeypatch, make, name):
    """What `make` gives to the method `name` of a DataFrame."""
    found = []
    kind = type(spark.range(1))
    plain = getattr(kind, name)
    monkeypatch.setattr(kind, name, lambda self, *a, **k: found.append(a) or plain(self, *a, **k))
    make()
    return found


def test_token_counts_of_words():
    """Words from the table give the places that the tokenizer gives for whole texts, of odd ones too."""
    import random

    import numpy as np

    from corpusloom.index_queries import tokenizer_path
    from corpusloom.operators import token_chunk

    r = random.Random(3)
    letters = [*"ab1.$é🙂Ж語ȿ×\x00 \n\t\r", "  ", "'s", "\xa0", "　", " ", "<|endoftext|>"]
    texts = ["", *("".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(2000)), *(f"the word {k} of many words\nthe word" for k in range(50))]
    counts = token_chunk.TokenCounts(tokenizer_path())
    for t, e in zip(texts + texts[::-1], counts.coder.tokenizer.encode_batch(texts + texts[::-1], add_special_tokens=False)):
        assert np.array_equal(counts([t])[0], token_chunk.offsets_before([a for a, _ in e.offsets], len(t)))
    counts(texts)
    before = counts.coder.filled
    counts(texts)
    assert 0 < before == counts.coder.filled  # no word is tokenized again


@pytest.mark.parametrize("name", ["chunk_two_stage", "rag_end_to_end", "chunk_tokens", "vector_many_queries"])
def test_batches_are_bounded(spark, data, name):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    q.QUERIES[name](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_collection_arrays_follow_the_size(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    from corpusloom.sources import readers, writers

    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 1000).alias("content"))
    writers.collection(df, str(tmp_path / "c"), F.col("id"), most_mb=0.1)
    assert len(glob.glob(f"{tmp_path}/c/*/*.txt")) >= 20
    assert sorted(readers.collection(spark, f"{tmp_path}/c/*/*.txt", "id string, content string").collect()) == sorted(df.collect())


@pytest.mark.parametrize("name", ["archive_tar", "archive_zip", "archive_warc"])
def test_archives_follow_the_partitions(spark, data, monkeypatch, name):
    assert not captured(spark, monkeypatch, lambda: q.QUERIES[name](spark, data), "repartition")


@pytest.mark.parametrize("name", ["collection_missing", "embedding_dimensions", "get_or_create"])
def test_reads_a_table(spark, data, name):
    assert len(same(spark, data, name)) >= 50


@pytest.mark.parametrize("kind", ["tar", "zip", "warc"])
def test_empty_partitions_are_archives(spark, tmp_path, kind):
    from corpusloom.sources import archives

    archives.register(spark)
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "member string, text string").coalesce(1).union(spark.createDataFrame([], "member string, text string"))
    path = str(tmp_path / kind)
    archives.pack(df.repartition(5, "member"), path, "member", "text", kind).collect()
    assert sorted(r["member"] for r in spark.read.format("archive").option("path", path).load().collect()) == ["a", "b"]


def test_every_question_is_asked(spark, data):
    asked = sorted(r["item_id"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect())
    found = sorted(q.QUERIES["rag_end_to_end"](spark, data).collect())
    assert [tuple(r) for r in found] == [(i, 3, 3) for i in asked]
