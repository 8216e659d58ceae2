"""Readers, writers, stores, HTML, cache and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import vectors as V
from corpusloom.operators import cache, embed, store, strategies, vector_store
from corpusloom.sources import readers, schemas, writers
from corpusloom.streaming import flows as streams


def test_collection(spark, tmp_path):
    p = tmp_path / "users.json"
    p.write_text(json.dumps([{"id": "1", "full_name": "Ann Lee", "_db_path": "x"}, {"id": "2", "full_name": "Bob", "email": "b@c"}]))
    got = {r["id"]: r for r in readers.collection(spark, str(p), schemas.USERS).collect()}
    assert set(got) == {"1", "2"} and got["1"]["first_name"] is None and "_db_path" not in got["1"].asDict()
    assert readers.collection(spark, str(tmp_path / "none.json"), schemas.USERS).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    assert readers.collection(spark, str(bad), schemas.USERS).count() == 0


def test_raw_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"repository_url": "u", "owner": "o", "name": "n", "files": {"x.py": {"content": "print(1)", "size": 8, "language": "python"}}}))
    (tmp_path / "b.json").write_text(json.dumps([{"url": "u", "content": "text"}, {"other": 1}]))
    (tmp_path / "c.json").write_text("broken")
    got = readers.raw_documents(readers.whole_files(spark, str(tmp_path))).collect()
    assert sorted(r["kind"] for r in got) == ["article", "error", "generic", "repository"]
    repo = next(r["repository"] for r in got if r["kind"] == "repository")
    assert repo["files"]["x.py"]["content"] == "print(1)"
    kinds = spark.createDataFrame([("d/my_articles.json",), ("Users.json",), ("x.json",)], "f string").select(readers.document_kind(F.col("f")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["article", "user", "unknown"]


def test_training_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"artifact_data": [{"id": "1", "content": "c", "link": "l"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2", "content": "d"}]))
    assert {r["id"] for r in readers.training_articles(readers.whole_files(spark, str(tmp_path))).collect()} == {"1", "2"}
    t = tmp_path / "t"
    t.mkdir()
    (t / "p.json").write_text(json.dumps({"preference_triples": [{"instruction": "i", "generated_answer": "a", "extracted_answer": "b"}]}))
    assert readers.preference_triples(readers.whole_files(spark, str(t))).collect()[0]["generated_answer"] == "a"
    (t / "q.txt").write_text("one?\n\n  two? \n")
    assert [r[0] for r in readers.questions(spark, str(t / "q.txt")).collect()] == ["one?", "two?"]
    assert readers.config("parameters:\n  links: [a]\n")["parameters"]["links"] == ["a"]


def test_repository_walk(spark, tmp_path):
    for name, text in {"src/main.py": "print('hello world')", "node_modules/x.js": "var x = 12345678;", ".git/config": "a long enough text", "logo.png": "not really an image", "s.txt": "short"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["file_path"]: r["language"] for r in readers.repository_files(spark, str(tmp_path)).collect()}
    assert got == {"src/main.py": "python"}
    compat = {r["file_path"]: r["content"] for r in readers.repository_files(spark, str(tmp_path), compat=True).collect()}
    assert compat["src/main.py"] == "print('helloworld')" and "logo.png" not in compat


def test_pairs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("say \"hi\"", "a,b\nc"), ("x", "y")], "instruction string, output string")
    writers.pairs(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    writers.pairs(df, str(tmp_path / "a"), "alpaca")
    assert {r["input"] for r in spark.read.json(str(tmp_path / "a")).collect()} == {""}
    writers.pairs(df, str(tmp_path / "j"))
    assert readers.instruction_pairs(spark, str(tmp_path / "j")).count() == 2


def test_vector_table(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, [0.6, 0.8], "b"), (4, None, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, collection string")
    writers.append_vectors(df, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 3
    assert [r["vec_id"] for r in vector_store.search(back, [1.0, 0.0], 5).collect()] == [1, 3]  # the zero vector has no score
    assert vector_store.search(back, [1.0, 0.0], 1, where={"collection": "b"}, post_filter=True).count() == 0
    raw = vector_store.search(back, [1.0, 0.0], 1, metric="dot", compat=True).collect()[0]
    assert raw["vec_id"] == 2 and raw["score"] == 1.0
    writers.clear(back, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 0


def test_store(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x")], "id int, k string, updated_at string")
    assert store.find(df, "id", k="a").collect()[0]["id"] == 1
    assert [r["id"] for r in store.find_all(df, k=None, other=None).collect()] == [3]
    assert store.find_all(df, other="z").count() == 0
    new = spark.createDataFrame([(2, "b", "old"), (9, "c", "old")], df.schema)
    once = store.upsert(df, new, "id", F.lit("now"))
    twice = store.upsert(once, new, "id", F.lit("now"))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {r["id"]: r["updated_at"] for r in once.collect()} == {1: None, 3: "x", 2: "now", 9: "now"}
    twins = spark.createDataFrame([(2, "first", "1"), (2, "last", "2"), (2, "mid", "0"), (7, "n", None)], df.schema).coalesce(1)
    assert {r["id"]: r["k"] for r in store.upsert(df, twins, "id").collect()} == {1: "a", 2: "mid", 3: None, 7: "n"}
    assert {r["id"]: r["k"] for r in store.upsert(df, twins, "id", order=F.col("updated_at")).collect()} == {1: "a", 2: "last", 3: None, 7: "n"}
    assert store.get_or_create(df.withColumn("id", F.col("id").cast("string")), "id", k="a").collect()[0]["id"] == "1"
    assert len(store.get_or_create(df.withColumn("id", F.col("id").cast("string")), "id", k="zz").collect()[0]["id"]) == 32


def test_embed_failures_and_blanks(spark):
    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("no model")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad")], "i int, t string").coalesce(1)
    got = {r["i"]: list(r["embedding"]) for r in embed.embed(df, "t", provider, size=2, batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: [1.0, 1.0], 3: [0.0, 0.0]}
    errors = embed.embed(df, "t", provider, size=2, batch=1, error="why").collect()
    assert {r["i"]: r["why"] for r in errors} == {1: None, 2: None, 3: "RuntimeError: no model"}
    unit = embed.embed(df, "t").select(V.norm(F.col("embedding")).alias("n"), "i").collect()
    assert {r["i"]: round(r["n"], 5) for r in unit} == {1: 1.0, 2: 0.0, 3: 1.0}
    meta = embed.with_metadata(spark.createDataFrame([({"embedding_size": "7"},), (None,)], "metadata map<string,string>"), "m", 384, 256).collect()
    assert meta[0]["metadata"]["embedding_size"] == "7" and meta[1]["metadata"]["embedding_size"] == "384"


def test_html():
    page = '<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><div class="post a" id="c"><p>Hello there, reader</p></div><div data-k="feed-1"><a href="/x">more</a></div></body></html>'
    assert H.extract(page, "unknown") == {"title": "T", "content": "Hello there, reader", "content_length": 19}
    root = H.parse(page)
    assert [n.attrs["id"] for n in H.select(root, "body div.post#c")] == ["c"]
    feed = '<div data-k="feed-1"><span data-test-id="actor-name">Ann</span><p class="feed-shared-text">Hi <b>all</b></p><a href="/posts/7">x</a></div><div data-k="feed-2">nothing</div>'
    assert H.feed_posts(feed, [".none", "[data-k*=feed]"]) == [{"title": "Post by Ann", "content": "Hiall", "author": "Ann", "link": "https://www.linkedin.com/posts/7", "timestamp": "", "platform": "www.linkedin.com"}]
    medium = '<h1 class="pw-post-title">A fine long title</h1><article>short</article><main>the content of a page</main>'
    assert H.extract(medium, "medium") == {"title": "A fine long title", "content": "the content of a page", "content_length": 21}
    assert H.extract(None, None)["content"] == "" and H.extract("<p", "medium")["content_length"] == 0


def test_cache(spark):
    now = F.expr("timestamp'2024-01-02 00:00:00'")
    empty = spark.createDataFrame([], schemas.CACHE)
    new = spark.createDataFrame([("u", "article", dt.datetime(2024, 1, 1, 1), 10)], "url string, content_type string, cached_at timestamp, bytes bigint")
    c = cache.put(cache.put(empty, new), new)
    assert c.count() == 1
    ask = spark.createDataFrame([("article", "u"), ("github", "u")], "content_type string, url string")
    assert {r["content_type"]: r["hit"] for r in cache.look_up(ask, c, now).collect()} == {"article": True, "github": False}
    assert cache.clear(c, now, older_than_hours=24).count() == 1 and cache.clear(c, now, "article").count() == 0


def test_streams(spark, data, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(src))
    q = streams.windows(streams.files(spark, str(src), streams.EVENTS)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = streams.windows(spark.read.parquet(str(src))).groupBy().agg(F.sum("n")).first()[0]
    assert spark.table("w").agg(F.sum("n")).first()[0] == want
    assert streams.sessions(spark.read.parquet(str(src))).agg(F.sum("n")).first()[0] == want
    s = streams.files(spark, str(src), streams.EVENTS, per_trigger=1)
    out = str(tmp_path / "out")
    streams.upsert_batches(s.select("user_id", "event_type"), out, "user_id", str(tmp_path / "cp")).awaitTermination()
    final = streams.latest_version(spark, out)
    assert final.count() == final.select("user_id").distinct().count() == spark.read.parquet(str(src)).select("user_id").distinct().count()


def test_generated_pairs(spark):
    from corpusloom.operators import datasets

    def provider(t):
        if "fail" in t:
            raise RuntimeError
        return 'Sure: {"instruction_answer_pairs": [{"instruction": "Q", "answer": "' + t[:3] + '"}]}' if "model" in t else "no json"

    df = spark.createDataFrame([(1, "model text"), (2, "fail"), (3, "plain")], "i int, t string")
    got = {(r["i"], r["instruction"], r["output"]) for r in datasets.generated_pairs(df, "t", ["i"], provider).collect()}
    assert got == {(1, "Q", "mod"), (2, datasets.GENERIC, "fail."), (3, datasets.GENERIC, "plain.")}
    assert datasets.generated_pairs(df, "t", ["i"]).count() == 3


def test_hybrid_writer_and_profiles(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert writers.hybrid(df, str(tmp_path / "a"), ["vec_id", "embedding"], "vec_id") == "primary"
    assert writers.hybrid(df, str(tmp_path / "a"), ["vec_id", "embedding"], "vec_id", limit_mb=0.0) == "local"
    assert {r["store"] for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {"primary", "local"}


def test_search_many_ties_and_blocks(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.6, 0.8]) for i in range(40)] + [(99, None), (98, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<float>")
    for most_mb in (64, 1e-5):
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vector_store.search_many(df, q, 3, most_mb=most_mb).collect())
        assert got == [(7, 1, 1), (7, 2, 3), (7, 3, 5), (8, 1, 0), (8, 2, 2), (8, 3, 4)]
    assert vector_store.search_many(df, q.limit(0)).count() == 0
    assert [r["vec_id"] for r in vector_store.search_many(df, q.filter("query_id = 7"), 1, "dot").collect()] == [1]
    assert [r["vec_id"] for r in vector_store.search_many(df, q.filter("query_id = 7"), 1, "euclid").collect()] == [1]


def test_command_line(capsys):
    from corpusloom.__main__ import main

    main(["list"])
    assert "clean_ing" in capsys.readouterr().out


def test_command_line_flows(spark, data, tmp_path, capsys):
    from corpusloom.__main__ import main

    docs, chunks = f"{data}/documents.parquet", str(tmp_path / "chunks")
    main(["ingest", docs, chunks, "--chunker", "fixed"])
    n = spark.read.parquet(chunks).count()
    main(["ingest", docs, chunks, "--chunker", "fixed"])  # all are there
    assert n == spark.read.parquet(chunks).count() > 0
    main(["ingest", docs, chunks, "--chunker", "fixed", "--no-cache"])
    assert spark.read.parquet(chunks).count() == n
    (tmp_path / "q.txt").write_text("What is it?\n\nWhere is that?\n")
    main(["ask", chunks, str(tmp_path / "q.txt"), str(tmp_path / "answers"), "-k", "2"])
    assert [r["context_documents"] for r in spark.read.json(str(tmp_path / "answers")).collect()] == [2, 2]
    main(["ask", chunks, str(tmp_path / "one"), "--question", "What is it?"])
    assert spark.read.json(str(tmp_path / "one")).count() == 1
    main(["extract", f"{data}/pages.parquet", str(tmp_path / "pages")])
    assert spark.read.parquet(str(tmp_path / "pages")).filter("content <> ''").count() > 0
    main(["pairs", docs, str(tmp_path / "pairs"), "--format", "alpaca"])
    assert set(spark.read.json(str(tmp_path / "pairs")).columns) == {"instruction", "input", "output"}
    rows = [("a", "https://x", "github", "2020-01-01 00:00:00", 5), ("b", "https://y", "article", "2020-01-01 00:00:00", 6)]
    table = spark.createDataFrame(rows, "cache_key string, url string, content_type string, cached_at string, bytes long")
    table.withColumn("cached_at", F.to_timestamp("cached_at")).write.parquet(str(tmp_path / "cache"))
    main(["cache", "clear", str(tmp_path / "cache"), "--type", "github", "--out", str(tmp_path / "left")])
    assert [r["cache_key"] for r in spark.read.parquet(str(tmp_path / "left")).collect()] == ["b"]
    main(["cache", "stats", str(tmp_path / "left")])
    assert "https://y" in capsys.readouterr().out
    for wrong in (["ask", chunks], ["cache", "clear", chunks]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_strategies_and_positions(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id long, t string")
    for name in (*strategies.COLUMN_CHUNKERS, *strategies.PYTHON_CHUNKERS):
        assert {r["doc_id"] for r in strategies.chunked(df.fillna(""), "t", ["doc_id"], name).collect()} <= {1, 2}
    with pytest.raises(ValueError):
        strategies.find(strategies.CLEANERS, "no such")
    with pytest.raises(ValueError):
        strategies.register(strategies.COLUMN_CHUNKERS, "recursive", strategies.COLUMN_CHUNKERS["fixed"])
    made = dict(strategies.CLEANERS)
    strategies.register(made, "upper", F.upper)
    assert strategies.find(made, "upper") is F.upper
    rows = vector_store.with_positions(spark.createDataFrame([(i * 7 % 50, [1.0]) for i in range(50)], "vec_id long, embedding array<float>"))
    assert all(r["vec_id"] == r["position"] for r in rows.collect())
    assert {r["vec_id"] for r in vector_store.at_positions(rows, [0, 49, 50, -1]).collect()} == {0, 49}
    assert vector_store.with_positions(rows.drop("position").limit(0)).count() == 0
