"""Vector index, token chunks, keyed log, archives and batches."""

import gzip
import io
import os
import random
import tarfile
import threading

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom import index_queries as iq
from corpusloom.operators import chunk, log_store, store, token_chunk, vector_index, vector_store
from corpusloom.sources import archives

# ---- vector index


def test_index_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    truth = {(r["query_id"], r["vec_id"]) for r in vector_store.search_many(e, queries, 10).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in iq.vector_index_search(spark, data).collect()}
    assert len(got & truth) >= 0.9 * len(truth)


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dot"])
def test_index_on_clusters(spark, tmp_path, metric):
    """Clustered vectors: few cells do; null, zero and repeated rows; queries in blocks; a filter."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 20)) * 3
    x = np.concatenate([c + rng.normal(size=(50, 20)) * 0.4 for c in centres])
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 20, 0), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(5)
    model = vector_index.build(df, str(tmp_path), metric, parts=10)
    queries = df.filter("vec_id % 50 = 0 and embedding is not null and vec_id <> 5000").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda d: [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in d.orderBy("query_id", "rank").collect()]
    exact = pairs(vector_store.search_many(df, queries, 10, metric))
    assert pairs(vector_index.search(spark, str(tmp_path), queries, 10, 10**6)) == exact
    assert pairs(vector_index.search(spark, str(tmp_path), queries, 10, 10**6, block_bytes=2000)) == exact
    few = pairs(vector_index.search(spark, str(tmp_path), queries, 10, 8 if metric != "dot" else len(model.centres) // 2))
    assert len({x[::2] for x in few} & {x[::2] for x in exact}) >= 0.9 * len(exact)
    some = pairs(vector_index.search(spark, str(tmp_path), queries, 5, 10**6, where={"label": 1}))
    assert some == pairs(vector_store.search_many(df.filter("label = 1"), queries, 5, metric))
    assert vector_index.tune(spark, str(tmp_path), queries) < len(model.centres)
    assert vector_index.info(spark, str(tmp_path)).agg(F.sum("rows")).first()[0] == len(data)


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    vector_index.build(df, str(tmp_path))
    assert vector_index.search(spark, str(tmp_path), df.withColumnRenamed("vec_id", "query_id")).count() == 0


# ---- token chunks


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(iq.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_spans_in_characters_equal_the_recursive_splitter():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "bb", " ", "\n", "\n\n", ". ", "c", "é"]) for _ in range(rng.randint(0, 80)))
        size = rng.randint(2, 30)
        overlap = rng.randint(0, size - 1)
        assert [s for a, b in token_chunk.spans(t, size, overlap) if (s := t[a:b].strip())] == chunk.recursive(t, size, overlap)


@pytest.mark.parametrize("query, size, overlap", [("chunk_tokens", 1000, 200), ("chunk_tokens_small", 64, 16)])
def test_token_chunks(spark, data, tokenizer, query, size, overlap):
    """Against the splitter on strings, whose pieces' sizes are looked up by counting the text's tokens one by one."""
    got = {}
    for r in getattr(iq, query)(spark, data).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for doc in pq.read_table(f"{data}/documents.parquet").to_pylist():
        t, found = doc["text"], got.get(doc["doc_id"], [])
        starts = [a for a, _ in tokenizer.encode(t or "", add_special_tokens=False).offsets]
        for k, r in enumerate(found):
            piece = t[r["start"] :]
            piece = piece[piece.index(r["chunk"]) :][: len(r["chunk"])]
            assert r["chunk_index"] == k and piece == r["chunk"] and r["n_tokens"] <= size
            own = sum(r["start"] <= a < r["start"] + len(r["chunk"]) for a in starts)
            assert own <= r["n_tokens"] and len(tokenizer.encode(r["chunk"], add_special_tokens=False).ids) <= size + 3
        words = [w for w in (t or "").split()]
        joined = " ".join(r["chunk"] for r in found)
        assert not words or all(w in joined for w in words[:: max(1, len(words) // 50)])
        assert bool(found) == bool((t or "").strip())
        if t:
            assert len(found) >= token_chunk.fewest(token_chunk.offsets_before(starts, len(t)), size)
            if len(starts) <= size and t.strip():
                assert len(found) == 1
        for a, b in zip(found, found[1:]):
            assert a["start"] < b["start"]
            between = sum(b["start"] <= s < a["start"] + len(a["chunk"]) for s in starts)
            assert between <= overlap


def test_odd_token_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "x" * 5000), (5, "<|endoftext|> 日本語 😀" * 50), (None, "short")], "doc_id long, text string")
    out = token_chunk.token_chunks(df, "text", ["doc_id"], iq.tokenizer_path(), 20, 5).collect()
    assert {r["doc_id"] for r in out} == {4, 5, None} and all(r["n_tokens"] <= 20 and r["chunk"].strip() for r in out)


# ---- log


def states(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_log_equals_upserts(spark, tmp_path):
    rng = random.Random(2)
    log = log_store.Log(spark, str(tmp_path / "t"), "k", 4)
    want, plain = None, {}
    for n in range(8):
        batch = [(rng.choice([None, *range(30)]), n, rng.random()) for _ in range(rng.randint(1, 25))]
        df = spark.createDataFrame(batch, "k int, n int, v double").coalesce(1)
        assert log.write(df, F.col("v"), "w", n)
        assert not log.write(df, F.col("v"), "w", n)
        want = df.limit(0) if want is None else want
        want = spark.createDataFrame(store.upsert(want, df, "k", order=F.col("v")).collect(), "k int, n int, v double")
        if n in (3, 5):
            gone = [rng.randrange(30) for _ in range(5)]
            log.delete(spark.createDataFrame([(g,) for g in gone], "k int"))
            want = spark.createDataFrame([r for r in want.collect() if r["k"] not in gone], "k int, n int, v double")
        if n in (2, 6):
            assert log.compact() > 0
        plain[n] = states(want)
        assert states(log.read()) == plain[n]
    log.compact()
    assert log.vacuum(1) > 0 and states(log.read()) == plain[7] and len(log.versions()) == 1


def test_log_writes_follow_the_batch(spark, tmp_path):
    log = log_store.Log(spark, str(tmp_path / "t"), "k")
    size = lambda: sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(tmp_path) for x in names)
    log.write(spark.range(200_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v")))
    log.compact()
    log.vacuum(1)
    before = size()
    log.write(spark.range(50).select((F.col("id") * 1000).alias("k"), F.lit("new").alias("v")))
    assert size() - before < before / 20
    assert log.read().count() == 200_000 and log.read().filter("v = 'new'").count() == 50
    log.write(spark.createDataFrame([(1, "x", 3.5)], "k long, v string, extra double"))
    assert log.read().filter("k = 1").first()["extra"] == 3.5 and log.read().filter("extra is null").count() == 199_999


def test_log_conflicts(spark, tmp_path, monkeypatch):
    """Writers at the same time all commit; a compaction keeps what came meanwhile."""
    path = str(tmp_path / "t")
    failed = []

    def one(n):
        try:
            log_store.Log(spark, path, "k", 2).write(spark.createDataFrame([(n, n), (100, n)], "k int, v int"), writer=f"w{n}", batch=0)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=one, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = log_store.Log(spark, path, "k", 2)
    assert not failed and {r["k"] for r in log.read().collect()} == {0, 1, 2, 3, 100} and log.versions() == [1, 2, 3, 4]
    commit, late = log_store.Log._commit, [True]

    def slow(self, m):
        if late.pop() if late else False:
            log_store.Log(spark, path, "k", 2).write(spark.createDataFrame([(200, 1)], "k int, v int"))
        commit(self, m)

    monkeypatch.setattr(log_store.Log, "_commit", slow)
    log.compact()
    assert log.read().count() == 6 and len(log.manifest().deltas) == 1
    with pytest.raises(FileNotFoundError):
        log_store.Log(spark, str(tmp_path / "none"), "k").read()


# ---- archives


@pytest.mark.parametrize("kind", ["tar", "zip", "warc"])
def test_archives_split(spark, tmp_path, kind):
    archives.register(spark)
    rng = random.Random(7)
    files = {f"d{i % 5}/{'long-name-' * (12 if i % 50 == 0 else 1)}{i}.txt": os.urandom(rng.choice([0, 10, 511, 512, 513, 4000])) for i in range(400)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "m string, c binary").repartition(2)
    assert archives.pack(df, str(tmp_path / "a"), "m", "c", kind).agg(F.sum("members")).first()[0] == len(files)
    for split in (1, 5000, 1 << 30):
        out = spark.read.format("archive").option("path", str(tmp_path / "a")).option("split_bytes", split).load()
        got = out.collect()
        assert len(got) == len(files) and {r["member"]: bytes(r["content"]) for r in got} == files and all(r["size"] == len(r["content"]) for r in got)
        assert (out.rdd.getNumPartitions() > 10) == (split < 1 << 30)


def test_odd_archives(spark, tmp_path):
    archives.register(spark)
    folder = tmp_path / "a"
    folder.mkdir()
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in (("a/x", b"1" * 700), ("a/y", b"2" * 700)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        d = tarfile.TarInfo("a/folder")
        d.type = tarfile.DIRTYPE
        t.addfile(d)
    (folder / "whole.tar").write_bytes(raw.getvalue())
    (folder / "cut.tar").write_bytes(raw.getvalue()[:2500])
    (folder / "packed.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    (folder / "half.tgz").write_bytes(gzip.compress(raw.getvalue())[:-20])
    (folder / "empty.tar").write_bytes(b"")
    (folder / "note.txt").write_text("no archive")
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi</p>"
    record = lambda kind, more, data: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/{kind}\r\n{more}Content-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n"
    warc = record("request", "", b"GET /") + record("response", "Content-Type: application/http; msgtype=response\r\n", http) + record("resource", "", b"plain")
    (folder / "p.warc.gz").write_bytes(gzip.compress(warc[:200]) + gzip.compress(warc[200:]))
    got = {(os.path.basename(r["archive"]), r["member"]): bytes(r["content"]) for r in spark.read.format("archive").option("path", str(folder)).load().collect()}
    assert got[("p.warc.gz", "http://x/response")] == b"<p>hi</p>" and got[("p.warc.gz", "http://x/resource")] == b"plain"
    assert got[("whole.tar", "a/y")] == got[("packed.tar.gz", "a/y")] == b"2" * 700 and got[("cut.tar", "a/x")] == b"1" * 700
    assert ("cut.tar", "a/y") not in got and not any(k[0] in ("empty.tar", "note.txt") for k in got)
    only = spark.read.format("archive").option("path", f"{folder}/wh*.tar").load()
    assert {r["member"] for r in only.collect()} == {"a/x", "a/y"}


# ---- batches


def test_batches_of_a_task_that_fails_once(spark, tmp_path):
    """What a broken attempt wrote is not there; a run that is repeated writes the same names; an abort leaves nothing."""
    archives.register(spark)
    out, flag = str(tmp_path / "out"), str(tmp_path / "failed")

    def sometimes(batches):
        for n, b in enumerate(batches):
            yield b
            if n == 1 and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("once")

    df = spark.range(0, 1230, 1, 3)
    for _ in range(2):
        df.write.format("batches").option("path", out).option("run", "r1").mode("append").save()
    names = sorted(os.listdir(out))
    assert len(names) == 27 and all(n.startswith("r1-") for n in names)
    assert sorted(r["id"] for r in spark.read.json(out).collect()) == list(range(1230))
    assert max(r["count"] for r in spark.read.json(out).groupBy(F.col("_metadata.file_path")).count().collect()) == 50
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        with pytest.raises(Exception, match="once"):
            df.mapInArrow(sometimes, "id long").write.format("batches").option("path", str(tmp_path / "bad")).mode("append").save()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not [n for n in os.listdir(tmp_path / "bad") if not n.startswith("_")]  # attempts that end later lie in the run's hidden folder
    df.limit(3).write.format("batches").option("path", out).option("run", "r2").mode("overwrite").save()
    assert spark.read.json(out).count() == 3


# ---- command line


def test_ingest_in_two_batches(spark, tmp_path):
    """Making the second batch anew keeps the chunks of the first."""
    from corpusloom.__main__ import main

    docs = spark.createDataFrame([(i, f"Text number {i}. " * 80) for i in range(20)], "doc_id long, text string")
    docs.filter("doc_id % 2 = 0").write.parquet(str(tmp_path / "even"))
    docs.filter("doc_id % 2 = 1").write.parquet(str(tmp_path / "odd"))
    out = str(tmp_path / "chunks")
    main(["ingest", str(tmp_path / "even"), out])
    main(["ingest", str(tmp_path / "odd"), out, "--no-cache"])
    got = spark.read.parquet(out)
    assert got.select("doc_id").distinct().count() == 20
    n = got.count()
    main(["ingest", str(tmp_path / "odd"), out, "--no-cache"])
    assert spark.read.parquet(out).count() == n


def test_table_function(spark):
    """Any table's other columns come along; wrong arguments are refused before anything runs."""
    from pyspark.errors import AnalysisException

    from corpusloom.operators import strategies, table_functions

    table_functions.register(spark)
    text = "One sentence here. Another one! " * 60
    df = spark.createDataFrame([(1, "x", text), (2, None, None), (3, "y", ""), (4, "z", "short")], "id int, tag string, t string")
    df.createOrReplaceTempView("some_texts")
    for method, options in (("walk", '{"size": 300, "overlap": 40}'), ("recursive", '{"size": 200, "overlap": 20}'), ("tokens", '{"size": 30, "overlap": 5}')):
        got = spark.sql(f"select * from chunk(table(some_texts), 't', '{method}', '{options}')")
        import json

        want = strategies.chunked(df, "t", ["id", "tag"], method, **json.loads(options))
        assert got.columns == ["id", "tag", "chunk_index", "chunk"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    for wrong in ("'no', 'walk'", "'t', 'no'", "'t', 'walk', 'no json'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"select * from chunk(table(some_texts), {wrong})")


def test_permutation(spark, tmp_path):
    from corpusloom.operators import permute

    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = permute.places(np.arange(n), n, 42)
        assert sorted(p.tolist()) == list(range(n))
        assert n < 100 or abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.15 and (permute.places(np.arange(n), n, 43) != p).any()
    df = spark.range(1000, 1500).withColumn("v", F.col("id") * 2)
    got = {tuple(sorted((r["id"], r["place"]) for r in permute.permuted(df.repartition(k), "id").collect())) for k in (1, 3, 7)}
    assert len(got) == 1 and sorted(p for _, p in next(iter(got))) == list(range(500))
    permute.write_shuffled(df, str(tmp_path / "s"), "id", bucket_rows=100)
    rows_ = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["count"] for r in rows_.groupBy("bucket").count().collect()) == [100] * 5 and all(r["place"] // 100 == r["bucket"] for r in rows_.collect())
    assert permute.permuted(df.limit(0), "id").count() == 0
