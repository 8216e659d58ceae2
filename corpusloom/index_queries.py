"""Queries of the stores: vector index, token chunks, keyed log, archives and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import log_store, permute, table_functions, token_chunk, vector_index
from corpusloom.queries import query, s_many, s_walk
from corpusloom.session import shared_path
from corpusloom.sources import archives
from corpusloom.sources.adapters import embedded, table


def _indexed(spark, d, metric: str = "cosine") -> tuple[str, vector_index.Model, DataFrame]:
    rows = embedded(spark, d)
    path = shared_path(spark, "vector-index")
    model = vector_index.build(rows, path, metric)
    return path, model, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def vector_index_search(spark, d):
    """Approximate: as many probes as its own measurement asks for."""
    path, _, queries = _indexed(spark, d)
    return vector_index.search(spark, path, queries, 10, vector_index.tune(spark, path, queries))


@query(s_many("list_cosine_similarity(e.embedding::double[], q.embedding::double[])", 10))
def vector_index_all_cells(spark, d):
    """All cells probed: the exact result."""
    path, model, queries = _indexed(spark, d)
    return vector_index.search(spark, path, queries, 10, len(model.centres)).withColumn("score", F.round("score", 4))


@query(s_many("-list_distance(e.embedding::double[], q.embedding::double[])", 7, "e.label < 5 and e.label = 3"))
def vector_index_filtered(spark, d):
    path, model, queries = _indexed(spark, d, "euclid")
    return vector_index.search(spark, path, queries, 7, len(model.centres), where={"label": 3}).withColumn("score", F.round("score", 4))


@query("select c.cell_rows, c.vectors from (select count(*) as cell_rows, count(*) as vectors from embeddings) c")
def vector_index_append(spark, d):
    """Every row is indexed, those that come later too."""
    rows = embedded(spark, d)
    path = shared_path(spark, "vector-index")
    model = vector_index.build(rows.filter("label < 7"), path)
    vector_index.append(rows.filter("label >= 7 or label is null"), path, model)
    cells = vector_index.info(spark, path).agg(F.sum("rows").alias("cell_rows"))
    return cells.crossJoin(F.broadcast(spark.read.parquet(f"{path}/rows").agg(F.count_distinct("row").alias("vectors"))))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def chunk_tokens(spark, d):
    """Sizes in ids: the ingestion's own, 1000 with 200 repeated."""
    return token_chunk.token_chunks(table(spark, d, "documents"), "text", ["doc_id"], tokenizer_path())


@query()
def chunk_tokens_small(spark, d):
    return token_chunk.token_chunks(table(spark, d, "documents"), "text", ["doc_id"], tokenizer_path(), 64, 16)



def _log(spark, d) -> log_store.Log:
    """The events as one batch for each type, keyed by user."""
    events = table(spark, d, "events")
    log = log_store.Log(spark, shared_path(spark, "log"), "user_id", 8)
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    for n, kind in enumerate(kinds):
        batch = events.filter(F.col("event_type") == kind)
        order = F.struct("ts", "event_id")
        log.write(batch, order, "events", n)
        log.write(batch, order, "events", n)  # a batch that is run again changes nothing
        if n == 1:
            log.compact()
    return log


_STATE = "select user_id, event_id, event_type, value from events where user_id is not null qualify row_number() over (partition by user_id order by event_type desc, ts desc, event_id desc) = 1"


@query(_STATE)
def log_upserts(spark, d):
    """Deltas over a compacted base, merged on read."""
    return _log(spark, d).read().select("user_id", "event_id", "event_type", "value")


@query(f"select * from ({_STATE}) where user_id not in (select c_custkey from customer where c_acctbal < 0)")
def log_deletes(spark, d):
    log = _log(spark, d)
    log.delete(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))
    log.compact()
    log.vacuum(1)
    return log.read().select("user_id", "event_id", "event_type", "value")


def _archived(spark, d, kind: str) -> DataFrame:
    archives.register(spark)
    docs = table(spark, d, "documents").withColumn("member", F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = shared_path(spark, f"archives-{kind}")
    archives.pack(docs, path, "member", "text", kind).agg(F.sum("members")).collect()
    found = spark.read.format("archive").option("path", path).option("split_bytes", 1 << 20).load()
    return found.select("member", "size", F.md5("content").alias("md5"))


_ARCHIVED = "select 'docs/' || source || '/' || doc_id || '.txt' as member, octet_length(encode(coalesce(text, '')))::bigint as size, md5(coalesce(text, '')) as md5 from documents"


@query(_ARCHIVED)
def archive_tar(spark, d):
    return _archived(spark, d, "tar")


@query(_ARCHIVED)
def archive_zip(spark, d):
    return _archived(spark, d, "zip")


@query(_ARCHIVED)
def archive_warc(spark, d):
    return _archived(spark, d, "warc")


@query("select doc_id, lang, n_chars, md5(text) as md5 from documents")
def batch_sink(spark, d):
    """All documents written in batches of 50 and read again."""
    archives.register(spark)
    path = shared_path(spark, "batches")
    table(spark, d, "documents").write.format("batches").option("path", path).option("size", 50).mode("append").save()
    return spark.read.schema("doc_id long, text string, lang string, n_chars long").json(path).select("doc_id", "lang", "n_chars", F.md5("text").alias("md5"))


@query(f"select doc_id, chunk_index, chunk from ({s_walk('case when z >= n then n when z - 200 > a then z - 200 else z end')})")
def chunk_table_function(spark, d):
    """The walk from SQL."""
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_to_chunk")
    return spark.sql("""select * from chunk(table(select doc_id, text from documents_to_chunk), 'text', 'walk', '{"size": 1000, "overlap": 200}')""")


@query("select count(*) as documents, min(place) as least, max(place) as most, count(distinct place) as places from (select row_number() over () - 1 as place from documents)")
def shuffle_places(spark, d):
    """The keyed permutation of all documents has every place once."""
    p = permute.permuted(table(spark, d, "documents").select("doc_id"), "doc_id")
    return p.agg(F.count(F.lit(1)).alias("documents"), F.min("place").alias("least"), F.max("place").alias("most"), F.count_distinct("place").alias("places"))
