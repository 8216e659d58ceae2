"""Queries for the driver, one or more for each operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions import vectors as V
from corpusloom.operators import cache, chunk, clean, datasets, embed, rag, reports, store, strategies, vector_store
from corpusloom.plans import flows
from corpusloom.session import shared_path
from corpusloom.sources import readers, writers
from corpusloom.sources.adapters import articles, embedded, table
from corpusloom.streaming import flows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is there already")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- SQL pieces shared by the oracles

W = r"\p{L}\p{N}_"


def s_rep(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def s_strip(x: str) -> str:
    return s_rep(x, r"^\s+|\s+$")


def s_collapse(x: str) -> str:
    return f"trim({s_rep(x, chr(92) + 's+', ' ')})"


def s_web(x: str) -> str:
    x = f"coalesce({x}, '')"
    for p in (r"https?://[!$-_a-z]+", r"<[^>]+>", r"\[edit\]", r"\{\{[^}]*\}\}", r"&[a-zA-Z]+;"):
        x = s_rep(x, p, " ")
    return s_strip(s_rep(s_collapse(x), rf"[^{W}\s.!?,;:\-'\"]"))


def s_typed(x: str) -> str:
    return s_strip(s_rep(s_rep(f"coalesce({x}, '')", r"\s+", " "), rf"[^{W}\s.,!?;:\-()\[\]{{}}\"'/\\]"))


def s_prose(x: str) -> str:
    return s_collapse(s_rep(f"coalesce({x}, '')", rf"[^{W}\s.,!?']", " "))


def s_sentences(x: str) -> str:
    """x has single spaces only."""
    kept = s_rep(x, rf"([{W}]\.[{W}].|[A-Z][a-z]\.) ", r"\1" + "\x01")
    cut = s_rep(kept, r"([.?!]) ", r"\1" + "\x02")
    return f"list_filter(list_transform(string_split({cut}, '\x02'), lambda s: trim(replace(s, '\x01', ' '))), lambda s: s <> '')"


def s_pack(x: str, least: int, most: int) -> str:
    """The packed pieces of a list of sentences."""
    folded = (
        f"list_reduce(list_transform({x}, lambda s: {{'cur': s, 'out': []::varchar[]}}), lambda a, s: case when length(a.cur) + length(s.cur) <= {most} then {{'cur': a.cur || s.cur || ' ', 'out': a.out}} "
        f"else {{'cur': s.cur || ' ', 'out': case when length(a.cur) >= {least} then list_append(a.out, trim(a.cur)) else a.out end}} end, {{'cur': '', 'out': []::varchar[]}})"
    )
    return f"(select case when length(f.cur) >= {least} then list_append(f.out, trim(f.cur)) else f.out end from (select {folded} as f))"


def s_explode(rows: str, column: str = "o", keep: str = "doc_id") -> str:
    return f"select {keep}, unnest(range(len({column})))::int as chunk_index, unnest({column}) as chunk from ({rows})"


S_SUMMARY = "array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: " + s_strip("s") + "), lambda s: s <> '')[1:3], '. ') || '.'"


def s_summary(x: str) -> str:
    return S_SUMMARY.replace("{x}", x)


NOISY = "text || ' see http://' || source || '.example.com/a_b?x=1;y&amp;z <b>bold</b> [edit] {{tag|' || lang || '}} &nbsp; end'"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---- cleaning


@query(f"select doc_id, {s_web(NOISY)} as clean from documents")
def clean_ing(spark, d):
    return docs(spark, d).select("doc_id", T.clean_web(F.expr(NOISY)).alias("clean"))


@query(f"select doc_id, {s_typed('text')} as clean from documents")
def clean_typ(spark, d):
    return docs(spark, d).select("doc_id", T.clean_typed(F.col("text")).alias("clean"))


@query(f"select doc_id, {s_prose('text')} as clean from documents")
def clean_ins(spark, d):
    return docs(spark, d).select("doc_id", T.clean_prose(F.col("text")).alias("clean"))


@query(f"select doc_id, {s_collapse('text')} as text from documents where length({s_collapse('text')}) > 50")
def clean_fe_minlen(spark, d):
    return clean.feature_documents(articles(spark, d)).select("doc_id", "text")


@query(f"select page_id, {s_web('html')} as clean from pages")
def clean_pages_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_web(F.col("html")).alias("clean"))


S_TITLE = "split_part(text, chr(10), 1)"


@query(f"select doc_id, {s_web(S_TITLE)} as title, case when doc_id % 2 = 0 then {s_web('lang')} else '' end as subtitle, {s_web('text')} as body from documents")
def map_clean_article(spark, d):
    c = clean.map_values(F.col("content"), T.clean_web)
    return articles(spark, d).select("doc_id", c.alias("c")).select("doc_id", F.col("c")["Title"].alias("title"), F.col("c")["Subtitle"].alias("subtitle"), F.col("c")["Content"].alias("body"))


@query(f"select doc_id, concat_ws(chr(10) || chr(10), {S_TITLE}, case when length({s_strip(S_TITLE)}) > 10 then {S_TITLE} end, case when length({s_strip('text')}) > 10 then text end) as main_text from documents")
def extract_main_text(spark, d):
    return articles(spark, d).select("doc_id", clean.main_text(F.col("content"), F.col("title")).alias("main_text"))


@query(f"select doc_id, case when {S_TITLE} <> '' or doc_id % 2 = 0 then concat_ws(chr(10), nullif({S_TITLE}, ''), case when doc_id % 2 = 0 then nullif(lang, '') end, text) else text end as text, 'https://' || source || '/doc/' || doc_id as url from documents where length({s_strip('text')}) >= 10 or doc_id % 2 = 0 and length({S_TITLE}) + length(lang) + length(text) > 9 or length({S_TITLE} || text) >= 9")
def article_text_assemble(spark, d):
    return clean.articles(articles(spark, d).drop("text"), by_parts=True).select("doc_id", "text", "url")


@query(f"select doc_id, {s_typed(f'''concat_ws(' #### ', {S_TITLE}, case when doc_id % 2 = 0 then lang end, text, lang)''')} as clean from documents")
def typed_post_clean(spark, d):
    return articles(spark, d).select("doc_id", clean.joined_values(F.col("content")).alias("clean"))


@query(f"select doc_id, ['posts', 'articles', 'repositories'][doc_id % 3 + 1] as category, {s_typed(f'''concat_ws(' #### ', case when doc_id % 3 = 1 then nullif({S_TITLE}, '') else {S_TITLE} end, case when doc_id % 2 = 0 then lang end, text, lang)''')} as clean, null::varchar as error from documents")
def category_dispatch(spark, d):
    return clean.by_category(articles(spark, d)).select("doc_id", "category", "clean", "error")


@query("select doc_id, case when doc_id % 4 = 0 and trim(text) <> '' then text when doc_id % 4 = 1 then source when doc_id % 4 = 2 then lang else text end as extracted, case when doc_id % 2 = 0 then lang else source end as kind from documents")
def extract_text_and_type(spark, d):
    rows = docs(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(" ").alias("text"), F.when(F.col("doc_id") % 4 == 1, F.col("source")).alias("body"),
        F.create_map(F.lit("Content"), F.when(F.col("doc_id") % 4 == 2, F.col("lang")), F.lit("body"), F.col("text"), F.lit("document_type"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("metadata"), F.col("source").alias("platform"),
    )
    return rows.select("doc_id", clean.document_text(rows).alias("extracted"), clean.document_type(rows).alias("kind"))


@query("select source as repository_name, doc_id || '.md' as file_path, text, 'markdown' as language, n_chars::bigint as file_size from documents where length(trim(text)) >= 10")
def repository_files(spark, d):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    files = F.create_map(name, F.struct(F.col("text").alias("content"), F.col("n_chars").alias("size"), U.file_language(name).alias("language")))
    repos = docs(spark, d).select(F.concat(F.lit("https://github.com/x/"), "source").alias("repository_url"), F.lit("x").alias("owner"), F.col("source").alias("name"), F.lit("2024-01-01").alias("extracted_at"), files.alias("files"))
    return clean.repository_files(repos).select("repository_name", "file_path", "text", "language", "file_size")


@query("select c_custkey, split_part(c_name || ' of ' || c_mktsegment, ' ', 1) as first_name, 'of ' || c_mktsegment as last_name from customer where c_name not like '% %' union all select c_custkey, split_part(c_name, ' ', 1), substr(c_name || ' of ' || c_mktsegment, length(split_part(c_name, ' ', 1)) + 2) from customer where c_name like '% %'")
def split_user_name(spark, d):
    name = F.concat("c_name", F.lit(" of "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", T.first_name(name).alias("first_name"), T.last_name(name).alias("last_name"))


# ---- chunking


def s_fixed(x: str, size: int, overlap: int, first: int = 0) -> str:
    step = size - overlap
    return f"list_transform(range({first}, greatest(1, 1 + ceil((length({x}) - {size}) / {step}.0))::bigint), lambda i: {s_strip(f'substr({x}, (i * {step} + 1)::bigint, {size})')})"


@query(f"select doc_id, chunk_index, case when n <= 300 then t else chunk end as chunk from (select *, unnest(list_transform(range(len(o)), lambda i: i))::int as chunk_index, unnest(o) as chunk from (select doc_id, t, length(t) as n, {s_fixed('t', 300, 30)} as o from (select doc_id, {s_typed('text')} as t from documents))) where chunk <> ''")
def chunk_fixed_post(spark, d):
    rows = docs(spark, d).select("doc_id", T.clean_typed(F.col("text")).alias("t"))
    return chunk.post_chunks(rows, F.col("t"), ["doc_id"])


@query(f"""with t as (select doc_id, {s_typed('text')} as t from documents)
select doc_id, 0 as chunk_index, t as chunk, 'description' as part from t where trim(t) <> ''
union all select doc_id, i::int, chunk, 'description_part' from (select doc_id, unnest(range(len(o))) as i, unnest(o) as chunk from (select doc_id, {s_fixed('t', 800, 0)} as o from t where length(t) > 800)) where i >= 1 and chunk <> ''""")
def chunk_repository(spark, d):
    rows = docs(spark, d).select("doc_id", T.clean_typed(F.col("text")).alias("t"))
    return chunk.repository_chunks(rows, F.col("t"), ["doc_id"])


def s_packed(x: str, least: int, most: int) -> str:
    return s_explode(f"select doc_id, {s_pack(s_sentences('t'), least, most)} as o from (select doc_id, {x} as t from documents)")


@query(f"select doc_id, chunk_index, chunk, doc_id || '_chunk_' || chunk_index as chunk_id, md5(chunk) as content_hash from ({s_packed(s_typed('text'), 50, 2000)})")
def chunk_sentence_pack(spark, d):
    rows = docs(spark, d).select("doc_id", T.clean_typed(F.col("text")).alias("t"))
    return chunk.with_ids(chunk.explode(rows, chunk.by_sentences(F.col("t"), 50, 2000), ["doc_id"]))


@query(s_packed(s_typed("text"), 1000, 1000))
def chunk_article_compat(spark, d):
    rows = docs(spark, d).select("doc_id", T.clean_typed(F.col("text")).alias("t"))
    return chunk.explode(rows, chunk.by_sentences(F.col("t"), 1000, 1000), ["doc_id"])


@query(s_explode(f"select doc_id, case when length(t) < 50 then []::varchar[] when length(t) <= 2000 then [t] else {s_pack(s_sentences('t'), 50, 2000)} end as o from (select doc_id, {s_prose('text')} as t from documents)"))
def extract_substrings(spark, d):
    return chunk.explode(docs(spark, d), chunk.extracts(F.col("text")), ["doc_id"])


S_WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def s_pack_words(x: str, full: int = 800) -> str:
    folded = f"list_reduce(list_transform({S_WORDS.replace('{x}', x)}, lambda s: {{'cur': s, 'out': []::varchar[]}}), lambda a, s: case when length(case when a.cur = '' then s.cur else a.cur || ' ' || s.cur end) >= {full} then {{'cur': '', 'out': list_append(a.out, case when a.cur = '' then s.cur else a.cur || ' ' || s.cur end)}} else {{'cur': case when a.cur = '' then s.cur else a.cur || ' ' || s.cur end, 'out': a.out}} end, {{'cur': '', 'out': []::varchar[]}})"
    return f"(select case when f.cur <> '' then list_append(f.out, f.cur) else f.out end from (select {folded} as f))"


@query(s_explode(f"select doc_id, {s_pack_words('text')} as o from documents"))
def chunk_words_800(spark, d):
    return chunk.explode(docs(spark, d), chunk.by_words(F.col("text")), ["doc_id"])


DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"
S_PARAGRAPHS = f"list_filter(list_transform(string_split({DOUBLED}, chr(10) || chr(10)), lambda s: {s_strip('s')}), lambda s: s <> '')"


@query(s_explode(f"select doc_id, list_transform(range(0, ceil(len(p) / 3.0)::bigint), lambda g: array_to_string(p[g * 3 + 1 : g * 3 + 3], chr(10) || chr(10))) as o from (select doc_id, {S_PARAGRAPHS} as p from documents)"))
def chunk_paragraphs_3(spark, d):
    return chunk.explode(docs(spark, d), chunk.paragraph_groups(F.expr(DOUBLED)), ["doc_id"])


S_SECTIONS = f"select doc_id, unnest(list_filter(p, lambda s: length(s) > 100)) as s from (select doc_id, {S_PARAGRAPHS} as p from documents)"


@query(f"select doc_id, unnest(case when length(s) > 1000 then {s_pack_words('s', 799)} else [s] end) as chunk from ({S_SECTIONS})")
def raw_text_sections(spark, d):
    """All sections, long ones split by words."""
    return docs(spark, d).select("doc_id", F.explode(chunk.raw_sections(F.expr(DOUBLED))).alias("chunk"))


@query("select doc_id, unnest(['description', 'topics', 'languages']) as section, unnest([text, 'Topics: ' || source || ', ' || lang, 'Languages: ' || lang]) as chunk from documents where doc_id % 2 = 0 union all select doc_id, null, 'Repository: ' || source from documents where doc_id % 2 = 1")
def section_chunks(spark, d):
    even = F.col("doc_id") % 2 == 0
    rows = docs(spark, d).select("doc_id", F.col("source").alias("name"), F.when(even, F.col("text")).alias("description"), F.when(even, F.array("source", "lang")).alias("topics"), F.when(even, F.array("lang")).alias("languages"))
    return chunk.section_chunks(rows, ["doc_id"])


@query(f"select count(*) as chunks, min(length(chunk)) as shortest, max(length(chunk)) as longest, round(avg(length(chunk)), 6) as mean_length, count(distinct doc_id) as documents from ({s_packed(s_typed('text'), 50, 2000)})")
def chunk_stats(spark, d):
    return reports.chunk_stats(chunk_sentence_pack(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


@query()
def chunk_recursive(spark, d):
    return chunk.python_chunks(docs(spark, d), "text", ["doc_id"], "recursive", size=800, overlap=200)


def s_after(mark: str) -> str:
    """Where the last mark of the window ends, if it holds one."""
    return f"case when strpos(reverse(w), reverse({mark})) > 0 then a + length(w) - strpos(reverse(w), reverse({mark})) + 1 end"


def s_walk(then: str) -> str:
    """The separator walk; then: the next start, from start a and end z of a text of n characters."""
    marks = ", ".join(s_after(m) for m in ("'. '", "'! '", "'? '", "chr(10) || chr(10)"))
    step = f"select doc_id, i, a, n, case when a + 1000 < n then coalesce({marks}, a + 1000) else a + 1000 end as z from (select x.*, substring(text, a + 1, 1000) as w from x join documents using (doc_id))"
    return f"""
with recursive long as (select doc_id, length(text) as n from documents where length(text) > 1000),
v as (
  select doc_id, i, a, n, z from (with x as (select doc_id, 0 as i, 0::bigint as a, n from long) {step})
  union all
  select doc_id, i, a, n, z from (with x as (select doc_id, i + 1 as i, {then} as a, n from v where {then} < n) {step})
)
select doc_id, i::int as chunk_index, c as chunk, null::varchar as error from (select doc_id, i, {s_strip('substring(text, a + 1, z - a)')} as c from v join documents using (doc_id)) where c <> ''
union all select doc_id, 0, text, null from documents where length(text) between 1 and 1000
"""


@query(s_walk("case when z >= n then n when z - 200 > a then z - 200 else z end"))
def chunk_walk(spark, d):
    return chunk.python_chunks(docs(spark, d), "text", ["doc_id"], "walk", size=1000, overlap=200)


@query(s_walk("greatest(a + 1, z - 200)"))
def chunk_walk_compat(spark, d):
    return chunk.python_chunks(docs(spark, d), "text", ["doc_id"], "walk", size=1000, overlap=200, compat=True)


S_BREAK = f"(line like '#%' or {s_strip('line')} = '')"


@query(f"""
with l as (
  select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line
  from (select doc_id, string_split('# ' || replace({DOUBLED}, chr(10) || chr(10), chr(10) || chr(10) || '## '), chr(10)) as ls from documents)
), g as (select *, sum(case when {S_BREAK} then 1 else 0 end) over (partition by doc_id order by i) as g from l),
s as (select doc_id, g, {s_strip("string_agg(line, chr(10) order by i)")} as c from g where {s_strip('line')} <> '' group by doc_id, g)
select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as chunk_index, c as chunk,
  case when c like '#%' then {s_strip("regexp_replace(split_part(c, chr(10), 1), '^#+', '')")} else left(split_part(c, chr(10), 1), 100) end as title
from s where length(c) > 50
""")
def heading_sections(spark, d):
    rows = docs(spark, d).select("doc_id", F.regexp_replace(F.concat(F.lit("# "), F.expr(DOUBLED)), "\n\n", "\n\n## ").alias("t"))
    parts = chunk.explode(rows, chunk.heading_sections(F.col("t")), ["doc_id"])
    return parts.withColumn("title", chunk.section_title(F.col("chunk")))


# ---- vectors

S_Q0 = "(select embedding::double[] from embeddings where vec_id = 0)"


def s_topk(score: str, k: int, where: str = "true", more: str = "") -> str:
    return f"select vec_id, round({score}, 4) + 0.0 as score from embeddings where {where} order by {score} desc, vec_id limit {k}" + more


S_COS = f"list_cosine_similarity(embedding::double[], {S_Q0})"


def q0(spark, d) -> list[float]:
    return [float(x) for x in embedded(spark, d).filter("vec_id = 0").select("embedding").first()[0]]


def scored(df: DataFrame) -> DataFrame:
    return df.select("vec_id", (F.round("score", 4) + 0.0).alias("score"))  # no negative zero


@query(s_topk(S_COS, 10))
def vector_topk_cosine(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 10))


@query(s_topk(f"list_inner_product(embedding::double[], {S_Q0})", 10))
def vector_topk_dot(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 10, "dot"))


@query(s_topk(f"-list_distance(embedding::double[], {S_Q0})", 10))
def vector_topk_l2(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 10, "euclid"))


@query(s_topk(S_COS, 10, "label = 3"))
def vector_filtered_topk(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 10, where={"label": 3}))


@query(f"select vec_id, round(s, 4) as score from (select vec_id, label, {S_COS} as s from embeddings order by s desc, vec_id limit 50) where label = 3 and s >= 0.0")
def vector_postfilter_compat(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 50, where={"label": 3}, threshold=0.0, post_filter=True))


@query(s_topk(S_COS, 100, f"{S_COS} >= 0.1"))
def vector_threshold(spark, d):
    return scored(vector_store.search(embedded(spark, d), q0(spark, d), 100, threshold=0.1))


@query("select query_id, vec_id, round(s, 4) as score, rank::int as rank from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s, row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q) where rank <= 5")
def vector_many_queries(spark, d):
    e = embedded(spark, d)
    hits = vector_store.search_many(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return hits.withColumn("score", F.round("score", 4))


def s_many(score: str, k: int = 5, where: str = "true") -> str:
    """The k best rows for every query vector; score of e and q."""
    ranked = f"select q.vec_id as query_id, e.vec_id, {score} as s, row_number() over (partition by q.vec_id order by round({score}, 12) desc, e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q where {where}"
    return f"select query_id, vec_id, round(s, 4) + 0.0 as score, rank::int as rank from ({ranked}) where rank <= {k}"


def many(spark, d, rows: DataFrame, least: float = -1e300, **options) -> DataFrame:
    queries = embedded(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = vector_store.search_many(rows, queries, **options).filter(F.col("score") >= least)
    return hits.withColumn("score", F.round("score", 4) + 0.0)


@query(s_many("list_dot_product(e.embedding::double[], q.embedding::double[])"))
def vector_many_queries_dot(spark, d):
    return many(spark, d, embedded(spark, d), metric="dot")


@query(s_many("-list_distance(e.embedding::double[], q.embedding::double[])"))
def vector_many_queries_l2(spark, d):
    return many(spark, d, embedded(spark, d), metric="euclid")


@query(s_many("list_cosine_similarity(e.embedding::double[], q.embedding::double[])", 7, "e.label < 5"))
def vector_many_queries_filtered(spark, d):
    return many(spark, d, embedded(spark, d).filter("label < 5"), k=7)


@query(s_many("list_cosine_similarity(e.embedding::double[], q.embedding::double[])", 20).replace("where rank <= 20", "where rank <= 20 and s >= 0.3"))
def vector_many_queries_threshold(spark, d):
    """The best of each query that reach a least score."""
    return many(spark, d, embedded(spark, d), k=20, least=0.3)


@query("select doc_id, model, case when model = 'text-embedding-3-large' then 3072 else 1536 end as size from (select doc_id, ['text-embedding-3-large', 'text-embedding-3-small', 'text-embedding-ada-002', 'another-model'][doc_id % 4 + 1] as model from documents)")
def embedding_dimensions(spark, d):
    """Of the model that each document is to be embedded by."""
    names = ("text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002", "another-model")
    rows = docs(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 4 + 1).cast("int")).alias("model"))
    return rows.withColumn("size", embed.dimensions(F.col("model")))


@query(f"with p as (select vec_id, {S_COS} as s from embeddings where label < 5 and {S_COS} >= 0.3 order by s desc, vec_id limit 10), f as (select vec_id, {S_COS} as s from embeddings where label >= 5 order by s desc, vec_id limit 10) select vec_id, round(s, 4) as score from (select * from p union all select vec_id, s from (select *, row_number() over (order by s desc, vec_id) as r from f) where r <= 10 - (select count(*) from p)) order by s desc, vec_id limit 10")
def hybrid_merge(spark, d):
    e, q = embedded(spark, d), q0(spark, d)
    first = vector_store.search(e.filter("label < 5"), q, 10, threshold=0.3).select("vec_id", "score")
    rest = vector_store.search(e.filter("label >= 5"), q, 10).select("vec_id", "score")
    return scored(vector_store.merge(first, rest, 10))


@query("select count(*) as n, max(len(embedding)) as dimension, round(avg(nrm), 4) as mean_norm, round(stddev_pop(nrm), 4) as std_norm from (select embedding, sqrt(list_inner_product(embedding::double[], embedding::double[])) as nrm from embeddings)")
def embedding_stats(spark, d):
    return vector_store.embedding_stats(embedded(spark, d)).select("n", "dimension", F.round("mean_norm", 4).alias("mean_norm"), F.round("std_norm", 4).alias("std_norm"))


@query("select doc_id, 384 as size, 0.0::double as total from documents")
def mock_embed_384(spark, d):
    return docs(spark, d).select("doc_id", embed.zeros().alias("e")).select("doc_id", F.size("e").alias("size"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query(f"""
with w as (select doc_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[{W}]+'))), 1, 8))::bigint as h from documents),
c as (select doc_id, (h >> 1) % 384 as slot, sum(case when h & 1 = 1 then 1 else -1 end) as v from w group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) as n from c group by 1),
e as (select doc_id, list((case when n > 0 then coalesce(v, 0) / n else 0 end)::float order by slot) as embedding
      from documents cross join (select unnest(range(384)) as slot) s left join c using (doc_id, slot) left join n using (doc_id) group by 1)
select doc_id, embedding, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from e""")
def embed_hashing(spark, d):
    return embed.embed(docs(spark, d).select("doc_id", "text"), "text").select("doc_id", "embedding", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("select vec_id, (row_number() over (order by vec_id) - 1)::bigint as position, len(embedding) as size from embeddings")
def vector_positions(spark, d):
    return vector_store.with_positions(table(spark, d, "embeddings")).select("vec_id", "position", F.size("embedding").alias("size"))


@query("select n, round(m, 4) as mean_bytes, round(m * n / 1048576, 6) as payload_mb, case when m * n / 1048576 < 30 then 'primary' else 'local' end as store from (select (select count(*) from documents) as n, (select avg(strlen('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\",\"lang\":\"' || lang || '\"}')) from (select * from documents order by doc_id limit 5)) as m)")
def payload_estimate(spark, d):
    p = vector_store.payload_mb(docs(spark, d), ["doc_id", "source", "lang"], "doc_id")
    return p.select("n", F.round("mean_bytes", 4).alias("mean_bytes"), F.round("payload_mb", 6).alias("payload_mb"), vector_store.route(F.col("payload_mb")).alias("store"))


@query("select case when vec_id % 3 = 0 then 'primary' else 'local' end as store, count(*) as vectors, max(len(embedding)) as dimension from embeddings group by 1 union all select null, count(*), max(len(embedding)) from embeddings")
def collection_info(spark, d):
    return vector_store.info(embedded(spark, d).withColumn("store", F.when(F.col("vec_id") % 3 == 0, "primary").otherwise("local")))


@query("select vec_id, (row_number() over (order by vec_id) - 1)::int as chunk_index from embeddings where label = 2")
def doc_chunks_ordered(spark, d):
    from pyspark.sql import Window

    rows = embedded(spark, d).withColumn("chunk_index", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return vector_store.document_chunks(rows, 2).select("vec_id", "chunk_index")


@query("select vec_id, 'chunk_' || vec_id as chunk_id from embeddings where vec_id = 17")
def chunk_by_id(spark, d):
    return vector_store.by_chunk_id(embedded(spark, d), "chunk_17").select("vec_id", "chunk_id")


@query("select vec_id from embeddings where vec_id > 100 order by vec_id limit 21")
def keyset_page(spark, d):
    return vector_store.page(embedded(spark, d), 100, 20).select("vec_id")


@query("select case when label = 0 then 'cleaned_' else 'embedded_' end || ['post', 'article', 'repository', 'article'][vec_id % 4 + 1] || 's' as target, count(*) as n from embeddings group by 1")
def group_by_class(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("post", "article", "repository", "video"))), (F.col("vec_id") % 4 + 1).cast("int"))
    vector = F.when(F.col("label") != 0, F.col("embedding"))
    return embedded(spark, d).groupBy(vector_store.target(kind, vector).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("select label, batch::bigint as batch, count(*) as n from (select label, (row_number() over (partition by label order by vec_id) - 1) // 4 as batch from embeddings) group by all")
def batches_of_4(spark, d):
    e = embedded(spark, d)
    return e.withColumn("batch", vector_store.batch_id(F.col("vec_id"), 4, ["label"])).groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"))


# ---- stores, joins and reports


@query("select doc_id, source, lang from documents where source = 'src3' and lang = 'en' order by doc_id limit 1")
def find_first(spark, d):
    return store.find(docs(spark, d), "doc_id", source="src3", lang="en", missing=None).select("doc_id", "source", "lang")


@query("select doc_id, s from (select doc_id, case when doc_id % 7 = 0 then null else source end as s from documents) where s is null")
def find_all_eqnull(spark, d):
    return store.find_all(docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("s")), s=None)


S_NAMES = "select distinct case when c_custkey % 2 = 0 then c_name else 'New ' || c_name end as full_name from customer"


@query(f"select full_name, coalesce(id, md5(coalesce(full_name, ''))) as id from ({S_NAMES}) w left join (select c_name, min(c_custkey::varchar) as id from customer group by 1) f on c_name is not distinct from full_name")
def get_or_create(spark, d):
    """Every customer's name, half of them as names that no customer has."""
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("full_name"))
    names = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("New "), "c_name")).alias("full_name"))
    return store.get_or_create_each(users, names, "id")


@query("select doc_id, case when doc_id % 5 = 0 then upper(lang) else lang end as lang, case when doc_id % 5 = 0 then 'new' else 'old' end as version from documents")
def upsert_latest(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", F.lit("old").alias("version"))
    new = docs(spark, d).filter("doc_id % 5 = 0").select("doc_id", F.upper("lang").alias("lang"), F.lit("new").alias("version"))
    return store.upsert(rows, new, "doc_id")


@query("select link, min(doc_id) as doc_id from (select doc_id, source || '/' || (n_chars % 50) as link from documents) group by 1")
def dedup_by_link(spark, d):
    rows = docs(spark, d).select("doc_id", F.concat_ws("/", "source", (F.col("n_chars") % 50).cast("string")).alias("link"))
    return store.latest(rows, ["link"], F.col("doc_id")).select("link", "doc_id")


@query("select page_id, url from pages where url not in (select url from pages where page_id % 3 = 0)")
def incremental_anti_join(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return store.not_seen(p, p.filter("page_id % 3 = 0"), "url").select("page_id", "url")


@query("select page_id, url from pages where url in (select url from pages where page_id % 3 = 0)")
def crawled_lookup(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return store.seen(p, p.filter("page_id % 3 = 0"), "url").select("page_id", "url")


@query("select 'Author ' || source as full_name, source as author_id, doc_id from documents where source in ('src1', 'src2', 'src5')")
def author_articles_join(spark, d):
    a = articles(spark, d)
    users = a.select(F.col("author_id").alias("id"), F.col("author_full_name").alias("full_name")).distinct()
    names = users.filter("id in ('src1', 'src2', 'src5')").select("full_name").unionByName(spark.range(1).select(F.lit("Nobody").alias("full_name")))
    return store.author_articles(names, users, a.select("author_id", "doc_id")).select("full_name", "author_id", "doc_id")


@query("select ['posts', 'articles', 'repositories'][doc_id % 3 + 1] as collection, source as author_id, doc_id from documents where source in ('src1', 'src4')")
def warehouse_union(spark, d):
    a = articles(spark, d).select("author_id", "doc_id", "category")
    who = spark.createDataFrame([("src1",), ("src4",)], "author_id string")
    parts = {c: a.filter(F.col("category") == c).drop("category") for c in ("posts", "articles", "repositories")}
    return store.warehouse(who, **parts).select("collection", "author_id", "doc_id")


S_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"


@query(f"select {S_HOST} as domain, count(*) filter (page_id % 4 <> 0) as successful, count(*) as total from pages group by 1")
def domain_success(spark, d):
    p = table(spark, d, "pages").select(U.netloc(F.col("url")).alias("domain"), (F.col("page_id") % 4 != 0).alias("ok"))
    return reports.domain_success(p, "domain", "ok")


S_GROUP = "case when url2 like '%medium%' then 'medium' when url2 like '%github%' then 'github' when url2 like '%linkedin%' then 'linkedin' when url2 like '%substack%' then 'substack' else 'personal_blogs' end"
URL2 = "replace(url, 'example', ['medium', 'github', 'www.linkedin', 'substack', 'example'][page_id % 5 + 1])"
SPARK_URL2 = "replace(url, 'example', element_at(array('medium', 'github', 'www.linkedin', 'substack', 'example'), cast(page_id % 5 + 1 as int)))"


def pages2(spark, d) -> DataFrame:
    return table(spark, d, "pages").withColumn("url2", F.expr(SPARK_URL2))


@query(f"with p as (select page_id, {URL2} as url2 from pages) select {S_GROUP} as platform, url2, count(*) over (partition by {S_GROUP}) as count from p where page_id % 4 <> 0")
def crawled_links(spark, d):
    p = pages2(spark, d).filter("page_id % 4 <> 0").select(U.link_group(F.col("url2")).alias("platform"), "url2")
    return reports.crawled_links(p, "platform", "url2")


@query(f"with p as (select *, {URL2} as url2 from pages), g as (select {S_GROUP} as platform, page_id % 4 <> 0 as ok from p) select platform, count(*) as links, count(*) filter (ok) as crawled, round(count(*) filter (ok) / count(*)::double, 6) as success_rate from g group by 1 union all select null, count(*), count(*) filter (ok), round(count(*) filter (ok) / count(*)::double, 6) from g")
def crawl_report(spark, d):
    p = pages2(spark, d).select(U.link_group(F.col("url2")).alias("platform"), "url2", (F.col("page_id") % 4 != 0).alias("ok"))
    return reports.crawl_report(p, "platform", "url2", "ok").withColumn("success_rate", F.round("success_rate", 6))


@query("select ['posts', 'articles', 'repositories'][doc_id % 3 + 1] as collection, count(*) as documents, array_to_string(list_sort(list_distinct(list(source))), ',') as authors from documents group by 1")
def collection_authors(spark, d):
    r = reports.collection_authors(articles(spark, d), "category", "author_id")
    return r.select(F.col("category").alias("collection"), "documents", F.array_join("authors", ",").alias("authors"))


@query("select category, count(*) as n from (select case when t like '%University%' then 'Education' when t like '%Cisco%' or t like '%KPMG%' or t like '%Colt%' or t like '%Visa%' then 'Work Experience' when t like '%Skills%' or t like '%ML Engineer%' then 'Professional Info' else 'Other' end as category from (select ['at University', 'Visa desk', 'Skills list', 'notes'][doc_id % 4 + 1] || ' ' || lang as t from documents)) group by 1")
def title_categories(spark, d):
    t = F.concat(F.element_at(F.array(*map(F.lit, ("at University", "Visa desk", "Skills list", "notes"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "), "lang")
    return docs(spark, d).groupBy(reports.title_category(t).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("select kind, count(*) as n from (select case when doc_id % 3 = 0 then 'code' when doc_id % 3 = 1 then 'article' else 'other' end as kind from documents) group by 1 union all select null, count(*) from documents")
def ingest_counters_rollup(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("code", "article", "tweet"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return reports.counters(docs(spark, d).withColumn("kind", reports.ingest_bucket(kind)), "kind")


@query("select source as file, count(*)::bigint as documents, sum(n_chars // 1000 + 1)::bigint as chunks from documents group by 1 union all select null, count(*), sum(n_chars // 1000 + 1)::bigint from documents")
def directory_rollup(spark, d):
    rows = docs(spark, d).select(F.col("source").alias("file"), F.lit(1).cast("long").alias("documents"), F.expr("n_chars div 1000 + 1").alias("chunks"))
    return reports.file_rollup(rows, "file")


# ---- URLs, files and pages


@query(f"select page_id, {S_HOST} as host from pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", U.netloc(F.col("url")).alias("host"))


@query(f"select page_id, case when h like '%medium.com%' then 'medium' when h like '%linkedin.com%' then 'linkedin' when h like '%substack.com%' then 'substack' when h like '%github.com%' then 'github' else 'unknown' end as platform from (select page_id, {S_HOST} as h from (select page_id, {URL2} as url from pages))")
def detect_platform(spark, d):
    return pages2(spark, d).select("page_id", U.platform(F.col("url2")).alias("platform"))


S_FILES = "['a/main.py', 'Dockerfile', 'x.y/README.MD', 'lib.tar.gz', '.bashrc', 'q.sql', 'app.Dockerfile', 'style.scss'][page_id % 8 + 1]"
SPARK_FILES = "element_at(array('a/main.py', 'Dockerfile', 'x.y/README.MD', 'lib.tar.gz', '.bashrc', 'q.sql', 'app.Dockerfile', 'style.scss'), cast(page_id % 8 + 1 as int))"


@query(f"select page_id, {S_FILES} as file, ['python', 'unknown', 'markdown', 'unknown', 'unknown', 'sql', 'dockerfile', 'scss'][page_id % 8 + 1] as language, page_id % 8 = 3 or page_id % 10 = 0 as skipped from pages")
def detect_language(spark, d):
    f = F.expr(SPARK_FILES)
    return table(spark, d, "pages").select("page_id", f.alias("file"), U.file_language(f).alias("language"), U.skip_file(f, F.when(F.col("page_id") % 10 == 0, 2 << 20).otherwise(100)).alias("skipped"))


@query(r"select page_id, left(regexp_replace(list_extract(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/'), -1), '[^\p{L}\p{N}\-_]', '_', 'g'), 50) || '_' || (1700000000 + page_id) as name from pages")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", U.safe_name(F.col("url"), F.col("page_id") + 1700000000).alias("name"))


@query("select page_id, md5('article:' || url) as cache_key from pages")
def cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.cache_key(F.lit("article"), F.col("url")).alias("cache_key"))


def cache_table(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "github").otherwise("article")
    at = F.expr("timestamp'2024-01-10 00:00:00' - make_interval(0, 0, 0, 0, cast(page_id as int))")
    return store.latest(p.select(U.cache_key(kind, F.col("url")).alias("cache_key"), "page_id", "url", kind.alias("content_type"), at.alias("cached_at"), F.octet_length("html").cast("long").alias("bytes")), ["cache_key"], F.col("page_id"))


S_CACHE = "cached as (select * from (select page_id, url, case when page_id % 3 = 0 then 'github' else 'article' end as content_type, timestamp '2024-01-10 00:00:00' - to_hours(page_id::int) as cached_at, strlen(html) as bytes, row_number() over (partition by md5(case when page_id % 3 = 0 then 'github' else 'article' end || ':' || url) order by page_id) as rn from pages) where rn = 1)"


@query(f"with {S_CACHE} select p.page_id, coalesce(c.cached_at > timestamp '2024-01-10 00:00:00' - interval 24 hours, false) as hit from pages p left join cached c on c.url = p.url and c.content_type = 'article'")
def cache_fresh(spark, d):
    requests = table(spark, d, "pages").select("page_id", "url", F.lit("article").alias("content_type"))
    return cache.look_up(requests, cache_table(spark, d), F.expr("timestamp'2024-01-10 00:00:00'")).select("page_id", "hit")


@query(f"with {S_CACHE} select count(*) as total_entries, count(*) filter (content_type = 'github') as github_entries, count(*) filter (content_type = 'article') as article_entries, round(sum(bytes) / 1048576.0, 2)::double as cache_size_mb, arg_min(url, page_id * -1) as oldest_entry, arg_max(url, page_id * -1) as newest_entry from cached")
def cache_stats(spark, d):
    return cache.stats(cache_table(spark, d))


@query(f"with {S_CACHE} select page_id, content_type from cached where not (content_type = 'article' and page_id >= 48)")
def cache_clear(spark, d):
    return cache.clear(cache_table(spark, d), F.expr("timestamp'2024-01-10 00:00:00'"), "article", 48).select("page_id", "content_type")


@query("select page_id, case when u like 'https://medium.com%' or u like 'https://www.medium.com%' then 'medium' when u like 'https://github.com%' or u like 'https://www.github.com%' then 'github' else 'custom' end as handler from (select page_id, ['https://medium.com/@a/b', 'https://www.github.com/x/y', 'http://medium.com/a', 'https://b.medium.com/c'][page_id % 4 + 1] as u from pages)")
def crawler_dispatch(spark, d):
    u = F.element_at(F.array(*map(F.lit, ("https://medium.com/@a/b", "https://www.github.com/x/y", "http://medium.com/a", "https://b.medium.com/c"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", U.dispatch(u, {"medium.com": "medium", "github.com": "github"}).alias("handler"))


@query("select page_id, ['profile', 'repository', 'repository', null, null][page_id % 5 + 1] as kind, ['article', 'profile', 'post', 'other', 'post'][page_id % 5 + 1] as professional from pages")
def github_url_kind(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("page_id") % 5 + 1).cast("int"))
    code = pick("https://github.com/x", "https://github.com/x/y/", "https://github.com/x/y/tree/z?a=1", "https://gist.github.com/x/y", "https://github.com/")
    work = pick("https://l.com/pulse/a", "https://l.com/in/a", "https://l.com/posts/a", "https://l.com/jobs", "https://l.com/feed/update/1")
    return table(spark, d, "pages").select("page_id", U.code_host_kind(code).alias("kind"), U.professional_link_kind(work).alias("professional"))


@query("select page_id, case page_id % 4 when 0 then 'https://medium.com/@ann/post-' || page_id when 1 then 'https://medium.com/@ann' when 2 then 'https://medium.com/@ann/x' else 'https://other.org/@ann/x' end as target, page_id % 4 in (0, 2) as is_article from pages")
def medium_links(spark, d):
    i = F.col("page_id") % 4
    href = F.when(i == 0, F.concat(F.lit("https://medium.com/m/signin?op=x&redirect=https%3A%2F%2Fmedium.com%2F%40ann%2Fpost-"), F.col("page_id").cast("string"), F.lit("&source=y"))).when(i == 1, "https://medium.com/@ann").when(i == 2, "https://medium.com/@ann/x").otherwise("https://other.org/@ann/x")
    return table(spark, d, "pages").select("page_id", U.redirect_target(href).alias("target"), U.is_article_of(href, F.lit("https://medium.com/@ann")).alias("is_article"))


def s_page_text(x: str) -> str:
    for t in ("script", "style", "nav", "footer", "header"):
        x = s_rep(x, rf"(?is)<{t}\b.*?</{t}>", " ")
    return s_collapse(s_rep(s_rep(x, r"(?s)<[^>]*>", " "), "&[a-zA-Z]+;|&#[0-9]+;", " "))


@query(f"select page_id, {s_collapse(chr(34) + 't' + chr(34))} as title, {s_page_text('html')} as content from (select page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as t from pages)")
def html_generic_regex(spark, d):
    return table(spark, d, "pages").select("page_id", H.regex_title(F.col("html")).alias("title"), H.regex_text(F.col("html")).alias("content"))


@query("""select distinct page_id, case when h like '/%' then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || h else h end as link from (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) as h from pages)""")
def page_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("h"))
    return rows.select("page_id", H.absolute(F.col("h"), F.col("url")).alias("link")).distinct()


def s_html_text(tag: str) -> str:
    """The strings of an element that does not nest, each stripped, on lines of their own; the entities that the pages have."""
    parts = f"regexp_split_to_array(regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1), '<[^>]*>')"
    out = f"array_to_string(list_filter(list_transform({parts}, lambda s: {s_strip('s')}), lambda s: s <> ''), chr(10))"
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{letter}')"
    return out


def s_article(title: str, content: str) -> str:
    return f"select page_id, title, content, length(content)::int as content_length from (select page_id, {title} as title, {content} as content from pages)"


@query(s_article(s_html_text("title"), s_html_text("article")))
def html_selectors(spark, d):
    from corpusloom.session import ship

    ship(spark)
    p = table(spark, d, "pages")
    return p.select("page_id", H.extract_article(F.col("html"), U.platform(F.col("url"))).alias("a")).select("page_id", "a.*")


# ---- training sets

S_STRIP_S = s_strip("s")
S_LONG = f"len(list_filter(list_transform(regexp_split_to_array(e, '[.!?]+'), lambda s: {S_STRIP_S}), lambda s: length(s) > 20))"


def s_lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


S_PAIRS = f"""list_filter([
  case when contains(lower(e), 'python') or contains(lower(e), 'code') then {{'instruction': {s_lit(datasets.EXPLAIN)}, 'output': {s_summary('e')}}} end,
  case when contains(lower(e), 'tutorial') or contains(lower(e), 'guide') or contains(lower(e), 'how to') then {{'instruction': {s_lit(datasets.STEPS[0])}, 'output': {s_lit(datasets.STEPS[1])}}} end,
  {{'instruction': {s_lit(datasets.THEMES[0])}, 'output': {s_lit(datasets.THEMES[1])}}}, {{'instruction': {s_lit(datasets.PRACTICE[0])}, 'output': {s_lit(datasets.PRACTICE[1])}}},
  {{'instruction': {s_lit(datasets.TAKEAWAYS)}, 'output': {s_summary('e')}}}], lambda p: p is not null)"""
EXTRA = "case when doc_id % 3 = 0 then ' This is a Python guide.' else '' end"


@query(f"select doc_id, p.instruction as instruction, p.output as output from (select doc_id, unnest(case when {S_LONG} >= 2 then {S_PAIRS} else [{{'instruction': {s_lit(datasets.GENERIC)}, 'output': {s_summary('e')}}}] end) as p from (select doc_id, text || {EXTRA} as e from documents))")
def instruction_fallback_pairs(spark, d):
    return docs(spark, d).select("doc_id", F.inline(datasets.rule_pairs(F.expr(f"text || {EXTRA}"))))


KEYWORD_RULES = [("Describe the background.", ["The ", "Le "], False, 500), ("What was said?", ["tion"], True, 400)]
CONSTANTS = [("Summarize the corpus.", "Invented prose in four languages.")]


@query("select doc_id, 'Describe the background.' as instruction, case when length(text) > 500 then left(text, 500) || '...' else text end as output from documents where contains(text, 'The ') or contains(text, 'Le ') union all select doc_id, 'What was said?', case when length(text) > 400 then left(text, 400) || '...' else text end from documents where contains(lower(text), 'tion') union all select null, 'Summarize the corpus.', 'Invented prose in four languages.'")
def keyword_pairs(spark, d):
    return datasets.keyword_pairs(docs(spark, d), "text", KEYWORD_RULES, CONSTANTS, ["doc_id"])


@query(f"select doc_id, {s_summary('text')} as summary from documents")
def summary3(spark, d):
    return docs(spark, d).select("doc_id", T.summary(F.col("text")).alias("summary"))


S_TITLE_GUESS = f"coalesce(list_filter(list_transform(string_split(text, chr(10))[1:5], lambda s: {s_strip('s')}), lambda s: s <> '' and length(s) < 100 and s not like '#%')[1], '')"


@query(f"select doc_id, {S_TITLE_GUESS} as title from documents")
def title_heuristic(spark, d):
    return docs(spark, d).select("doc_id", T.title_guess(F.col("text")).alias("title"))


@query(f"""select doc_id, x.instruction as instruction, x.input as input, x.output as output from (select doc_id, unnest(list_filter([
  case when length(text) > 200 then {{'instruction': 'Summarize the following ' || source || ' article by Author ' || source || ':', 'input': left(text, 1000), 'output': {s_summary('text')}}} end,
  {{'instruction': 'Analyze the key themes and topics in this ' || source || ' content:', 'input': left(text, 800), 'output': {s_summary('text')}}},
  {{'instruction': 'Generate an engaging title for this content:', 'input': left(text, 500), 'output': case when {S_TITLE_GUESS} <> '' then {S_TITLE_GUESS} else 'Insights from ' || source end}}], lambda x: x is not null)) as x from documents)""")
def varied_examples(spark, d):
    return datasets.varied_examples(articles(spark, d), "text", "platform", "author_full_name", ["doc_id"])


S_TURNS = "turns as (select a.conv_id, a.turn, a.text as instruction, b.text as output from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role in ('user', 'system') and b.role = 'assistant'), alts as (select t.*, u.output as other from turns t left join turns u on u.conv_id = t.conv_id and u.turn = t.turn + 2)"


def turns(spark, d) -> DataFrame:
    return datasets.with_alternatives(datasets.answered_turns(table(spark, d, "conversations")))


@query(f"with {S_TURNS} select conv_id, turn, instruction, case when turn % 4 in (0, 1) then output else coalesce(other, output) end as generated_answer, case when turn % 4 in (0, 1) then coalesce(other, output) else output end as extracted_answer from alts where turn // 2 <= 20")
def preference_triples(spark, d):
    t = turns(spark, d).withColumn("ordinal", F.expr("turn div 2"))
    keyed = t.withColumn("instruction", F.struct("conv_id", "turn", "instruction"))
    p = datasets.preference_triples(keyed, "ordinal", "other")
    return p.select("instruction.*", "generated_answer", "extracted_answer")


@query(f"with {S_TURNS} select {s_lit(datasets.PREFERENCE_PROMPT.split('{}')[0])} || instruction || {s_lit(datasets.PREFERENCE_PROMPT.split('{}')[1])} as prompt, output || '</s>' as chosen, coalesce(other, output) || '</s>' as rejected from (select conv_id, instruction, case when turn % 2 = 0 then output else coalesce(other, output) end as output, case when turn % 2 = 0 then other else output end as other from alts)")
def dpo_rows(spark, d):
    return datasets.preference_rows(datasets.preference_triples(turns(spark, d), "turn", "other", cap=None))


@query(f"with {S_TURNS} select conv_id, turn, {s_lit(datasets.ALPACA.split('{}')[0])} || instruction || {s_lit(datasets.ALPACA.split('{}')[1])} || output || '</s>' as text, trim(output, ' ' || chr(9) || chr(10) || chr(13)) || '</s>' as response from turns")
def alpaca_rows(spark, d):
    text = datasets.alpaca_text(F.col("instruction"), F.col("output"))
    return turns(spark, d).select("conv_id", "turn", text.alias("text"), T.after(text, datasets.RESPONSE_MARK).alias("response"))


@query(f"with {S_TURNS} select conv_id, turn, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Help.' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || instruction || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || output || '<|eot_id|>' as text from turns")
def chat_rows(spark, d):
    return turns(spark, d).select("conv_id", "turn", datasets.chat_text(F.lit("Help."), F.col("instruction"), F.col("output")).alias("text"))


@query("select doc_id, case when ('0x' || substr(md5('42' || doc_id), 1, 8))::bigint < 429496729 then 'test' else 'train' end as split from documents")
def train_test_split(spark, d):
    return datasets.split(docs(spark, d), "doc_id", 0.1).select("doc_id", "split")


@query("select doc_id, lang from documents where lang = 'en' union all (select doc_id, lang from documents where lang <> 'en' order by doc_id limit 100)")
def concat_head(spark, d):
    rows = docs(spark, d).select("doc_id", "lang")
    return store.concat_sets(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"), "doc_id", 100)


@query("""select doc_id, json_extract_string(j, '$.instruction') as instruction, json_extract_string(j, '$.answer') as answer from (select doc_id, unnest([{'instruction': lang, 'answer': source}, {'instruction': source, 'answer': lang}]::json[]) as j from documents)""")
def json_in_text(spark, d):
    from corpusloom.sources.readers import answer_envelope

    text = F.concat(F.lit('Here it is: {"instruction_answer_pairs": [{"instruction": "'), "lang", F.lit('", "answer": "'), "source", F.lit('"}, {"instruction": "'), "source", F.lit('", "answer": "'), "lang", F.lit('"}]} done.'))
    return docs(spark, d).select("doc_id", F.inline(answer_envelope(text)))


@query("select doc_id, md5('42' || doc_id) as shuffle_key from documents")
def shuffled_order(spark, d):
    return datasets.shuffled(docs(spark, d).select("doc_id"), "doc_id")


@query("select doc_id % 4 as form, ['repository', 'article', 'generic', 'error'][doc_id % 4 + 1] as kind, count(*) as n from documents group by all")
def raw_documents(spark, d):
    from corpusloom.sources.readers import raw_documents as read

    i = F.col("doc_id") % 4
    file = F.struct(F.col("text").alias("content"), F.col("n_chars").alias("size"), F.lit("markdown").alias("language"))
    repo = F.to_json(F.struct(F.col("source").alias("name"), F.create_map(F.lit("README.md"), file).alias("files")))
    article = F.to_json(F.struct(F.col("source").alias("url"), F.col("text").alias("content")))
    value = F.when(i == 0, repo).when(i == 1, article).when(i == 2, F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit("]"))).otherwise(F.col("text"))
    return read(docs(spark, d).select(i.cast("string").alias("file"), value.alias("value"))).groupBy(F.col("file").cast("long").alias("form"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id::varchar as id, text as content, source as platform from documents")
def training_articles(spark, d):
    from corpusloom.sources.readers import training_articles as read

    one = F.to_json(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("platform"))))
    value = F.when(F.col("doc_id") % 2 == 0, one).otherwise(F.concat(F.lit('{"artifact_data": '), one, F.lit("}")))
    return read(docs(spark, d).select(value.alias("value"))).select("id", "content", "platform")


@query("select lang as instruction, text as generated_answer, source as extracted_answer from documents")
def preference_envelope(spark, d):
    from corpusloom.sources.readers import preference_triples as read

    rows = F.array(F.struct(F.col("lang").alias("instruction"), F.col("text").alias("generated_answer"), F.col("source").alias("extracted_answer")))
    return read(docs(spark, d).select(F.to_json(F.struct(rows.alias("preference_triples"))).alias("value")))


@query("select case when c_custkey % 2 = 0 then c_custkey::varchar else 'linkedin_user' end as id, c_name as full_name from customer where c_custkey % 3 <> 0")
def profile_users(spark, d):
    from corpusloom.sources.readers import profile_users as read

    row = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("full_name"))
    return read(table(spark, d, "customer").select(F.to_json(row).alias("value")))


@query("select doc_id, case doc_id % 3 when 0 then text when 1 then text when 2 then source || ' ' || lang || ' ' || text end as text from documents where length(trim(text)) >= 10 or doc_id % 3 = 2 and length(source || ' ' || lang || ' ' || text) >= 10")
def generic_documents(spark, d):
    i = F.col("doc_id") % 3
    content = F.when(i == 0, F.create_map(F.lit("Content"), "text", F.lit("x"), "source")).when(i == 1, F.create_map(F.lit("x"), "source", F.lit("content"), "text")).otherwise(F.create_map(F.lit("a"), "source", F.lit("b"), "lang", F.lit("c"), "text"))
    return clean.generic(docs(spark, d).select("doc_id", content.alias("content"))).select("doc_id", "text")


@query("select doc_id, case when doc_id % 2 = 0 then '7' else '384' end as size, 'hashing' as model, lang from documents")
def embedding_metadata(spark, d):
    own = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("embedding_size"), F.lit("7"), F.lit("lang"), "lang")).otherwise(F.create_map(F.lit("lang"), "lang"))
    m = embed.with_metadata(docs(spark, d).select("doc_id", own.alias("metadata")), "hashing", 384, 256)
    return m.select("doc_id", F.col("metadata")["embedding_size"].alias("size"), F.col("metadata")["embedding_model_id"].alias("model"), F.col("metadata")["lang"].alias("lang"))


@query("select vec_id::varchar as id, label, len(embedding)::int as size from embeddings")
def points_round_trip(spark, d):
    points = vector_store.as_points(embedded(spark, d), "vec_id", ["label"])
    return vector_store.as_records(points).select("id", "label", F.size("embedding").alias("size"))


@query("select count(*) as num_chunks, count(*) filter (label <> 0) as num_embedded from embeddings")
def step_metadata(spark, d):
    return reports.step_metadata(embedded(spark, d).withColumn("embedding", F.when(F.col("label") != 0, F.col("embedding"))))


@query()
def chunk_two_stage(spark, d):
    return chunk.python_chunks(docs(spark, d), "text", ["doc_id"], "two_stage")


@query(f"select page_id, 'Post by ' || a as title, {s_page_text('html')} as content, a as author, 'https://www.linkedin.com/posts/1' as link, '' as timestamp, 'www.linkedin.com' as platform from (select page_id, html, regexp_extract(url, '//([^.]*)', 1) as a from pages)")
def html_feed_posts(spark, d):
    from corpusloom.session import ship

    ship(spark)
    part = lambda css, text: F.concat(F.lit(f'<div class="{css}">'), text, F.lit("</div>"))
    post = part("feed-shared-update-v2", F.concat(part("feed-shared-actor__title", F.regexp_extract("url", "//([^.]*)", 1)), part("feed-shared-text", H.regex_text(F.col("html"))), F.lit('<a href="/posts/1">more</a>')))
    return table(spark, d, "pages").select("page_id", F.inline(H.extract_feed(F.concat(post, F.lit('<div class="feed-shared-update-v2">empty</div>')))))


@query(s_article(s_html_text("h1"), f"substr({s_html_text('article')}, 1, 5000)"))
def html_fallback(spark, d):
    from corpusloom.session import ship

    ship(spark)
    return table(spark, d, "pages").select("page_id", H.extract_fallback(F.col("html")).alias("a")).select("page_id", "a.*")


# ---- retrieval


def hits(spark, d) -> DataFrame:
    """Top three of the query vectors with the text of the document of the same number."""
    e = embedded(spark, d)
    h = vector_store.search_many(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)
    info = docs(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("text"), F.col("source").alias("repository_name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"))
    return h.join(info, "vec_id", "left")


S_HITS = "h as (select query_id, vec_id, s as score, rank from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s, row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q) where rank <= 3), r as (select h.*, coalesce(d.text, '') as text, coalesce(nullif(concat_ws(' | ', 'Repo: ' || d.source, case when d.doc_id % 2 = 0 then 'Title: ' || d.lang end), ''), 'Unknown source') as src from h left join documents d on d.doc_id = h.vec_id)"
S_CONTEXT = "select query_id, count(*) as n, string_agg(chr(10) || 'Document ' || rank || ' (Score: ' || printf('%.3f', score) || ')' || chr(10) || 'Source: ' || src || chr(10) || 'Content: ' || text || chr(10) || '---', chr(10) order by rank) as context from r group by 1"


@query(f"with {S_HITS} {S_CONTEXT} union all select -1, 0, 'No relevant documents found.'")
def rag_context(spark, d):
    questions = embedded(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).unionByName(spark.range(1).select((-F.col("id") - 1).alias("query_id")))
    return rag.contexts(hits(spark, d), questions)


@query(f"with {S_HITS}, c as ({S_CONTEXT}) select query_id, 'Question ' || query_id as question, n as context_documents, md5(context) as context_md5, md5('Based on the available context:' || chr(10) || chr(10) || context) as answer_md5, (select string_agg(left(text, 200) || '...', '|' order by rank) from r where r.query_id = c.query_id) as sources from c")
def rag_result_struct(spark, d):
    questions = embedded(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("Question "), F.col("vec_id").cast("string")).alias("question"))
    a = rag.answers(hits(spark, d), questions)
    return a.select("query_id", "question", "context_documents", F.md5("context").alias("context_md5"), F.md5("answer").alias("answer_md5"), F.array_join(F.transform("sources", lambda s: s["text"]), "|").alias("sources"))


@query()
def rag_end_to_end(spark, d):
    path = shared_path(spark, "chunks")
    writers.overwrite(flows.ingest(docs(spark, d)).withColumn("vec_id", F.xxhash64("chunk_id")), path)
    chunks = spark.read.parquet(path)
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return flows.ask(questions, chunks, 3).select("query_id", "context_documents", F.size("sources").alias("sources"))


S_EXTRACTS = s_explode(f"select doc_id, case when length(t) < 50 then []::varchar[] when length(t) <= 2000 then [t] else {s_pack(s_sentences('t'), 50, 2000)} end as o from (select doc_id, {s_prose('text')} as t from documents)")
S_KEY = "doc_id || ':' || piece || ':' || p.instruction"


@query(f"""
select doc_id, piece, p.instruction as instruction, p.output as output, case when ('0x' || substr(md5('42' || {S_KEY}), 1, 8))::bigint < 429496729 then 'test' else 'train' end as split
from (select doc_id, piece, unnest(case when {S_LONG} >= 2 then {S_PAIRS} else [{{'instruction': {s_lit(datasets.GENERIC)}, 'output': {s_summary('e')}}}] end) as p
      from (select doc_id, chunk_index as piece, chunk as e from ({S_EXTRACTS})))""")
def instruction_dataset(spark, d):
    return flows.instructions(docs(spark, d), "text", keep="doc_id").select("doc_id", "piece", "instruction", "output", "split")


# ---- what is written and read back


PAIRS = "select 'Document ' || doc_id as instruction, text as output from documents"


def pairs(spark, d) -> DataFrame:
    return docs(spark, d).select(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("instruction"), F.col("text").alias("output"))


@query("select doc_id::varchar as id, source as platform, text as content from documents")
def collection_round_trip(spark, d):
    """JSON arrays, eight of them or as many as the size asks for, read as one collection."""
    path = shared_path(spark, "collection")
    writers.collection(docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("platform"), F.col("text").alias("content")), path, F.col("id"))
    return readers.collection(spark, f"{path}/*/*.txt", "id string, platform string, content string")


@query("select doc_id::varchar as id, source as platform from documents where doc_id % 2 = 0")
def collection_missing(spark, d):
    """Of two collections one was never written: it has no rows, and those of the other stay."""
    path, schema = shared_path(spark, "collection"), "id string, platform string"
    writers.collection(docs(spark, d).filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("platform")), path, F.col("id"))
    return readers.collection(spark, f"{path}/*/*.txt", schema).unionByName(readers.collection(spark, shared_path(spark, "no-such-file"), schema))


@query(PAIRS)
def pairs_json_round_trip(spark, d):
    path = shared_path(spark, "pairs-json")
    writers.pairs(pairs(spark, d), path)
    return spark.read.schema("instruction string, output string").json(path)


@query(PAIRS)
def pairs_csv_round_trip(spark, d):
    path = shared_path(spark, "pairs-csv")
    writers.pairs(pairs(spark, d), path, "csv")
    return spark.read.schema("instruction string, output string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query(f"select instruction, '' as input, output from ({PAIRS})")
def pairs_alpaca_round_trip(spark, d):
    path = shared_path(spark, "pairs-alpaca")
    writers.pairs(pairs(spark, d), path, "alpaca")
    return spark.read.schema("instruction string, input string, output string").json(path)


@query("select 'Document ' || doc_id as instruction, text as output, case when doc_id % 10 = 0 then 'test' else 'train' end as split from documents")
def dataset_round_trip(spark, d):
    """Both splits written, read and joined to one instruction set."""
    path = shared_path(spark, "dataset")
    rows = docs(spark, d).select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("instruction"), F.col("text").alias("output"))
    writers.dataset(rows.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")).drop("doc_id"), path)
    return readers.instruction_sets(spark.read.parquet(f"{path}/split=train"), spark.read.parquet(f"{path}/split=test"))


@query("select vec_id, 'c' || (vec_id % 3) as collection, len(embedding)::int as size, embedding[1]::double as first from embeddings where vec_id % 5 <> 0")
def vectors_round_trip(spark, d):
    """Two appends to the same collections; rows without a vector stay out."""
    path = shared_path(spark, "vectors")
    rows = embedded(spark, d).select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"), F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("collection"))
    writers.append_vectors(rows.filter("vec_id % 2 = 0"), path)
    writers.append_vectors(rows.filter("vec_id % 2 = 1"), path)
    return spark.read.parquet(path).select("vec_id", "collection", F.size("embedding").alias("size"), F.col("embedding")[0].cast("double").alias("first"))


@query("select doc_id, lang from documents where doc_id % 2 = 1")
def overwrite_and_clear(spark, d):
    """A collection is written, cleared, and written anew."""
    path, rows = shared_path(spark, "rewritten"), docs(spark, d).select("doc_id", "lang")
    writers.overwrite(rows, path)
    writers.clear(spark.read.parquet(path).limit(0), path)
    left = spark.read.parquet(path).count()
    writers.overwrite(rows.filter("doc_id % 2 = 1"), path)
    return spark.read.parquet(path).filter(F.lit(left == 0))


@query("select source as domain, count(*) as total, count(*) filter (doc_id % 2 = 0) as successful from documents group by 1")
def report_round_trip(spark, d):
    path = shared_path(spark, "report")
    writers.report(docs(spark, d).groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("doc_id") % 2 == 0).alias("successful")), path)
    return spark.read.schema("domain string, total long, successful long").json(path)


@query("select trim(x) as question from (select unnest(string_split(text, chr(10))) as x from benchmark) where trim(x) <> ''")
def questions_round_trip(spark, d):
    """A question on each line, with blank lines between."""
    path = shared_path(spark, "questions")
    lines = table(spark, d, "benchmark").select(F.explode(F.array(F.concat(F.lit("  "), "text"), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return readers.questions(spark, path)


# ---- event windows


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    w = streams.windows(table(spark, d, "events"))
    return w.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


# ---- predicates, times and strategies by name


LEAST = (10, 20, 50, 100)


@query(f"select n as least, doc_id from documents, (values {', '.join(f'({n})' for n in LEAST)}) v(n) where length({s_strip('text')}) > n")
def length_thresholds(spark, d):
    long_enough = F.array_compact(F.array(*(F.when(F.char_length(T.strip(F.col("text"))) > n, n) for n in LEAST)))
    return docs(spark, d).select(F.explode(long_enough).alias("least"), "doc_id")


@query("select doc_id, source from documents where source = (select min(source) from documents)")
def platform_equality(spark, d):
    rows = docs(spark, d)
    return store.find_all(rows.select("doc_id", "source"), source=rows.agg(F.min("source")).first()[0])


@query("select doc_id, strftime(timestamp '2024-05-06 07:08:09', '%Y-%m-%dT%H:%M:%S') as crawled_at from documents")
def iso_timestamps(spark, d):
    return docs(spark, d).select("doc_id", T.iso(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("crawled_at"))


S_FIXED = s_explode(f"select doc_id, case when length(t) <= 500 then [t] else list_transform({s_fixed('t', 500, 50)}, lambda x: nullif(x, '')) end as o from (select doc_id, {s_prose('text')} as t from documents)")


@query(f"select * from ({S_FIXED}) where chunk is not null")
def strategies_by_name(spark, d):
    rows = docs(spark, d).select("doc_id", strategies.find(strategies.CLEANERS, "prose")(F.col("text")).alias("t"))
    return strategies.chunked(rows, "t", ["doc_id"], "fixed", size=500, overlap=50)
