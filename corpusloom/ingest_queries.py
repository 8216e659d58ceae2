"""Queries of ingestion: platform pages, typed cleaning, described chunks, rows with errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators import chunk, clean, embed, reports, store
from corpusloom.queries import query, s_strip, s_web
from corpusloom.session import ship
from corpusloom.sources.adapters import articles, table

# ---- pages in each platform's markup, with short titles and missing parts by turns

_TITLE = "case when page_id % 3 = 0 then 'T ' || page_id else 'The title of page ' || page_id end"
_BODY = "'Read ' || url || ', a page of ' || length(html) || ' characters.'"
_HEAD = "'Page ' || page_id || ' in its head'"
_S_PAGES = f"(select page_id, {_TITLE} as t, {_BODY} as b, {_HEAD} as h from pages)"


def _pages(spark, d):
    ship(spark)
    return table(spark, d, "pages").select("page_id", F.expr(_TITLE).alias("t"), F.expr(_BODY).alias("b"), F.expr(_HEAD).alias("h"))


def _page(title: str, body: str):
    """Markup around the columns t, b and h, in which a stroke marks a column's place."""
    parts = [F.lit(x) if k % 2 == 0 else F.col(x) for k, x in enumerate(f"<html><head><title>|h|</title></head><body><nav>menu of the site</nav>{title}{body}<footer>foot of the page</footer></body></html>".split("|"))]
    return F.concat(*parts)


def _markup() -> dict:
    return {
        "medium": _page('<h1 class="pw-post-title x">|t|</h1>', '<div class="pw-post-body"><p>|b|</p><p>and more</p></div>'),
        "linkedin": _page('<div class="share-update-card__title">|t|</div>', "<div data-test-id='post-content'><span>|b|</span><br>and more</div>"),
        "substack": _page('<h3 class="post-title">|t|</h3>', '<div class="body markup"><p>|b|</p><p>and more</p></div>'),
    }


_LONG_T = "case when length(t) > 10 then t else {} end"


@query(
    f"""with p as {_S_PAGES}, x as (
select page_id, 'medium' as platform, {_LONG_T.format('h')} as title from p
union all select page_id, 'linkedin', {_LONG_T.format("''")} from p
union all select page_id, 'substack', {_LONG_T.format("''")} from p)
select page_id, platform, title, b || chr(10) || 'and more' as content, (length(b) + 9)::int as content_length from x join p using (page_id)"""
)
def html_platform_selectors(spark, d):
    """Every page in the markup of every platform with selectors of its own."""
    marked = F.array(*(F.struct(F.lit(k).alias("platform"), m.alias("html")) for k, m in _markup().items()))
    p = _pages(spark, d).select("page_id", F.inline(marked))
    return p.select("page_id", "platform", H.extract_article(F.col("html"), F.col("platform")).alias("a")).select("page_id", "platform", "a.*")


@query(
    f"""with p as {_S_PAGES}
select page_id, case when page_id % 5 <> 0 then t end as "Title", case when page_id % 2 = 0 then 'Sub of ' || page_id end as "Subtitle",
  h || 'menu of the site' || t || 'Sub of ' || page_id || b || 'and more' || 'foot of the page' as "Content", null::varchar as language, false as skipped from p"""
)
def html_medium_articles(spark, d):
    """Sole strings of title and subtitle (a part of them in bold is none), and the whole page's text."""
    t = F.when(F.col("page_id") % 5 != 0, F.col("t")).otherwise(F.concat(F.lit("<b>"), F.substring("t", 1, 1), F.lit("</b>"), F.expr("substr(t, 2)")))
    sub = F.concat(F.lit("<em>"), F.lit("Sub of "), F.col("page_id").cast("string"), F.lit("</em>"))
    sub = F.when(F.col("page_id") % 2 == 0, sub).otherwise(F.concat(F.lit("<em>Sub</em> of "), F.col("page_id").cast("string")))
    p = _pages(spark, d).withColumns({"t": t, "s": sub})
    page = _page('<h1 class="pw-post-title">|t|</h1><h2 class="pw-subtitle-paragraph">|s|</h2>', "<p>|b|</p><p>and more</p>")
    return p.select("page_id", H.extract_crawled(page, F.lit("medium")).alias("a")).select("page_id", "a.*")


@query(
    f"""with p as {_S_PAGES}
select page_id, case when page_id % 4 in (1, 3) then 'LinkedIn Post' else t end as "Title", '' as "Subtitle", case when page_id % 4 in (2, 3) then '' else b || 'and more' end as "Content", 'en' as language
from p where page_id % 4 <> 3"""
)
def html_linkedin_articles(spark, d):
    """Pages by turns whole, without a title, without a content, and with neither, which are skipped."""
    part = lambda cond, before, c, after: F.when(cond, F.concat(F.lit(before), c, F.lit(after))).otherwise(F.lit(""))
    m = F.col("page_id") % 4
    p = _pages(spark, d).withColumns({"x": part(m.isin(0, 2), '<h1 class="break-words"> ', F.col("t"), " </h1>"), "y": part(m.isin(0, 1), '<div class="feed-shared-text"><p>', F.col("b"), "</p><p> and more </p></div>")})
    out = p.select("page_id", H.extract_crawled(_page("|x|", "|y|"), F.lit("linkedin")).alias("a")).select("page_id", "a.*")
    return out.filter("not skipped").drop("skipped")


@query(f"with p as {_S_PAGES} select page_id, url, source as platform, 'basic' as extraction_method, h as title, t || chr(10) || b as content, (length(t) + length(b) + 1)::int as content_length from p join (select page_id, url, 'example' as source from pages) using (page_id)")
def html_basic(spark, d):
    p = _pages(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    a = H.basic(_page("<main><h1>|t|</h1>", "<p>|b|</p></main>"), F.col("url"), F.lit("example"))
    return p.select("page_id", a.alias("a")).select("page_id", "a.*")


# ---- typed cleaning

_KIND = "['article', 'repository', 'note'][doc_id % 3 + 1]"


@query(
    f"""select doc_id, kind, case when error is null then case when kind = 'note' then null else {s_web("source || ' <b>' || lang || '</b>'")} end end as name,
  case when error is not null then null when kind = 'note' then {s_web('text')} else {s_web('text')} end as body,
  case when error is null and kind <> 'note' then {s_web("'topic of ' || lang")} || '|' || {s_web("'&amp; ' || source")} end as topics,
  case when kind = 'article' then {s_web("'<i>' || lang || '</i>'")} else '<i>' || lang || '</i>' end as title, error
from (select *, {_KIND} as kind, case when doc_id % 10 = 0 then 'no content' when doc_id % 10 = 5 and doc_id % 3 <> 2 then 'content is no JSON' when doc_id % 10 = 7 and doc_id % 3 <> 2 then 'content is no object' end as error from documents)"""
)
def typed_documents(spark, d):
    """Cleaning routed by type; content that cannot be read has an error, and the others go on."""
    d_ = table(spark, d, "documents").withColumn("kind_", F.element_at(F.array(*map(F.lit, ("article", "repository", "note"))), (F.col("doc_id") % 3 + 1).cast("int")))
    name = F.concat("source", F.lit(" <b>"), "lang", F.lit("</b>"))
    topics = F.array(F.concat(F.lit("topic of "), "lang"), F.concat(F.lit("&amp; "), "source"))
    whole = F.to_json(F.struct(name.alias("name"), F.col("text").alias("body"), topics.alias("topics"), F.col("n_chars").alias("stars")))
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    plain = F.col("kind_") == "note"
    m = F.col("doc_id") % 10
    content = F.when(m == 0, None).when((m == 5) & ~plain, F.lit("{broken")).when((m == 7) & ~plain, F.lit('"a string"')).when(plain, text).otherwise(whole)
    rows = clean.clean_documents(d_.select("doc_id", "kind_", content.alias("content"), F.concat(F.lit("<i>"), "lang", F.lit("</i>")).alias("title")), F.col("kind_"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return rows.select("doc_id", "kind", get("cleaned", "name").alias("name"), F.coalesce(get("cleaned", "body"), get("cleaned", "content")).alias("body"), F.array_join(get("lists", "topics"), "|").alias("topics"), F.col("cleaned_title").alias("title"), "error")


# ---- chunks with what is said of them


@query(
    f"""with p as (select doc_id, text, lang, unnest(range(0, greatest(1, ceil((length(text) - 30) / 270.0))::bigint)) as i from documents where length(text) > 0),
c as (select doc_id, lang, i, case when length(text) <= 300 then text else {s_strip('substr(text, i * 270 + 1, 300)')} end as chunk from p)
select doc_id, i::int as chunk_index, md5(chunk) as chunk, 'post' as source_type, lang = 'en' as has_image, length(chunk)::int as chunk_size from c where chunk <> ''"""
)
def described_posts(spark, d):
    docs = table(spark, d, "documents").withColumn("image", F.when(F.col("lang") == "en", F.lit("a.png")).when(F.col("lang") == "de", F.lit("")))
    return chunk.described_posts(docs, F.col("text"), F.col("image"), ["doc_id"]).withColumn("chunk", F.md5("chunk"))


@query(
    r"""with f as (select doc_id, case when doc_id % 4 = 3 then lang || chr(10) || chr(10) || text || chr(10) || chr(10) else source || chr(10) || chr(10) || text || chr(10) || chr(10) || case when doc_id % 4 = 0 then lang || chr(10) || chr(10) else '' end end as t from documents),
p as (select doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps from f),
g as (select doc_id, ps, unnest(range(0, ((len(ps) + 2) // 3)::bigint)) as i from p)
select doc_id, i::int as chunk_index, md5(array_to_string(ps[i * 3 + 1 : i * 3 + 3], chr(10) || chr(10))) as chunk, 'article' as type from g"""
)
def article_field_chunks(spark, d):
    """Title, content and description joined, or all values where those are absent; three paragraphs a chunk."""
    d_ = table(spark, d, "documents")
    m = F.col("doc_id") % 4
    other = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("text"))
    known = F.create_map(F.lit("content"), F.col("text"), F.lit("title"), F.col("source"), F.lit("description"), F.when(m == 0, F.col("lang")), F.lit("other"), F.lit("never"))
    docs = d_.select("doc_id", clean.article_fields(F.when(m == 3, other).otherwise(known)).alias("t"))
    return chunk.article_chunks(docs, F.col("t"), ["doc_id"]).withColumn("chunk", F.md5("chunk"))


# ---- rows with errors


def _items(spark, d):
    good = F.to_json(F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).alias("link"), F.col("source").alias("author"), F.col("text").alias("content")))
    broken = F.when(F.col("doc_id") % 11 == 0, F.lit("[1, 2")).when(F.col("doc_id") % 13 == 0, F.lit('{"id": "no number", "link": "x", "author": "a"}')).otherwise(good)
    return store.checked(table(spark, d, "documents").select("doc_id", broken.alias("item")), "id long, link string, author string, content string", ["id", "link", "author"])


_BAD = "doc_id % 11 = 0 or doc_id % 13 = 0 or doc_id % 7 = 0"


@query(f"select 'articles' as kind, count(*) filter (where not ({_BAD})) as ingested, count(*) filter (where {_BAD}) as failed from documents")
def ingest_counts(spark, d):
    return store.ingest_counts("articles", _items(spark, d))


@query(f"select doc_id as id, 'https://x/' || doc_id as link, md5(text) as content from documents where not ({_BAD}) union all select -1, 'kept', md5('old')")
def ingest_rows(spark, d):
    """Good rows replace the stored ones of their link; bad ones stop nothing."""
    rows = _items(spark, d)
    old = table(spark, d, "documents").filter(f"not ({_BAD})").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("link"), F.lit("a").alias("author"), F.lit("old").alias("content"))
    kept = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("kept").alias("link"), F.lit("a").alias("author"), F.lit("old").alias("content"))
    return store.ingest(old.unionByName(kept), rows, "link").select("id", "link", F.md5("content").alias("content"))


@query("select distinct ['posts', 'articles', 'repositories'][doc_id % 3 + 1] as collection, source as author from documents where source is not null")
def collection_author_rows(spark, d):
    return reports.collection_author_rows(articles(spark, d), "category", "author_id")


@query("select model, count(*) as documents, max(case when model = 'text-embedding-3-large' then 3072 else 1536 end)::int as dimension from (select case lang when 'en' then 'text-embedding-3-large' when 'de' then 'text-embedding-3-small' when 'fr' then 'text-embedding-ada-002' else 'model of ' || lang end as model from documents) group by 1")
def embedding_dimensions_by_model(spark, d):
    """The dimension of each model that the documents' languages name."""
    lang = F.col("lang")
    model = F.when(lang == "en", "text-embedding-3-large").when(lang == "de", "text-embedding-3-small").when(lang == "fr", "text-embedding-ada-002").otherwise(F.concat(F.lit("model of "), lang))
    size = F.lit(embed.dimension("another"))
    for name in ("text-embedding-3-large", "text-embedding-3-small", "text-embedding-ada-002"):
        size = F.when(F.col("model") == name, embed.dimension(name)).otherwise(size)
    return table(spark, d, "documents").select(model.alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("documents")).withColumn("dimension", size)
