"""Queries of this subpackage for the driver: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import quality

    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.crc_mod("doc_id", 5) == 0)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), usable=common.crc_mod("doc_id", 5) != 0)
    return quality.score(docs, model, ["doc_id", "held_out"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import license_scan

    return license_scan.scan(common.table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import token_files

    common.prepare(spark)
    path = common.scratch(spark, "token-files")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, tokenizer())
    return token_files.read_digests(spark, path)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import substring_dedup

    return substring_dedup.digests(common.table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import packing

    common.prepare(spark)
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer(), keep_ids=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import exact_dedup

    return exact_dedup.keepers(common.table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import decontaminate

    return decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import secrets_scan

    return secrets_scan.digests(common.table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import simhash

    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import langid

    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.crc_mod("doc_id", 4) == 2)
    model = langid.fit(docs, ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import token_alignment

    return token_alignment.digests(common.table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import jaccard_join

    return jaccard_join.similar_groups(common.table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_packing": op8_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}


def _license_sql() -> str:
    from corpusloom.llm import license_scan

    rows = ", ".join(f"('{k}', '{t.replace(chr(39), chr(39) * 2)}')" for k, t in sorted(license_scan.TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
with t as (select id, ws, least(5, len(ws)) as m from (select id, {words.format("text")} as ws from (values {rows}) v(id, text)) where len(ws) > 0),
own as (select distinct id, m, array_to_string(ws[i : i + m - 1], ' ') as sh from (select *, unnest(range(1, len(ws) - m + 2)) as i from t)),
size as (select id, count(*) as n, (2 * power(2, floor(log2(count(*)))))::bigint as step from own group by 1),
d as (select row_number() over () as r, doc_id, m, {words.format("coalesce(text, '')")} as ws from documents, (select distinct m from t)),
s as (select r, doc_id, m, len(ws) - m + 1 as total, i - 1 as pos, array_to_string(ws[i : i + m - 1], ' ') as sh from (select *, unnest(range(1, len(ws) - m + 2)) as i from d where len(ws) >= m)),
hit as (select r, doc_id, id, n, step, pos, sh, greatest(0, ceil((total - 2 * step) / step::double))::bigint as last from s join own using (m, sh) join size using (id)),
win as (select distinct r, doc_id, id, n, step, pos, sh, greatest(0, least(pos // step - back, last)) as w from hit, (values (0), (1)) b(back))
select doc_id, id as template, (w * step)::int as window_start, min(pos)::int as first_word, count(distinct sh) / n::double as containment
from win where pos >= w * step and pos < w * step + 2 * step group by r, doc_id, id, n, step, w having count(distinct sh) / n::double >= {license_scan.CONTAINMENT}
"""


ORACLES: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op4_substring_dedup": r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
g as (select r, doc_id, i, array_to_string(ws[i : i + 12], ' ') as win from (select *, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
m as (select win, min(doc_id) as least from g group by 1),
cut as (select distinct r, unnest(range(i, i + 13)) as p from g join m using (win) where least < doc_id),
word as (select r, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as x from w),
kept as (select r, string_agg(x, ' ' order by p) as text from word anti join cut using (r, p) group by 1),
n as (select r, count(*) as n from cut group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join n using (r) left join kept using (r)
""".replace("\\\\", "\\"),
    "op9_benchmark_decontamination": r"""
with w as (
  select kind, id, row_no, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from (select 'd' as kind, doc_id as id, row_number() over () as row_no, coalesce(text, '') as t from documents
        union all select 'b', item_id, row_number() over (), coalesce(text, '') from benchmark)
), b as (
  select id, ws, least(13, len(ws)) as m from w where kind = 'b' and len(ws) > 0
), bw as (
  select distinct id, m, array_to_string(ws[i : i + m - 1], ' ') as win
  from (select id, ws, m, unnest(range(1, len(ws) - m + 2)) as i from b)
), ms as (select distinct m from bw),
dw as (
  select row_no, m, i, array_to_string(ws[i : i + m - 1], ' ') as win
  from (select row_no, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, ms where kind = 'd' and len(ws) >= m)
), hits as (select dw.row_no, dw.i, dw.m, bw.id from dw join bw on dw.m = bw.m and dw.win = bw.win),
hit as (select row_no, count(distinct p) as n_hit from (select row_no, unnest(range(i, i + m)) as p from (select distinct row_no, i, m from hits)) group by 1),
met as (select row_no, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct row_no, id::varchar as id from hits) group by 1)
select w.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join hit using (row_no) left join met using (row_no) where kind = 'd'
""",
    "op10_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), r as (
  select *, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size
  from d window w as (partition by text_sha256 order by n desc, doc_id)
)
select doc_id, keep_id, group_size::bigint as group_size, place = 1 as kept, text_sha256 from r
""",
    "op13_hard_negatives": """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.r as a, a.vec_id as anchor_id, a.label = b.label as same, b.r, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r
), p as (
  select a, anchor_id, vec_id as positive_id, r, score as positive_score from s where same qualify row_number() over (partition by a order by score desc, vec_id) <= 5
), n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.a, p.r order by s.score desc, s.vec_id) as rank
  from p join s using (a) where not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
""",
}
