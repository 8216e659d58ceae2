"""The training-data pipeline: five operators, one after the other, over a corpus.

Each stage takes (spark, docs, sf_dir), works on every row that its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of
documents.  SQL expresses neither language ID nor the tokenizer, so there is
no oracle; the tests hold the pipeline against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, decontaminate, exact_dedup, langid, packing, simhash
from corpusloom.llm.queries import tokenizer

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model refuses go: no letter, claimed by no language, or surely of another language than they state; learns from the rows' own lang."""
    return langid.keep_known(docs, langid.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents a twentieth of whose words lie in benchmark passages go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids."""
    common.prepare(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = common.written(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
