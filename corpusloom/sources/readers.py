"""Readers of collections, raw crawl files, instruction sets and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.sources import schemas as S


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file, or JSON lines.  A missing file is empty; broken records and columns with a leading _ are left out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    first = schema.split()[0]
    good = F.col("_corrupt_record").isNull() | F.col(first).isNotNull()
    return rows.filter(good).drop("_corrupt_record")


def whole_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, value): each file as one text."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def raw_documents(files: DataFrame) -> DataFrame:
    """(file, kind, repository, article, error): raw crawl files told apart by their shape.

    An object with files is a repository; one with content and link or url an
    article; lists are taken item by item; others are generic; what cannot be
    read has an error.
    """
    value = T.strip(F.col("value"))
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    rows = files.select("file", F.explode_outer(items).alias("item"))
    j = F.col("item")
    keys = F.json_object_keys(j)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(keys.isNull(), "error").when(has("files"), "repository").when(has("content") & (has("link") | has("url")), "article").otherwise("generic")
    return rows.select(
        "file", kind.alias("kind"), "item",
        F.when(kind == "repository", F.from_json(j, S.RAW_REPOSITORY)).alias("repository"),
        F.when(kind == "article", F.from_json(j, S.RAW_ARTICLE)).alias("article"),
        F.when(kind == "error", F.lit("no JSON object")).alias("error"),
    )


def document_kind(file: Column) -> Column:
    """By the file's name."""
    name = F.lower(F.element_at(F.split(file, "/"), -1))
    return F.when(F.contains(name, F.lit("articles")), "article").when(F.contains(name, F.lit("repositories")), "repository").when(F.contains(name, F.lit("users")), "user").otherwise("unknown")


def training_articles(files: DataFrame) -> DataFrame:
    """Articles of a bare list or of {artifact_data: [...]}."""
    bare = F.from_json("value", f"array<struct<{_struct(S.TRAINING_ARTICLES)}>>")
    wrapped = F.from_json("value", f"struct<artifact_data:array<struct<{_struct(S.TRAINING_ARTICLES)}>>>")["artifact_data"]
    return files.select(F.inline(F.when(F.startswith(T.strip(F.col("value")), F.lit("[")), bare).otherwise(wrapped)))


def _struct(ddl: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def instruction_sets(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("instruction", "output", F.lit("train").alias("split")).unionByName(test.select("instruction", "output", F.lit("test").alias("split")))


def instruction_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAIRS).option("multiLine", True).json(path)


def answer_envelope(c: Column) -> Column:
    """{instruction_answer_pairs: [{instruction, answer}]}, also where text stands around it."""
    return F.from_json(T.json_in_text(c), "struct<instruction_answer_pairs:array<struct<instruction:string,answer:string>>>")["instruction_answer_pairs"]


def preference_triples(files: DataFrame) -> DataFrame:
    return files.select(F.inline(F.from_json("value", f"struct<preference_triples:array<struct<{_struct(S.TRIPLES)}>>>")["preference_triples"]))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("question")).filter("question <> ''")


def config(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


#: Folders and suffixes that a repository walk leaves out.
IGNORED = (".git", ".toml", ".lock", ".png")
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "target", "build")


def repository_files(spark: SparkSession, path: str, compat: bool = False, least: int = 10) -> DataFrame:
    """(file_path, content, size, language) of a checkout.

    By default hidden and build folders, binary and large files and short ones
    are left out; compat keeps all but IGNORED and takes every space out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = F.regexp_replace(F.lit(path.rstrip("/")), "^file:(//)?", "")
    name = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), F.concat(F.lit("^\\Q"), base, F.lit("\\E/*")), "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = files.select(name.alias("file_path"), text.alias("content"), F.col("length").alias("size"), U.file_language(name).alias("language")).filter(F.col("content").isNotNull())
    if compat:
        ignored = F.lit(False)
        for x in IGNORED:
            ignored = ignored | F.endswith("file_path", F.lit(x)) | F.startswith("file_path", F.lit(x))
        return rows.filter(~ignored).withColumn("content", F.replace("content", F.lit(" "), F.lit("")))
    folders = "|".join(SKIPPED_FOLDERS)
    return rows.filter(~F.col("file_path").rlike(rf"(^|/)(\.[^/]+|{folders})/") & ~U.skip_file(F.col("file_path"), F.col("size")) & (F.char_length(T.strip(F.col("content"))) > least))


def profile_users(files: DataFrame, default_id: str = "linkedin_user") -> DataFrame:
    """(id, full_name) of profiles that have a full name."""
    p = F.from_json("value", "struct<id:string,full_name:string>")
    return files.select(F.coalesce(p["id"], F.lit(default_id)).alias("id"), p["full_name"].alias("full_name")).filter(F.col("full_name").isNotNull())
