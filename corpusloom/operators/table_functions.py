"""The chunkers as a table function of SQL.

    register(spark)
    SELECT * FROM chunk(TABLE(SELECT doc_id, text FROM documents), 'text', 'walk', '{"size": 500}')

gives the table's other columns with chunk_index and chunk, as
strategies.chunked gives them: the result's columns follow from the table that
is passed.  Methods are those of chunk.python_chunks; options are JSON.  A
null text, and one that the method fails on, has no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.operators import chunk
from corpusloom.session import ship

METHODS = {"walk": chunk.walk, "recursive": chunk.recursive, "two_stage": chunk.two_stage, "tokens": chunk.token_windows}


class Chunk:
    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, method: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        for name, a in (("text", text), ("method", method), ("options", options)):
            if a is not None and not a.isConstantExpression:
                raise ValueError(f"{name} is a constant")
        if text.value not in table.dataType.fieldNames():
            raise ValueError(f"{text.value} is no column of the table")
        if method.value not in METHODS:
            raise ValueError(f"{method.value} is not one of {', '.join(METHODS)}")
        json.loads(options.value if options is not None else "{}")
        kept = [f for f in table.dataType if f.name != text.value]
        clash = {f.name for f in kept} & {"chunk_index", "chunk"}
        if clash:
            raise ValueError(f"the table has {', '.join(sorted(clash))} already")
        return AnalyzeResult(StructType([*kept, StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, row, text: str, method: str, options: str = "{}"):
        value = row[text]
        if value is None:
            return
        kept = [v for f, v in zip(row.__fields__, row) if f != text]
        try:
            found = METHODS[method](value, **json.loads(options))
        except (KeyError, TypeError, ValueError):
            return
        for k, piece in found if method == "walk" else enumerate(found):
            yield (*kept, k, piece)


def register(spark: SparkSession, name: str = "chunk") -> None:
    ship(spark)
    spark.udtf.register(name, udtf(Chunk))
