"""The functions of the library for use in SQL text: register(spark) once a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as t
from .fuzzy import fuzzy_score


class ChunkText:
    """chunk_text(text, limit, overlap): (chunk_no, start, end, chunk), as a table function for lateral joins."""

    def eval(self, text: str, limit: int, overlap: int):
        from ..operators.chunking import chunk_spans

        for k, (a, b) in enumerate(chunk_spans(text or "", limit, overlap)):
            yield k + 1, a, b, text[a:b]


def register(spark: SparkSession) -> None:
    """fuzzy_score(text, name), nfkc(text) and the table function chunk_text(text, limit, overlap). The other functions
    are plain expressions and need no registration."""
    from ..common import ship

    ship(spark)
    spark.udf.register("fuzzy_score", F.udf(fuzzy_score, "double", useArrow=True))
    spark.udf.register("nfkc", F.udf(t.fold, "string", useArrow=True))
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_no int, start int, `end` int, chunk string"))
