"""Make the library's functions callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from .operators import blocks


@udtf(returnType="chunk_index int, chunk string")
class TextChunks:
    """text_chunks(text, size, overlap): a row for each chunk."""

    def eval(self, text: str, size: int = 2000, overlap: int = 200) -> Iterator[tuple[int, str]]:
        yield from enumerate(blocks.pack_chunks(text or "", size, overlap))


@udtf(returnType="kind string, owner string, name string")
class CodeGraph:
    """code_graph(source): functions, classes, imports, calls and rule hits of Python source."""

    def eval(self, source: str) -> Iterator[tuple[str, str, str]]:
        yield from blocks.code_graph(source or "")


@pandas_udf("array<double>")
def isotonic(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else blocks.isotonic(pd.Series(v).to_numpy(float)).tolist())


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", TextChunks)
    spark.udtf.register("code_graph", CodeGraph)
    spark.udf.register("isotonic", isotonic)


