"""Training corpus pipeline: each stage works on what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; the caller writes it as
Parquet and reads it again as the next stage's docs. All but the last return the
columns of documents. run() does the same through the shared folder.

Defined results: null and empty texts, having no word, go in the quality stage; texts
that lose all their lines in the second are near copies of one another in the third,
which keeps one of them, and give nothing to the mix. Rows without a doc_id come last
wherever order counts. Repeated rows fare alike until the third stage, which keeps one.
Ties are broken by doc_id. Further columns, whatever their names, are handed on by all
stages but the last. An empty table gives an empty result. Long texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import byte_vocab, encode_decode
from tessera.llm.common import durable
from tessera.llm.line_dedup import keep_lines
from tessera.llm.mixing import mixed_documents
from tessera.llm.quality_rules import keep_good
from tessera.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (6): documents that they reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (8): texts lose lines that stand, or nearly stand, earlier in the corpus."""
    return keep_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash (9): one document of each group of near-duplicates stays."""
    return keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (2): documents as often, and as much of them, as their source's target takes."""
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE (5): token ids of every row, and a digest of the text that they decode to."""
    return encode_decode(docs, byte_vocab(), ["doc_id", "source"], texts_too=False)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("simhash near-dedup", near_copy_stage), ("mixing", mix_stage), ("bpe", bpe_stage)]

#: SQL can't express the trees, the edit join's bit registers, or the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = durable(docs, f"stage-{n}")
    return docs
