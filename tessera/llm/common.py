"""What the training-data operators share: durable tables, words, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import new_path, settle, shared_dir

__all__ = ["durable", "fold_held_out", "load", "masked", "new_path", "partitions", "shared_dir", "training_ids", "unmasked", "word_count"]
durable = settle
#: The class of characters that make up a word (everything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_ids(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """At most `bound` labelled rows outside the held-out fold: those whose ids hash lowest (doc_id, target)."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~fold_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias(target))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def masked(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but the used ones renamed, so that no name of theirs clashes; and the names to give back."""
    names = {c: c if c in used else f"__other{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unmasked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of the masked table, in their order and under their own names."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))
