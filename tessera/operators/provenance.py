"""A ledger of runs and their replay: what a run was given and gave, as digests, and how two runs compare.

A manifest has a row for each input, parameter and output. A table's digest is a sum of its
rows' hashes, so neither partitioning nor order changes it and tasks add their parts up
before they are shuffled. Manifests are tables of their own in the ledger's folder, written
whole, so a reader sees a run or doesn't.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

MANIFEST = "run string, kind string, name string, n_rows long, digest string, value string"
#: Largest difference of values that agree, and share of rows that may disagree.
CLOSE, DISAGREE = 1e-6, 0.01


def table_digest(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, digest): a sum of 48 bits of each row's MD5, modulo 2**63; null values are left out of a row's text, as they are of SQL's concat_ws.

    Up to 32,768 rows the sum can't reach 2**63. The halves of the hashes are summed apart, so that no sum overflows.
    """
    parts = [F.col(c).cast("string") for c in (columns or table.columns)]
    md5 = F.md5(F.concat_ws("|", *parts))
    half = lambda begin: F.coalesce(F.sum(F.conv(F.substring(md5, begin, 6), 16, 10).cast("long")), F.lit(0)).cast("decimal(20,0)")
    digest = (half(1) * F.lit(1 << 24).cast("decimal(8,0)") + half(7)) % F.lit(str(1 << 63)).cast("decimal(19,0)")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), digest.cast("long").alias("digest"))


def exact_digest(table: DataFrame) -> DataFrame:
    """(n_rows, digest) that tells nulls from empty texts and columns from one another, with two sums of 64-bit hashes."""
    row = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")) for seed in (1, 2)]
    both = F.concat_ws(":", *(F.coalesce(s, F.lit(0)).cast("string") for s in sums))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), both.alias("digest"))


class Ledger:
    """Runs by name, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def record(self, run: str, inputs: dict[str, DataFrame], parameters: dict[str, Any], outputs: dict[str, DataFrame]) -> str:
        """Write the manifest of a run (once: a run that is recorded already raises); its root digest."""
        rows: list[tuple[str, str, str, int | None, str, str | None]] = []
        for kind, tables in (("input", inputs), ("output", outputs)):
            for name, t in tables.items():
                n, digest = exact_digest(t).first()
                rows.append((run, kind, name, n, digest, None))
        for name, v in parameters.items():
            text = json.dumps(v, sort_keys=True, default=str)
            rows.append((run, "parameter", name, None, hashlib.sha256(text.encode()).hexdigest(), text))
        root = hashlib.sha256(json.dumps(sorted((r[1], r[2], r[4]) for r in rows)).encode()).hexdigest()
        rows.append((run, "root", "root", None, root, None))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/run={run}")
        return root

    def manifest(self, run: str) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/run={run}")

    def differences(self, a: str, b: str) -> list[str]:
        """kind:name of all that two runs don't have in common, inputs and parameters before outputs. A manifest has few rows."""
        one, two = ({(r["kind"], r["name"]): r["digest"] for r in self.manifest(run).where("kind != 'root'").collect()} for run in (a, b))
        order = {"input": 0, "parameter": 1, "output": 2}
        return [f"{k}:{n}" for k, n in sorted(one.keys() | two.keys(), key=lambda x: (order[x[0]], x[1])) if one.get((k, n)) != two.get((k, n))]


def compared(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], close: float = CLOSE, disagree: float = DISAGREE) -> DataFrame:
    """One row: n_a, n_b, only_a, only_b, apart (rows of both with values that differ by more than `close`), largest, agrees (few enough rows disagree)."""
    right = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__b"))
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = a.select(*keys, *values, F.lit(True).alias("__a")).join(right, cond, "full")
    gaps = [F.when(F.col(v).isNull() & F.col(f"__{v}").isNull(), 0.0).when(F.col(v).isNull() | F.col(f"__{v}").isNull(), float("inf")).otherwise(F.abs(F.col(v) - F.col(f"__{v}"))) for v in values]
    gap = F.greatest(*gaps, F.lit(0.0))
    met = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    sums = both.agg(
        n(F.col("__a").isNotNull()).alias("n_a"), n(F.col("__b").isNotNull()).alias("n_b"), n(F.col("__b").isNull()).alias("only_a"), n(F.col("__a").isNull()).alias("only_b"),
        n(met & (gap > close)).alias("apart"), F.coalesce(F.max(F.when(met, gap)), F.lit(0.0)).alias("largest"),
    )
    bad = F.col("only_a") + F.col("only_b") + F.col("apart")
    return sums.withColumn("agrees", bad <= disagree * F.greatest("n_a", "n_b"))
