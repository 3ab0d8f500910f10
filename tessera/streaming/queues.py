"""Write and validation queues, retries and circuit breakers over streams and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path


def content_hash(*parts: str):
    """SHA-256 of the parts, with null for what is missing, parted by null characters."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def runs(n: int) -> list[tuple[int, int]]:
    """(first, last) batch of each run that holds what the batches before n brought: a run for each 1 in n's binary digits."""
    out, low = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out.append((low, low + (1 << bit) - 1))
            low += 1 << bit
    return out


def enqueue(stream: DataFrame, parts: list[str], path: str | None = None) -> DataFrame:
    """Drain a stream into a queue: of each content one item, that of the first batch that brings it.

    A batch drops what the queue holds already and what it repeats itself. What it holds is
    asked of runs of contents' hashes, which batch n merges so that about log n of them are
    left: n batches read and write each hash about log n times. A batch that runs again,
    after a failure, reads the same runs and writes its own folders anew.
    """
    spark = stream.sparkSession
    base = path or new_path(spark, "queue")
    kinds = stream.withColumn("content", content_hash(*parts)).schema

    def seen(which: list[tuple[int, int]]) -> DataFrame:
        return spark.read.schema("content string").parquet(*(f"{base}/seen/{a}-{z}" for a, z in which))

    def put(batch: DataFrame, n: int) -> None:
        items = batch.withColumn("content", content_hash(*parts)).dropDuplicates(["content"])
        held = runs(n)
        if held:
            items = items.join(seen(held), "content", "left_anti")
        items.select(*kinds.names).write.mode("overwrite").parquet(f"{base}/items/batch={n}")
        first = runs(n + 1)[-1][0]
        own = spark.read.schema(kinds).parquet(f"{base}/items/batch={n}").select("content")
        merged = [r for r in held if r[0] >= first]
        out = own.unionAll(seen(merged)) if merged else own
        out.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.mode("overwrite").parquet(f"{base}/seen/{first}-{n}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(kinds).parquet(f"{base}/items/batch=*")


def ledger(outcomes: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, status, attempts): the latest status of each key, and how often it was tried."""
    return outcomes.groupBy(key).agg(F.max_by(status, order).alias("status"), F.count("*").alias("attempts"))


def due_again(outcomes: DataFrame, key: str, order: str, status: str, done: str, most: int) -> DataFrame:
    """The keys whose latest outcome is not `done` and that were tried fewer than `most` times."""
    return ledger(outcomes, key, order, status).where((F.col("status") != done) & (F.col("attempts") < most))


def breaker(outcomes: DataFrame, key: str, order: list[str], failed, most: int) -> DataFrame:
    """outcomes with `in_row`, how many failures stand in a row up to each, and `open`: whether these are `most` or more."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = outcomes.withColumn("__run", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = runs.withColumn("in_row", F.sum(F.when(failed, 1).otherwise(0)).over(inner))
    return out.withColumn("open", F.col("in_row") >= most).drop("__run")
