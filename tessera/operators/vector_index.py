"""A versioned index of vectors on disk: cells of rows, and manifests that say which cells make a version.

Layout, under a folder for each dimension (so vectors of other lengths never mix):
data/<write>/cell=<c>/ holds rows and is never changed; manifests/<version>.json names for
each cell its folder, its rows and the fingerprint of the source that they are from. A
refresh writes only cells whose fingerprint changed, then a new manifest under a temporary
name, and renames it: that is the swap. A reader picks the newest manifest once and reads
what that names, whatever is written meanwhile. Of two writers of one version the second
one's rename fails, and it raises.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 16
ROWS = "vec_id long, v array<double>"


@dataclass
class Version:
    number: int
    cells: dict[int, dict[str, Any]]  #: cell: path, n_rows, fingerprint


class VectorIndex:
    """dim: length of the index's vectors; cells: parts that are rewritten on their own (fixed when the index is made)."""

    def __init__(self, spark: SparkSession, path: str, dim: int, cells: int = CELLS):
        self.spark, self.path, self.dim, self.cells = spark, f"{path.rstrip('/')}/d{dim}", dim, cells

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or the one asked for; None if there is none."""
        found = self.versions()
        if not found:
            return None
        n = found[-1] if number is None else number
        text = self.spark.read.text(f"{self.path}/manifests/{n:08d}.json", wholetext=True).first()[0]
        m = json.loads(text)
        if m["dim"] != self.dim:
            raise ValueError(f"an index of dimension {m['dim']} under the name of {self.dim}")
        return Version(n, {int(c): v for c, v in m["cells"].items()})

    def _commit(self, number: int, cells: dict[int, dict[str, Any]]) -> None:
        fs, temporary = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps({"dim": self.dim, "cells": cells}, sort_keys=True).encode()))
        finally:
            out.close()
        _, final = self._fs(f"{self.path}/manifests/{number:08d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {number} was written by another writer")

    def _cell(self) -> Any:
        return F.pmod(F.xxhash64("vec_id"), F.lit(self.cells)).cast("int")

    def refresh(self, source: DataFrame) -> list[int]:
        """Make a version of source (vec_id, v); the cells that were written. Without a change there is no new version. Rows of another dimension, or without an id, are left out."""
        held = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
        held = held.where(F.col("vec_id").isNotNull() & (F.size("v") == self.dim)).withColumn("cell", self._cell())
        sums = held.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", "v").cast("decimal(38,0)")).cast("string").alias("print"))
        prints = {r["cell"]: (r["n"], r["print"]) for r in sums.collect()}  # one a cell
        last = self.version()
        old = last.cells if last else {}
        changed = sorted(c for c, (_, p) in prints.items() if old.get(c, {}).get("fingerprint") != p)
        if last and not changed and set(old) == set(prints):
            return []
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        if changed:
            held.where(F.col("cell").isin(changed)).repartition(len(changed), "cell").write.partitionBy("cell").parquet(path)
        fresh = {c: {"path": f"{path}/cell={c}", "n_rows": prints[c][0], "fingerprint": prints[c][1]} for c in changed}
        self._commit(last.number + 1 if last else 1, {c: fresh.get(c) or old[c] for c in prints})
        return changed

    def append(self, rows: DataFrame) -> list[int]:
        """Add or replace rows by vec_id (one row for each id in `rows`): only the cells that they fall into are read and written."""
        last = self.version()
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") == self.dim))
        touched = [r[0] for r in rows.select(self._cell()).distinct().collect()]  # at most `cells`
        if not touched:
            return []
        old = last.cells if last else {}
        before = self._read({c: old[c] for c in touched if c in old}).join(rows.select("vec_id"), "vec_id", "left_anti")
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        before.unionByName(rows).withColumn("cell", self._cell()).repartition(len(touched), "cell").write.partitionBy("cell").parquet(path)
        written = self.spark.read.schema(f"{ROWS}, cell int").parquet(path)
        sums = written.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", "v").cast("decimal(38,0)")).cast("string").alias("print")).collect()
        fresh = {r["cell"]: {"path": f"{path}/cell={r['cell']}", "n_rows": r["n"], "fingerprint": r["print"]} for r in sums}
        self._commit(last.number + 1 if last else 1, old | fresh)
        return sorted(fresh)

    def _read(self, cells: dict[int, dict[str, Any]]) -> DataFrame:
        paths = [v["path"] for _, v in sorted(cells.items())]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def read(self, number: int | None = None) -> DataFrame:
        """(vec_id, v) of a version, the newest by default."""
        v = self.version(number)
        return self._read(v.cells if v else {})
