"""Retrieval over related keywords, pruned search, shapes, beams, sampling, code graphs and centroid streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import vectors as V
from ..streaming import events as E
from .common import FACTS_SQL, TOKENS_SQL, facts, points, tokens
from .registry import load, query
from .stream_queries import stream
from .vector_queries import KNN_SQL


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The object in a model's answer: thinking and fences go, a trailing comma is mended."""
    answer = F.concat(F.lit('<think>{"k": -1}</think>Here it is:\n```json\n'), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```\n"))
    return load(spark, sf, "events").select("event_id", F.get_json_object(T.first_json(answer), "$.k").cast("long").alias("k"))


@query(f"""WITH {TOKENS_SQL}, {FACTS_SQL}, t AS (SELECT DISTINCT doc_id, token FROM tokens), mine AS (SELECT doc_id FROM t WHERE token = 'tion'),
related AS (SELECT token FROM t JOIN mine USING (doc_id) GROUP BY token HAVING count(*) >= 0.3 * (SELECT count(*) FROM mine)) SELECT fact_id, doc_id, confidence FROM facts WHERE canonical_value IN (SELECT token FROM related)""")
def graph_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Facts about a keyword or one related to it (found in 0.3 of its documents or more)."""
    t = tokens(spark, sf).select("doc_id", "token").distinct()
    mine = t.where("token = 'tion'").select("doc_id")
    total = mine.agg(F.count("*").alias("total"))
    met = t.join(mine, "doc_id", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    related = met.join(F.broadcast(total)).where("n >= 0.3 * total").select(F.col("token").alias("canonical_value"))
    return facts(spark, sf).join(related, "canonical_value", "left_semi").select("fact_id", "doc_id", "confidence")


@query(f"WITH {KNN_SQL} SELECT query_id, rank, round(d, 3) AS d FROM near")
def pruned_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours as hyperbolic_neighbours, from the cells that can hold any."""
    p = points(spark, sf)
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    return V.pruned_neighbours(q, p, 10).select("query_id", "rank", F.round("d", 3).alias("d"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding[1:8]::DOUBLE[], embedding[1:8]::DOUBLE[]) * list_inner_product(embedding[9:16]::DOUBLE[], embedding[9:16]::DOUBLE[])), 5) AS norm FROM embeddings")
def octonion_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Norm of the product of a vector's first two octonions; it is the product of their norms."""

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float)[:16] for v in b["embedding"]]) if len(b) else np.zeros((0, 16))
            yield pd.DataFrame({"vec_id": b["vec_id"], "norm": np.linalg.norm(B.octonion_product(x[:, :8], x[:, 8:]), axis=1)})

    out = load(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, norm double")
    return out.select("vec_id", F.round("norm", 5).alias("norm"))


@query()
def shape_fits(spark: SparkSession, sf: str) -> DataFrame:
    """How far each conversation's lengths of turns are from rising, from one peak, and from rising within bounds."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log1p(g.sort_values("turn")["n"].to_numpy(float))
        low, high = np.full(len(y), np.quantile(y, 0.1)), np.full(len(y), np.quantile(y, 0.9))
        fits = [B.isotonic(y), B.unimodal(y), B.dykstra(y, [B.isotonic, lambda x: B.trapezoid(x, low, high)])]
        return pd.DataFrame([(g["conv_id"].iloc[0], *(float(((f - y) ** 2).sum()) for f in fits))], columns=["conv_id", "rising", "peaked", "bounded"])

    t = load(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    out = t.groupBy("conv_id").applyInPandas(run, "conv_id long, rising double, peaked double, bounded double")
    return out.select("conv_id", *(F.round(c, 6).alias(c) for c in ("rising", "peaked", "bounded")))


@query()
def beam_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The three best paths through each conversation, with the longest words of a turn as its claims."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        steps = [[(w, len(w) / 10) for w in ws] for ws in g.sort_values("turn")["claims"]]
        best = B.beam([s for s in steps if s])
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[0], "rank": range(1, len(best) + 1), "score": [s for _, s in best], "path": [list(p) for p, _ in best]})

    by_length = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    claims = F.slice(F.array_sort(F.array_distinct(T.tokenize(F.col("text"))), by_length), 1, 4)
    t = load(spark, sf, "conversations").select("conv_id", "turn", claims.alias("claims"))
    return t.groupBy("conv_id").applyInPandas(run, "conv_id long, rank int, score double, path array<string>").withColumn("score", F.round("score", 6))


@query()
def sampled_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of facts in the order of a draw from Beta(1 + sure ones, 1 + unsure ones). The driver sees a row for each kind."""
    n = lambda c: F.count(F.when(c, 1))
    kinds = facts(spark, sf).groupBy("fact_type").agg(n(F.col("confidence") >= 0.7).alias("won"), n(F.col("confidence") < 0.7).alias("lost")).orderBy("fact_type").collect()
    order = B.thompson([(str(r["fact_type"]), r["won"], r["lost"]) for r in kinds], 11)
    return spark.createDataFrame(list(enumerate(order, 1)), "rank int, gap string")


SNIPPETS = {
    "a.py": 'import os\n\ndef f(x):\n    """Doc."""\n    return os.path.join(x)\n',
    "b.py": "class A:\n    def g(self):\n        try:\n            eval('1')\n        except:\n            pass\n",
    "c.py": "def broken(:\n",
}


@query("""SELECT * FROM (VALUES ('a.py', 'import', 'module', 'os'), ('a.py', 'function', 'module', 'f'), ('a.py', 'call', 'f', 'join'), ('b.py', 'class', 'module', 'A'), ('b.py', 'missing docstring', 'module', 'A'),
('b.py', 'function', 'A', 'g'), ('b.py', 'missing docstring', 'A', 'g'), ('b.py', 'unsafe call', 'g', 'eval'), ('b.py', 'bare except', 'g', '')) v(path, kind, owner, name)""")
def source_code_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Graph of a few sources (the tables hold none); one that is broken gives no rows."""
    from ..registration import register  # needs a session when it is imported

    register(spark)
    sources = spark.createDataFrame(list(SNIPPETS.items()), "path string, source string")
    return spark.sql("SELECT s.path, g.kind, g.owner, g.name FROM {sources} s, LATERAL code_graph(s.source) g", sources=sources)


@query("SELECT event_type, round(avg(value), 6) AS centroid FROM events GROUP BY event_type")
def minibatch_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids refreshed by each mini-batch; the table is one batch, so they are its means."""
    return E.centroids(stream(spark, sf), "event_type", "value").select("event_type", F.round("centroid", 6).alias("centroid"))
