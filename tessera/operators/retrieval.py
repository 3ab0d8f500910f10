"""Retrieval of many queries at once: term joins, lexical scores, the linear ranker, and a topic index that is kept on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .term_scores import NAMES, PHRASE, RARE, TERMS, Terms, best_rows, by_key, of_block, rounded, term_rows
from .vectors import Nearest, ball_distances, ball_gap, ball_stretch, kmeans, meet

#: What the ranker's features weigh, and the prior of facts.
WEIGHTS = {"overlap": 0.25, "rare": 0.1, "semantic": 0.2, "graph": 0.1, "salience": 0.05, "document": 0.1, "type": 0.1, "confidence": 0.1}
FACT_PRIOR, SALIENCE = 0.9, 0.5


def best(rows: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k rows of highest `score` of each query, with their rank; ties to the smaller key."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, "rank", key, "score")


def over_blocks(queries: DataFrame, query: str, key: str, kind: str, k: int, one: Callable[[Terms], DataFrame], *of: Any) -> DataFrame:
    """The k best of what `one` finds for each block of queries; `of` goes to their Terms."""
    found = None
    for terms in of_block(queries, query, *of):
        rows = one(terms)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {kind}, score double")
    return best(found, query, key, k)


def search_chunks(chunks: DataFrame, queries: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """Lexical search: max(1, length / 4) for each term held, and 2 for each word of the phrase where it stands."""
    score = lambda _, f: rounded(f["weight"] + np.where(f["phrase"] > 0, 2.0 * PHRASE, 0.0))
    kind = queries.schema[query].dataType.simpleString()
    one = lambda terms: best_rows(by_key(term_rows(chunks, terms, key, phrases=True), [key]), terms, kind, query, key, k, score, ("weight", "phrase"))
    return over_blocks(queries, query, key, chunks.schema[key].dataType.simpleString(), k, one)


def search_facts(facts: DataFrame, queries: DataFrame, query: str, k: int) -> DataFrame:
    """Confidence and token-set likeness of facts (fact_id, text, confidence)."""
    score = lambda t, f: rounded(0.6 * f["confidence"] + 0.4 * f["hits"] / t.n[f["query"]])
    kind = queries.schema[query].dataType.simpleString()
    one = lambda terms: best_rows(by_key(term_rows(facts, terms, "fact_id", carry=("confidence",)), ["fact_id"], ("confidence",)), terms, kind, query, "fact_id", k, score)
    return over_blocks(queries, query, "fact_id", facts.schema["fact_id"].dataType.simpleString(), k, one)


def linear_score(terms: Terms, f: dict[str, np.ndarray]) -> np.ndarray:
    n = terms.n[f["query"]]
    features = {
        "overlap": f["hits"] / n, "rare": f["rare"] / np.maximum(terms.n_rare[f["query"]], 1), "semantic": f["hits"] / np.sqrt((n * f["size"]).astype(float)),
        "graph": f["names"] / np.minimum(n, terms.names), "salience": SALIENCE, "document": f["of_hits"] / n, "type": FACT_PRIOR, "confidence": f["confidence"],
    }
    score = 0.0
    for name, w in WEIGHTS.items():
        score = score + w * features[name]
    return rounded(score)


def rank_facts(facts: DataFrame, documents: DataFrame, queries: DataFrame, query: str, k: int, most: int | None = TERMS, names: int | None = NAMES) -> DataFrame:
    """The linear ranker over facts (fact_id, doc_id, text, confidence): eight weighted features.

    Likeness is the cosine of token sets (a stand-in for encoders), graph proximity the
    share of the query's names in the fact, document relevance the share of its terms in the document.
    `most` words of a query are terms, its first `names` are names; None: all its words.
    A fact's terms meet its document's, both as numbers, and a task scores it for all queries.
    """
    kind = queries.schema[query].dataType.simpleString()

    def one(terms: Terms) -> DataFrame:
        # a shuffle by documents serves the facts' keys and the join
        each = by_key(term_rows(facts, terms, "fact_id", carry=("doc_id", "confidence")).repartition("doc_id"), ["doc_id", "fact_id"], ("confidence",))
        docs = by_key(term_rows(documents, terms, "doc_id"), ["doc_id"]).select("doc_id", F.col("terms").alias("of_terms"))
        return best_rows(each.join(docs, "doc_id", "left").select("fact_id", "doc_id", "size", "terms", "confidence", "of_terms"), terms, kind, query, "fact_id", k, linear_score, ("rare", "names"), "doc_id")

    return over_blocks(queries, query, "fact_id", facts.schema["fact_id"].dataType.simpleString(), k, one, most, names, False)


def build_topic_index(points: DataFrame, path: str, clusters: int = 20, rounds: int = 10) -> None:
    """Write clusters of points (vec_id, p) of the ball: {path}/members by cluster, with distances, and {path}/centroids."""
    members, centres = kmeans(points, clusters, rounds)
    members.select("vec_id", "p", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/members")
    rows = [(n, c) for n, c in enumerate(centres)]
    points.sparkSession.createDataFrame(rows, "cluster long, p array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def query_topic_index(queries: DataFrame, path: str, clusters: int = 5, each: int = 3) -> DataFrame:
    """(query_id, cluster, vec_id, distance): of the nearest clusters of each query (query_id, q) their nearest members. Only these clusters' files are met."""
    spark = queries.sparkSession
    # clusters are a parameter's number
    centres = sorted((r["cluster"], r["p"]) for r in spark.read.parquet(f"{path}/centroids").collect())
    number, y = np.array([c for c, _ in centres]), np.array([p for _, p in centres])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                order = np.argsort(ball_distances(np.stack(b["q"].to_numpy()), y), axis=1, kind="stable")[:, :clusters]
                yield b.loc[b.index.repeat(order.shape[1])].assign(cluster=number[order.ravel()])

    near = settle(queries.select("query_id", "q").mapInPandas(run, "query_id long, q array<double>, cluster long"), "topic-queries")
    members = spark.read.parquet(f"{path}/members").withColumn("cell", F.col("cluster").cast("int"))
    asked = near.select(F.col("cluster").cast("int").alias("cell"), "query_id", "q", F.lit(None).cast("double").alias("x"))
    held = members.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi").select("cell", F.lit(0).alias("tag"), "vec_id", "p")
    # blocks of a cluster's queries meet chunks of its members in matrix products, and give their few nearest
    found = meet(asked, held, lambda cell, ids, q, _: Members(cell, ids, q, each), "query_id long, cluster long, vec_id long, distance double")
    w = Window.partitionBy("query_id", "cluster").orderBy("distance", "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("query_id", "cluster", "vec_id", "distance")


class Members:
    """The nearest members of a cluster, a query itself among them. Matrix products find them; each pair's own product ranks it, so that equal vectors tie."""

    def __init__(self, cell: int, ids: np.ndarray, q: np.ndarray, k: int):
        self.cell, self.ids = cell, ids
        # no query is one of the points that it leaves out
        self.near = Nearest(np.full(len(ids), np.nan), q, k, far=ball_stretch, pair=lambda a, b: np.arccosh(1 + ball_gap(a, b)))

    def add(self, tags: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.near.add(tags, ids, vectors)

    def frame(self) -> pd.DataFrame:
        row, vec, d = self.near.best
        return pd.DataFrame({"query_id": self.ids[row], "cluster": np.full(len(row), self.cell, np.int64), "vec_id": vec, "distance": d})
