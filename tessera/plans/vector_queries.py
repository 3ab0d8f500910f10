"""Hyperbolic geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import vectors as V
from ..storage import settle
from .common import POINTS_SQL, distance_sql, points
from .registry import load, query


@query(f"WITH {POINTS_SQL} SELECT vec_id, round(sqrt(list_inner_product(p, p)), 5) AS norm, round(2 * atanh(sqrt(list_inner_product(p, p))), 5) AS depth FROM points")
def ball_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vec_id", F.round(G.norm(F.col("p")), 5).alias("norm"), F.round(G.norm(G.log0(F.col("p"))), 5).alias("depth"))


@query(f"WITH {POINTS_SQL} SELECT vec_id, round(2 * sqrt(list_inner_product(p, p)) / (1 + list_inner_product(p, p)), 5) AS klein FROM points")
def klein_norms(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vec_id", F.round(G.norm(G.to_klein(F.col("p"))), 5).alias("klein"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def adjacent_cosines(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    n = load(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(n, "a").select("a", "b", F.round(G.cosine(F.col("x"), F.col("y")), 4).alias("cosine"))


@query("""SELECT query_id, rank, vec_id, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cosine FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def cosine_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Linear scan (K2): the ten vectors of the largest cosine for each row whose id is divisible by 20, of all rows."""
    v = load(spark, sf, "embeddings").select("vec_id", G.doubles(F.col("embedding")).alias("v"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return V.cosine_neighbours(q, v, 10).select("query_id", "rank", "vec_id", F.round("cosine", 4).alias("cosine"))


KNN_SQL = f"""{POINTS_SQL}, near AS (SELECT * FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {distance_sql('q.p', 'c.p')} AS d FROM points q JOIN points c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10)"""


def near(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    return V.neighbours(q, p, 10)


@query(f"WITH {KNN_SQL} SELECT query_id, rank, round(d, 3) AS d FROM near")
def hyperbolic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf).select("query_id", "rank", F.round("d", 3).alias("d"))


@query(f"WITH {KNN_SQL} SELECT query_id, round(max(CASE WHEN rank <= 3 THEN d END) * 1.2, 3) AS radius, round(avg(CASE WHEN rank <= 5 THEN d END), 3) AS density FROM near GROUP BY query_id")
def neighbour_radii(spark: SparkSession, sf: str) -> DataFrame:
    n = near(spark, sf)
    return V.radius(n).join(V.density(n), "query_id").select("query_id", F.round("radius", 3).alias("radius"), F.round("density", 3).alias("density"))


@query(f"""WITH {KNN_SQL}, r AS (SELECT query_id, max(CASE WHEN rank <= 3 THEN d END) * 1.2 AS radius FROM near GROUP BY query_id) SELECT query_id, count(*) AS inside FROM r JOIN points q ON q.vec_id = r.query_id JOIN points c ON c.vec_id <> q.vec_id WHERE {distance_sql('q.p', 'c.p')} <= radius GROUP BY query_id""")
def radius_filter(spark: SparkSession, sf: str) -> DataFrame:
    p, r = points(spark, sf), V.radius(near(spark, sf))
    q = p.join(r, p.vec_id == r.query_id).select("query_id", F.col("p").alias("q"), "radius")
    return V.inside(q, p)


@query("SELECT event_id, round(exp(-0.0001 * date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 1e6), 6) AS weight FROM events")
def decayed_events(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    age = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return e.crossJoin(last).select("event_id", F.round(G.decay(age), 6).alias("weight"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 / (1 + sqrt(pow((a.n_nationkey * 7.0 - b.n_nationkey * 7.0) * cos(radians((a.n_regionkey * 15.0 + b.n_regionkey * 15.0) / 2)), 2) + pow(a.n_regionkey * 15.0 - b.n_regionkey * 15.0, 2)) / 45), 6) AS s FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25")
def plane_similarities(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), (F.col("n_regionkey") * 15.0).alias("lat1"), (F.col("n_nationkey") * 7.0).alias("lon1"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    b = n.select(F.col("n_nationkey").alias("b"), (F.col("n_regionkey") * 15.0).alias("lat2"), (F.col("n_nationkey") * 7.0).alias("lon2"))
    return a.join(b, "b").select("a", "b", F.round(G.plane_similarity(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("s"))


@query()
def class_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """Fréchet mean of each class."""
    m = V.frechet_mean(points(spark, sf), "label", rounds=8)
    return m.select("label", F.round(G.norm(F.col("mean")), 6).alias("norm"))


@query()
def nearest_class(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted class: that of the nearest prototype."""
    p = points(spark, sf)
    m = {r["label"]: r["mean"] for r in V.frechet_mean(p, "label", rounds=4).collect()}
    names = sorted(m)
    return V.assign(p, [m[k] for k in names]).select("vec_id", "label", F.get(F.array(*map(F.lit, names)), F.col("cluster").cast("int")).alias("predicted"))


@query()
def ball_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """k-means in the ball: clusters, and each cluster's member nearest to its centre."""
    a, _ = V.kmeans(points(spark, sf), 8, rounds=4)
    return a.groupBy("cluster").agg(F.count("*").alias("n"), F.min_by("vec_id", F.struct("d", "vec_id")).alias("representative"))


@query()
def leader_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = V.leader_clusters(points(spark, sf), "label", 1.1)
    return g.groupBy("leader").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT * FROM points WHERE vec_id % 50 = 0), f AS (SELECT * FROM points WHERE vec_id % 50 <> 0),
d AS (SELECT f.vec_id, min(1 / (1 + {distance_sql('f.p', 's.p')})) AS lo, max(1 / (1 + {distance_sql('f.p', 's.p')})) AS best FROM f, s GROUP BY f.vec_id),
q AS (SELECT quantile_cont(best, 0.75) AS hi, quantile_cont(best, 0.25) AS low FROM d)
SELECT vec_id, round(best, 3) AS best, CASE WHEN best >= hi THEN 'aligned' WHEN best < low THEN 'disputed' ELSE 'open' END AS verdict FROM d, q""")
def standards_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows divisible by 50 are the standards, all others facts. Each fact's most similar standard; the top quarter is aligned, the bottom one disputed."""
    p = points(spark, sf)
    s = p.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("p").alias("q"))
    met = settle(V.closest(s, p.where("vec_id % 50 != 0")), "standards-met")  # it is read twice
    d = met.select("vec_id", G.similarity(F.col("d")).alias("best"))
    q = F.broadcast(d.agg(F.percentile("best", 0.75).alias("hi"), F.percentile("best", 0.25).alias("low")))
    verdict = F.when(F.col("best") >= F.col("hi"), "aligned").when(F.col("best") < F.col("low"), "disputed").otherwise("open")
    return d.join(q).select("vec_id", F.round("best", 3).alias("best"), verdict.alias("verdict"))


@query(f"WITH {POINTS_SQL}, d AS (SELECT vec_id, 2 * atanh(sqrt(list_inner_product(p, p))) AS depth FROM points) SELECT vec_id, round(depth, 3) AS depth FROM d")
def curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Depth from the origin, which orders what is learnt first."""
    return points(spark, sf).select("vec_id", F.round(G.distance(F.col("p"), F.transform("p", lambda x: x * 0.0)), 3).alias("depth"))
