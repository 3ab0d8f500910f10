"""Graph queries (X10 to X23, X63, J4) on suppliers, parts, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .common import EDGES_SQL, TRIPLES_SQL, edges, triples
from .registry import load, query

HEAVY_SQL = f"{EDGES_SQL}, e AS (SELECT * FROM edges WHERE weight >= 2), both_ AS (SELECT src AS a, dst AS b, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def heavy(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where("weight >= 2")


@query(f"""WITH RECURSIVE {TRIPLES_SQL}, t AS (SELECT subject AS src, object AS dst FROM triples), c AS (SELECT src, dst, 1 AS hops FROM t UNION SELECT c.src, t.dst, c.hops + 1 FROM c JOIN t ON c.dst = t.src WHERE c.hops < 6)
SELECT src, dst, min(hops) AS hops FROM c GROUP BY ALL""")
def implied_triples(spark: SparkSession, sf: str) -> DataFrame:
    """located_in and part_of compose."""
    return G.closure(triples(spark, sf).select(F.col("subject").alias("src"), F.col("object").alias("dst")), [], 6)


@query(f"""WITH RECURSIVE {HEAVY_SQL}, x AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT both_.b, x.hops + 1 FROM x JOIN both_ ON both_.a = x.node WHERE x.hops < 3)
SELECT node, min(hops) AS hops FROM x GROUP BY node""")
def multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    return G.expand(heavy(spark, sf), spark.range(1, 2).select(F.col("id").alias("node")), 3)


@query(f"""WITH RECURSIVE {HEAVY_SQL}, x AS (SELECT 1::BIGINT AS node, 0 AS hops UNION SELECT both_.b, x.hops + 1 FROM x JOIN both_ ON both_.a = x.node WHERE x.hops < 4)
SELECT 1::BIGINT AS start, node AS "end", min(hops) AS hops FROM x WHERE node IN (2, 3, 4) GROUP BY node""")
def shortest_path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.range(1, 2).select(F.col("id").alias("node"))
    p = G.shortest_paths(heavy(spark, sf), one, spark.range(2, 5).select(F.col("id").alias("node")), 4)
    return p.select("start", "end", (F.size("path") - 1).alias("hops"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT * FROM edges WHERE weight >= 3), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS root FROM b UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("weight >= 3")
    return G.components(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e)


def _pagerank_sql(rounds: int) -> str:
    head = f"{EDGES_SQL}, d AS (SELECT src, dst, weight::DOUBLE AS weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), n AS (SELECT DISTINCT src AS node FROM d), k AS (SELECT count(*) AS c FROM n), o AS (SELECT src, sum(weight) AS total FROM d GROUP BY src), s AS (SELECT d.src, d.dst, d.weight / o.total AS share FROM d JOIN o USING (src)), r0 AS (SELECT node, 1.0 / c AS rank FROM n, k)"
    for i in range(rounds):
        head += f", r{i + 1} AS (SELECT n.node, 0.15 / any_value(k.c) + 0.85 * coalesce(sum(r{i}.rank * s.share), 0) AS rank FROM n CROSS JOIN k LEFT JOIN s ON s.dst = n.node LEFT JOIN r{i} ON r{i}.node = s.src GROUP BY n.node)"
    return f"WITH {head} SELECT node, round(rank * 1e6, 3) AS rank FROM r{rounds} ORDER BY rank DESC, node LIMIT 20"


@query(_pagerank_sql(3))
def page_rank(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.relational import undirected

    r = G.pagerank(undirected(edges(spark, sf)), 3)
    return r.select("node", F.round(F.col("rank") * 1e6, 3).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


@query()
def keyword_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Label propagation; communities by modularity would need the whole graph in one place."""
    return G.communities(heavy(spark, sf))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), f AS (SELECT s_suppkey AS node, s_acctbal AS x FROM supplier UNION ALL SELECT 1000000 + p_partkey, p_retailprice FROM part)
SELECT f.node, any_value(f.x) AS own, round(coalesce(avg(g.x), 0), 6) AS around FROM f LEFT JOIN b ON b.a = f.node LEFT JOIN f g ON g.node = b.b GROUP BY f.node""")
def neighbour_features(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x")).unionAll(load(spark, sf, "part").select(F.col("p_partkey") + 1000000, "p_retailprice"))
    return G.neighbour_mean(edges(spark, sf), f).select("node", "own", F.round("around", 6).alias("around"))


@query(f"""WITH {TRIPLES_SQL}, n AS (SELECT subject AS label, left(subject, 1) AS kind FROM triples UNION SELECT object, left(object, 1) FROM triples)
SELECT kind, count(*) AS nodes, (SELECT count(DISTINCT (subject, predicate, object)) FROM triples t WHERE left(t.subject, 1) = n.kind) AS edges FROM n GROUP BY kind""")
def hypergraph(spark: SparkSession, sf: str) -> DataFrame:
    """One node for each type and normalised label; edges by the type of their subject."""
    t = triples(spark, sf).distinct()
    nodes = t.select(F.explode(F.array("subject", "object")).alias("label")).distinct().groupBy(F.substring("label", 1, 1).alias("kind")).agg(F.count("*").alias("nodes"))
    out = t.groupBy(F.substring("subject", 1, 1).alias("kind")).agg(F.count("*").alias("edges"))
    return nodes.join(out, "kind", "left").fillna(0, ["edges"])


@query("""WITH m AS (SELECT lower(regexp_replace(p_name, '[0-9#]', '', 'g')) AS name, p_type AS kind, p_partkey AS id FROM part) SELECT kind, name, min(id) AS canonical, count(*) AS members FROM m GROUP BY ALL""")
def canonical_nodes(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "part").select(F.lower(F.regexp_replace("p_name", "[0-9#]", "")).alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("id"))
    return m.groupBy("kind", "name").agg(F.min("id").alias("canonical"), F.count("*").alias("members"))


@query("""WITH a AS (SELECT n_nationkey AS id, lower(n_name) AS alias FROM nation UNION ALL SELECT n_nationkey, left(lower(n_name), 3) FROM nation), q AS (SELECT unnest(['france', 'uni', 'ger', 'in']) AS q)
SELECT q, id, max(CASE WHEN alias = q THEN 1.0 ELSE 0.5 END) AS score FROM q JOIN a ON alias = q OR starts_with(alias, q) GROUP BY ALL""")
def alias_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Exact aliases, then prefixes: the alias's prefixes of a query's length make it an equi-join."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("n"))
    a = n.select("id", F.explode(F.array("n", F.substring("n", 1, 3))).alias("alias"))
    asked = spark.createDataFrame([(x,) for x in ("france", "uni", "ger", "in")], "q string")
    prefixes = a.select("id", "alias", F.explode(F.expr("transform(sequence(1, length(alias)), k -> left(alias, k))")).alias("q"))
    return prefixes.join(F.broadcast(asked), "q").groupBy("q", "id").agg(F.max(F.when(F.col("alias") == F.col("q"), 1.0).otherwise(0.5)).alias("score"))


@query(f"""WITH {TRIPLES_SQL} SELECT r.object AS root, n.subject AS nation, count(c.subject) AS members, repeat('  ', 1) || n.subject AS line FROM triples r JOIN triples n ON n.subject = r.subject AND n.predicate = 'part_of' LEFT JOIN triples c ON c.object = n.subject AND c.predicate = 'located_in' WHERE r.predicate = 'part_of' GROUP BY ALL""")
def mind_map(spark: SparkSession, sf: str) -> DataFrame:
    t = triples(spark, sf)
    n = t.where("predicate = 'part_of'").select(F.col("subject").alias("nation"), F.col("object").alias("root"))
    c = t.where("predicate = 'located_in'").groupBy(F.col("object").alias("nation")).agg(F.count("*").alias("members"))
    return n.join(c, "nation", "left").fillna(0, ["members"]).withColumn("line", F.concat(F.lit("  "), "nation"))


@query(f"""WITH {TRIPLES_SQL}, p AS (SELECT subject, object, row_number() OVER (PARTITION BY object ORDER BY subject) AS r FROM triples WHERE predicate = 'located_in')
SELECT a.subject AS anchor, b.subject AS negative, a.object AS parent FROM p a JOIN p b ON a.object = b.object AND a.r <= 5 AND b.r <= 5 AND a.subject <> b.subject""")
def mined_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings under a parent: the first five of each, so a parent gives 20 pairs at most."""
    from ..operators.relational import top_by

    p = top_by(triples(spark, sf).where("predicate = 'located_in'"), ["object"], [F.col("subject")], 5).select("subject", "object")
    b = p.select(F.col("subject").alias("negative"), "object")
    return p.join(b, "object").where("subject != negative").select(F.col("subject").alias("anchor"), "negative", F.col("object").alias("parent"))
