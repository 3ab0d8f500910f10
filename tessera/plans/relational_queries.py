"""Filters, joins, aggregates, window-like operators and set operations (P, J, A, W, U, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..storage import settle
from .common import EDGES_SQL, FACTS_SQL, SIDES_SQL, TOKENS_SQL, TRIPLES_SQL, edges, facts, opposed, tokens, triples
from .registry import load, query


@query("SELECT c_custkey AS id, upper(c_name) AS label FROM customer WHERE c_name ILIKE '%0001%' OR c_mktsegment ILIKE 'build%'")
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.where(c.c_name.ilike("%0001%") | c.c_mktsegment.ilike("build%")).select(c.c_custkey.alias("id"), F.upper(c.c_name).alias("label"))


@query(f"WITH {TRIPLES_SQL} SELECT * FROM triples WHERE predicate = 'located_in' AND lower(object) = 'n3'")
def triple_filter(spark: SparkSession, sf: str) -> DataFrame:
    return triples(spark, sf).where(R.all_of(F.col("predicate") == "located_in", None, F.lower("object") == "n3"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def in_list(spark: SparkSession, sf: str) -> DataFrame:
    rich = load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(f"""WITH {TOKENS_SQL} SELECT token, count(*) AS n FROM tokens WHERE length(token) < 3 AND NOT regexp_matches(token, '^[0-9]+$') GROUP BY token""")
def junk_keywords(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf)
    return t.where((F.length("token") < 3) & ~F.col("token").rlike("^[0-9]+$")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL}, t AS (SELECT fact_id, CASE WHEN pos % 9 = 0 THEN confidence * 0.8 ELSE confidence END AS c, confidence, fact_type = 0 AS priority FROM facts)
SELECT fact_id, round(CASE WHEN confidence > 0.9 THEN c * (CASE WHEN priority THEN 0.9 ELSE 0.7 END) ELSE c END, 6) AS confidence FROM t WHERE c >= CASE WHEN priority THEN 0.2 ELSE 0.3 END""")
def triage(spark: SparkSession, sf: str) -> DataFrame:
    """Drop weak facts (priority ones later), after the penalty for a missing span; then the penalty for verbatim ones."""
    f = facts(spark, sf).withColumn("priority", F.col("fact_type") == 0).withColumn("c", F.when(F.col("pos") % 9 == 0, F.col("confidence") * 0.8).otherwise(F.col("confidence")))
    kept = f.where(F.col("c") >= F.when(F.col("priority"), 0.2).otherwise(0.3))
    verbatim = F.when(F.col("confidence") > 0.9, F.col("c") * F.when(F.col("priority"), 0.9).otherwise(0.7)).otherwise(F.col("c"))
    return kept.select("fact_id", F.round(verbatim, 6).alias("confidence"))


@query("SELECT o_orderkey, greatest(0.0, least(1.0, coalesce(try_cast(o_totalprice AS DOUBLE), 0) / 300000.0)) AS confidence FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> ''")
def coerced_confidence(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_orderstatus IS NOT NULL AND o_orderstatus <> ''")
    c = F.coalesce(F.expr("try_cast(o_totalprice AS double)"), F.lit(0.0)) / 300000.0
    return o.select("o_orderkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"))


@query(f"""WITH {FACTS_SQL} SELECT f.fact_id, position(f.fact_text IN d.text) - 1 AS start FROM facts f JOIN documents d USING (doc_id)""")
def grounded_spans(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    d = load(spark, sf, "documents").select("doc_id", "text")
    return f.join(d, "doc_id").select("fact_id", (F.expr("instr(text, fact_text)") - 1).cast("long").alias("start"))


@query("SELECT conv_id, turn, text FROM conversations WHERE (conv_id % 3 = 0 AND conv_id = 9) OR conv_id % 3 = 1 OR (conv_id % 3 = 2 AND role IN ('user'))")
def visible_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Private rows to their own session alone, shared ones to all, global ones by an allow list."""
    c, scope = load(spark, sf, "conversations"), F.col("conv_id") % 3
    return c.where(((scope == 0) & (F.col("conv_id") == 9)) | (scope == 1) | ((scope == 2) & F.col("role").isin("user"))).select("conv_id", "turn", "text")


@query(f"WITH {EDGES_SQL} SELECT s.s_name AS subject, 'supplies' AS predicate, p.p_name AS object, e.weight FROM edges e JOIN supplier s ON e.src = s.s_suppkey JOIN part p ON e.dst = 1000000 + p.p_partkey")
def named_triples(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("subject"))
    p = load(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("dst"), F.col("p_name").alias("object"))
    return edges(spark, sf).join(R.small(s), "src").join(p, "dst").select("subject", F.lit("supplies").alias("predicate"), "object", "weight")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
def facts_with_sources(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return load(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unlinked_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey").join(load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"WITH {EDGES_SQL}, n AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT 1000000 + p_partkey FROM part) SELECT n.id, count(e.src) AS degree FROM n LEFT JOIN edges e ON e.src = n.id OR e.dst = n.id GROUP BY n.id")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).unionAll(load(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("id")))
    d = R.degrees(edges(spark, sf)).withColumnRenamed("node", "id")
    return n.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS subject, l_partkey AS object FROM lineitem)
SELECT a.subject, a.object, min(b.object) AS other, count(*) AS links FROM x a JOIN x b ON a.subject = b.subject AND a.object <> b.object GROUP BY ALL""")
def conflicting_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Each object with what conflicts with it in its whole subject, however far: the first other object, and how many there are.

    A subject's count and two least objects are summed up before its rows meet them, so
    no pairs are made.
    """
    x = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"))
    return R.others(x, ["subject"], "object").select("subject", "object", "other", "links")


@query(f"""WITH {FACTS_SQL}, {SIDES_SQL} SELECT f.fact_id, s.first AS opposed_to, s.links FROM facts f JOIN sides s ON f.fact_type = s.fact_type AND f.canonical_value = s.canonical_value AND f.negation <> s.negation""")
def opposed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact that others of its type and value oppose: the first of them, and how many there are."""
    return opposed(facts(spark, sf)).select("fact_id", F.col("first").alias("opposed_to"), "links")


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_totalprice)::DOUBLE AS total FROM orders GROUP BY o_orderstatus")
def counts_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("double").alias("total"))


@query(f"WITH {TOKENS_SQL} SELECT token, count(DISTINCT source) AS topics FROM tokens GROUP BY token HAVING count(DISTINCT source) > 8")
def over_general_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).groupBy("token").agg(F.countDistinct("source").alias("topics")).where("topics > 8")


@query("SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 50")
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last")).orderBy(F.desc("last"), "conv_id").limit(50)


@query("SELECT text, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) >= 2")
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 2")


@query(f"WITH {TOKENS_SQL} SELECT token AS keyword, source AS topic, count(*) AS weight, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tokens GROUP BY ALL")
def keyword_topic_weights(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens(spark, sf).groupBy(F.col("token").alias("keyword"), F.col("source").alias("topic"))
    return t.agg(F.count("*").alias("weight"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


KEYWORDS_SQL = f"""{TOKENS_SQL}, k AS (SELECT doc_id, token FROM (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) AS r FROM tokens GROUP BY doc_id, token) WHERE r <= 6)"""


def doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    n = tokens(spark, sf).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return R.top_by(n, ["doc_id"], [F.desc("n"), F.col("token")], 6).select("doc_id", "token")


@query(f"WITH {KEYWORDS_SQL} SELECT a.token AS a, b.token AS b, count(*) AS n, min(a.doc_id) AS first_doc, max(a.doc_id) AS last_doc FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.token < b.token GROUP BY ALL HAVING count(*) >= 3")
def keyword_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a document's six keywords: tokens are counted in their row, and at most 15 pairs a document are shuffled."""
    runs = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("token"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(w, x["i"] - 1) != x["token"]))  # noqa: E731  where each token begins
    sizes = lambda v: F.transform(v["runs"], lambda x, k: F.struct((x["i"] - F.coalesce(F.get(v["runs"], k + 1)["i"], F.size(v["w"]))).alias("less"), x["token"].alias("token")))  # noqa: E731  the most frequent sorts first
    count = lambda w: T.let(F.struct(w.alias("w"), runs(w).alias("runs")), sizes)
    counted = load(spark, sf, "documents").select("doc_id", T.let(F.array_sort(T.tokenize(F.col("text"))), lambda w: F.slice(F.array_sort(count(w)), 1, 6)).alias("n"))
    k = counted.select("doc_id", F.array_sort(F.transform("n", lambda x: x["token"])).alias("t"))
    pairs = k.select("doc_id", "t", F.posexplode("t").alias("i", "a")).select("doc_id", "a", F.explode(F.expr("slice(t, i + 2, 6)")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("n >= 3")


@query("SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS rel, sum(l_quantity)::DOUBLE AS weight, count(*) AS occurrences, min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY ALL")
def upserted_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"))
    return g.agg(F.sum("l_quantity").cast("double").alias("weight"), F.count("*").alias("occurrences"), F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))


@query("SELECT o_orderstatus, round(quantile_cont(o_totalprice::DOUBLE, 0.25), 4) AS p25, round(quantile_cont(o_totalprice::DOUBLE, 0.75), 4) AS p75, round(median(o_totalprice::DOUBLE), 4) AS med FROM orders GROUP BY ALL")
def similarity_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda q: F.round(F.percentile(F.col("o_totalprice").cast("double"), q), 4)
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.5).alias("med"))


@query(f"WITH {FACTS_SQL} SELECT d.doc_id, count(f.fact_id) AS facts, round(count(f.fact_id)::DOUBLE / (length(any_value(d.text)) // 2000 + 1), 6) AS per_chunk FROM documents d LEFT JOIN facts f ON d.doc_id = f.doc_id AND f.confidence > 0.8 GROUP BY d.doc_id HAVING count(f.fact_id)::DOUBLE / (length(any_value(d.text)) // 2000 + 1) < 0.5")
def thin_documents(spark: SparkSession, sf: str) -> DataFrame:
    n = facts(spark, sf).where("confidence > 0.8").groupBy("doc_id").agg(F.count("*").alias("facts"))
    d = load(spark, sf, "documents").select("doc_id", (F.floor(F.char_length("text") / 2000) + 1).alias("chunks")).join(n, "doc_id", "left").fillna(0, ["facts"])
    return d.withColumn("per_chunk", F.round(F.col("facts") / F.col("chunks"), 6)).where("facts / chunks < 0.5").select("doc_id", "facts", "per_chunk")


@query(f"WITH {FACTS_SQL}, s AS (SELECT avg(CASE WHEN canonical_value <> '' THEN 1.0 ELSE 0 END) AS filled, avg(CASE WHEN fact_type IN (1, 2) THEN 1.0 ELSE 0 END) AS dual, avg(CASE WHEN pos > 0 THEN 1.0 ELSE 0 END) AS linked FROM facts) SELECT round(filled, 6) AS filled, round(dual, 6) AS dual, round(linked, 6) AS linked, round((filled + dual + linked) / 3, 6) AS closure FROM s")
def closure_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    s = facts(spark, sf).agg(rate(F.col("canonical_value") != "").alias("a"), rate(F.col("fact_type").isin(1, 2)).alias("b"), rate(F.col("pos") > 0).alias("c"))
    return s.select(F.round("a", 6).alias("filled"), F.round("b", 6).alias("dual"), F.round("c", 6).alias("linked"), F.round(F.expr("(a + b + c) / 3"), 6).alias("closure"))


@query("""WITH s AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS high, round(avg(CASE WHEN value > 50 AND prev > 50 THEN 1.0 ELSE 0 END), 6) AS both_high, round(sum(abs(value - prev)) / nullif(abs(max(value) - min(value)), 0), 6) AS path_ratio FROM s GROUP BY user_id""")
def regime_rates(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = load(spark, sf, "events").withColumn("prev", F.lag("value").over(w))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    span = F.abs(F.max("value") - F.min("value"))
    return s.groupBy("user_id").agg(F.count("*").alias("n"), rate(F.col("value") > 50).alias("high"), rate((F.col("value") > 50) & (F.col("prev") > 50)).alias("both_high"), F.round(F.sum(F.abs(F.col("value") - F.col("prev"))) / F.when(span != 0, span), 6).alias("path_ratio"))


@query("""WITH d AS (SELECT turn, conv_id, text, lower(trim(text)) AS k, (conv_id * 31 + turn * 17) % 100 AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, conv_id * 1000 + turn) AS rn, min(conv_id * 1000 + turn) OVER (PARTITION BY k) AS pos FROM d)
SELECT k, score, pos FROM r WHERE rn = 1""")
def best_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "conversations").select(F.lower(F.trim("text")).alias("k"), ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100).alias("score"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return R.best_duplicate(d, ["k"], "score", "pos")


@query(f"WITH {FACTS_SQL} SELECT lower(trim(fact_text)) AS k, min(fact_id) AS fact_id FROM facts GROUP BY ALL")
def first_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return R.keep_first(facts(spark, sf).select(F.lower(F.trim("fact_text")).alias("k"), "fact_id"), ["k"], "fact_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_by(load(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, md5(o_orderstatus) AS h, lag(md5(o_orderstatus)) OVER w AS prev, lag(o_orderkey) OVER w AS supersedes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, supersedes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM v WHERE prev IS NULL OR prev <> h""")
def fact_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose content differs from the version before them."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.md5("o_orderstatus").alias("h")).withColumns({"prev": F.lag("h").over(w), "supersedes": F.lag("o_orderkey").over(w)})
    return v.where("prev IS NULL OR prev <> h").withColumn("version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).select("o_custkey", "o_orderkey", "supersedes", "version")


@query("SELECT s_suppkey, round((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1)::DOUBLE / (count(*) OVER () - 1) * 0.999999, 6) AS depth FROM supplier")
def depth_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Rank by sorted ranges: each range's count gives the ranks' offsets, so no task sorts the whole."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = settle(load(spark, sf, "supplier").select("s_suppkey", "s_acctbal").repartitionByRange(parts, "s_acctbal", "s_suppkey").withColumn("part", F.spark_partition_id()))
    n = s.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("s_acctbal", "s_suppkey"))).join(F.broadcast(before), "part")
    return r.select("s_suppkey", F.round((F.col("before") + F.col("rn") - 1) / (F.col("total") - 1) * 0.999999, 6).alias("depth"))


SHIFT_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({SHIFT_TOKENS}) AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS pw FROM t)
SELECT conv_id, turn, CASE WHEN pw IS NULL OR len(w) = 0 THEN false ELSE len(list_intersect(w, pw))::DOUBLE / len(w) < 0.3 END AS shift FROM p""")
def topic_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """A turn that shares less than 0.3 of its terms with the one before."""
    from ..functions import text as T

    c = load(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(T.tokenize(F.col("text"), ("",))).alias("w"))
    p = c.withColumn("pw", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    share = F.size(F.array_intersect("w", "pw")) / F.size("w")
    return p.select("conv_id", "turn", F.when(F.col("pw").isNull() | (F.size("w") == 0), False).otherwise(share < 0.3).alias("shift"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT id FROM (SELECT src AS id FROM edges WHERE weight > 1 UNION ALL SELECT dst FROM edges WHERE weight > 1) EXCEPT SELECT 1000000 + p_partkey FROM part WHERE p_size > 25")
def candidate_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("weight > 1")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ids.join(load(spark, sf, "part").where("p_size > 25").select((F.col("p_partkey") + 1000000).alias("id")), "id", "left_anti")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf, "conversations").withColumn("used", F.sum(F.char_length("text")).over(w)).where("used <= 600").select("conv_id", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def skip_processed(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    ledger = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "processed").otherwise("error").alias("status"))
    return R.not_yet_done(o.select("o_orderkey"), ledger, "o_orderkey")
