"""Text functions (F1 to F35) over the documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .common import FACTS_SQL, STOP_SQL, TOKENS_SQL, facts, tokens
from .registry import load, query

LETTERS = "[A-Za-z0-9_]"


@query("""SELECT doc_id, sha1(text) AS content_hash FROM documents""")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("content_hash"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\s+([a-zà-öø-ÿ])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(T.normalise_text(F.col("text"))).alias("digest"))


@query(f"""WITH {TOKENS_SQL} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY token HAVING count(*) >= 5""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 5")


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN {STOP_SQL}) AS w FROM documents)
SELECT doc_id, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS n_bigrams FROM t""")
def bigram_sets(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(T.bigrams(T.tokenize(F.col("text")))).cast("long").alias("n_bigrams"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(greatest((length(text) - 200 - 1) // 1800, 0) + 1)) AS k FROM documents)
SELECT doc_id, k, length(substring(text, (k * 1800 + 1)::BIGINT, 2000)) AS n FROM c""")
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("k", "chunk")).select("doc_id", F.col("k").cast("long").alias("k"), F.char_length("chunk").cast("long").alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT doc_id, count(*) AS n_sentences, max(length(fact_text)) AS longest FROM facts GROUP BY doc_id""")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.char_length("fact_text")).cast("long").alias("longest"))


@query(rf"""WITH w AS (SELECT regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]+', ' | ', 'g'), '\s+') AS w FROM documents),
p AS (SELECT unnest(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN x IN {STOP_SQL} THEN '|' ELSE x END), ' '), '|'), lambda x: trim(x))) AS phrase FROM w)
SELECT phrase, count(*) AS n FROM p WHERE length(phrase) > 2 GROUP BY phrase ORDER BY n DESC, phrase LIMIT 20""")
def key_phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "documents").select(F.explode(T.phrases(F.col("text"))).alias("phrase"))
    return p.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(20)


@query("""SELECT n_nationkey, list_sort(list_distinct([n_name, lower(n_name), array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), regexp_replace(lower(n_name), 's$', ''), regexp_replace(lower(n_name), 'ies$', 'y')])) AS variants
FROM nation""")
def keyword_variants(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nation").select("n_nationkey", T.keyword_variants(F.col("n_name")).alias("variants"))


@query("""SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS mention, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part""".replace("\\\\", "\\"))
def normal_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", T.mention(F.col("p_name")).alias("mention"), T.normal_name(F.col("p_name")).alias("name"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def normal_dates(spark: SparkSession, sf: str) -> DataFrame:
    written = F.date_format("o_orderdate", "MMMM d, yyyy")
    return load(spark, sf, "orders").select("o_orderkey", T.normal_date(written).alias("iso"))


@query(f"""WITH {FACTS_SQL}, q AS (SELECT ['thatst', 'reand', 'eration', 'tion'] AS w),
t AS (SELECT fact_id, list_filter(regexp_split_to_array(regexp_replace(lower(fact_text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 AND x NOT IN {STOP_SQL}) AS w FROM facts),
s AS (SELECT fact_id, list_distinct(t.w || q.w) AS u, list_intersect(t.w, q.w) AS i FROM t, q)
SELECT fact_id, round(coalesce(list_sum(list_transform(i, lambda x: ln(1 + 10000.0 / (1 + 10.0 * length(x))))), 0) / list_sum(list_transform(u, lambda x: ln(1 + 10000.0 / (1 + 10.0 * length(x))))), 6) AS jaccard FROM s""")
def weighted_overlap(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    q = F.array(*map(F.lit, ["thatst", "reand", "eration", "tion"]))
    return f.select("fact_id", F.round(T.weighted_jaccard(T.tokenize(F.col("fact_text")), q), 6).alias("jaccard"))


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails FROM conversations""")
def email_hits(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))).cast("long").alias("emails"))


@query()
def redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lookarounds are not in the oracle's dialect; tested against a plain loop."""
    out = load(spark, sf, "documents").select("doc_id", T.redact(F.coalesce("text", F.lit(""))).alias("t"))
    hits = lambda m: ((F.length("t") - F.length(F.replace(F.col("t"), F.lit(m), F.lit("")))) / len(m)).cast("long")
    return out.select("doc_id", F.md5("t").alias("digest"), *(hits(f"[{m}]").alias(m.lower()) for m in ("CARD", "SSN", "EMAIL", "PHONE")))


@query(r"""WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '0') AS digits FROM orders),
x AS (SELECT o_orderkey, digits, list_transform(range(1, 9), lambda i: CASE WHEN (8 - i) % 2 = 1 THEN CASE WHEN digits[i]::INT > 4 THEN digits[i]::INT * 2 - 9 ELSE digits[i]::INT * 2 END ELSE digits[i]::INT END) AS v FROM d)
SELECT o_orderkey, digits, list_sum(v) % 10 = 0 AS ok FROM x""")
def luhn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 8, "0").alias("digits"))
    return d.withColumn("ok", T.luhn(F.col("digits")))


def _stage_sql() -> str:
    sums = {s: " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in ps.items()) for s, ps in T.STAGES.items()}
    return f"""WITH s AS (SELECT conv_id, turn, {", ".join(f"{v} AS {k}" for k, v in sums.items())} FROM conversations)
SELECT conv_id, turn, CASE WHEN grammar >= logic AND grammar >= rhetoric THEN 'grammar' WHEN logic >= rhetoric THEN 'logic' ELSE 'rhetoric' END AS stage,
CASE WHEN grammar + logic + rhetoric = 0 THEN 0.0 ELSE round(greatest(grammar, logic, rhetoric)::DOUBLE / (grammar + logic + rhetoric), 3) END AS share FROM s"""


@query(_stage_sql())
def stage_classes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", T.stage(F.col("text")).alias("s")).select("conv_id", "turn", "s.stage", "s.share")


def _intent_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in T.INTENTS.items())
    return f"SELECT conv_id, turn, CASE {cases} ELSE 'general' END AS intent FROM conversations"


@query(_intent_sql())
def intents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))


def _triple_sql() -> str:
    def case(group: int | None) -> str:
        def out(p: str, name: str) -> str:
            if group is None:
                return f"'{name}'"
            return f"regexp_replace(trim(regexp_extract(text, '(?i){p}', {group})), '^(?i:a|an|the)\\s+', '')"

        return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {out(p, n)}" for p, n in T.TRIPLES) + " END"

    return rf"""WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'The ' || s_name || ' is located in nation ' || s_nationkey WHEN 1 THEN s_name || ' is a supplier of parts'
 WHEN 2 THEN 'An ' || s_name || ' works for the region' ELSE s_name || ' sells' END AS text FROM supplier)
SELECT s_suppkey, {case(1)} AS subject, {case(None)} AS predicate, {case(2)} AS object FROM t"""


@query(_triple_sql())
def triples_from_text(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    text = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" is located in nation "), F.col("s_nationkey"))).when(k == 1, F.concat(name, F.lit(" is a supplier of parts"))).when(k == 2, F.concat(F.lit("An "), name, F.lit(" works for the region"))).otherwise(F.concat(name, F.lit(" sells")))
    return load(spark, sf, "supplier").select("s_suppkey", T.triple(text).alias("t")).select("s_suppkey", "t.*")


@query(f"""WITH {FACTS_SQL} SELECT fact_id, CASE WHEN fact_type = 0 THEN 'ASSERTED' WHEN fact_type = 1 THEN 'OBSERVED' WHEN fact_type = 2 THEN CASE WHEN pos > 0 THEN 'OBSERVED' ELSE 'INFERRED' END WHEN fact_type = 3 THEN 'INFERRED' ELSE 'REPUTED' END AS truth FROM facts""")
def truth_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("fact_type")
    status = F.when(t == 0, "admin_claim").when(t == 1, "verified_true").otherwise("")
    checked = F.when(t == 3, "verified").otherwise("")
    return facts(spark, sf).select("fact_id", T.truth_class(status, F.lit(""), t == 2, F.when(F.col("pos") > 0, F.lit("span")), checked).alias("truth"))


@query("""SELECT c_custkey, sha256(c_name || chr(0) || c_nationkey || chr(0) || coalesce(c_mktsegment, '')) AS material FROM customer""")
def material_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", T.material_hash(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("material"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\\s+[^>]*href')) AS links FROM pages""".replace("\\\\", "\\"))
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s+[^>]*href"), F.lit(0))).cast("long").alias("links"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), x AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS line_no FROM l)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '(?i)(password|secret|token|api_?key)\s*[:=]\s*["'']?[A-Za-z0-9]{8,}') THEN 'literal secret' ELSE 'select star' END AS rule FROM x
WHERE regexp_matches(line, '(?i)(password|secret|token|api_?key)\s*[:=]\s*["'']?[A-Za-z0-9]{8,}') OR regexp_matches(line, '(?i)select\s+\*')""")
def line_rules(spark: SparkSession, sf: str) -> DataFrame:
    secret = r"""(?i)(password|secret|token|api_?key)\s*[:=]\s*["']?[A-Za-z0-9]{8,}"""
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = lines.where(F.col("line").rlike(secret) | F.col("line").rlike(r"(?i)select\s+\*"))
    return hits.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("line").rlike(secret), "literal secret").otherwise("select star").alias("rule"))


@query("""SELECT doc_id, CASE WHEN position('tion' IN text) > 0 THEN substring(text, greatest(position('tion' IN text) - 40, 1), 100) ELSE '' END AS preview FROM documents""")
def preview_windows(spark: SparkSession, sf: str) -> DataFrame:
    at = F.instr("text", "tion")
    return load(spark, sf, "documents").select("doc_id", F.when(at > 0, F.substring(F.col("text"), F.greatest(at - 40, F.lit(1)), F.lit(100))).otherwise(F.lit("")).alias("preview"))
