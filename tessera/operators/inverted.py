"""A search index on disk: posting lists, vocabulary and words of the rows, written once and read by every search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..storage import settle
from .relational import small
from .retrieval import PHRASE, TERMS
from .vectors import met

#: Folders that posting lists are dealt to by their tokens, files of a folder at most; postings that a first guess of the k-th score may read; weight of a vector hit.
BUCKETS, SALTS, SEED, VECTOR = 64, 16, 5000, 0.7


def variants(tokens: Column) -> Column:
    """Words as they are, then without a plural's s, then -ies as -y; each once."""
    without = F.transform(F.filter(tokens, lambda t: F.endswith(t, F.lit("s")) & (F.length(t) > 3)), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    singular = F.transform(F.filter(tokens, lambda t: F.endswith(t, F.lit("ies")) & (F.length(t) > 4)), lambda t: F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
    return F.array_distinct(F.concat(tokens, without, singular))


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """Rows (key, text) by their words.

    `build` writes three tables: postings (bucket, token, key), a bucket's dealt by the key too, so
    that a word which a third of all rows hold fills several files; the vocabulary
    (token, rows) with how many rows hold each word; and the rows' words, which exact scores are
    taken from. Rows without words, and null texts, are in none of them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path, key

    def build(self, rows: DataFrame) -> SearchIndex:
        words = rows.select(self.key, T.tokenize(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
        # a space before each word and one at the end: " x" finds words that begin with x, " x y " a phrase
        words.select(self.key, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("words")).write.parquet(f"{self.path}/rows")
        each = self._read("rows").select(self.key, F.explode(F.array_distinct(F.split(F.trim("words"), " "))).alias("token")).withColumn("bucket", bucket(F.col("token")))
        dealt = each.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(SALTS))).sortWithinPartitions("bucket", "token", self.key)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        self._read("postings").groupBy("token").agg(F.count("*").alias("rows")).write.parquet(f"{self.path}/vocabulary")
        return self

    def _read(self, table: str) -> DataFrame:
        if table == "postings":  # an empty table has no folder that a schema could be read from
            kind = self._read("rows").schema[self.key].dataType.simpleString()
            return self.spark.read.schema(f"token string, `{self.key}` {kind}, bucket int").parquet(f"{self.path}/postings")
        return self.spark.read.parquet(f"{self.path}/{table}")

    def terms(self, queries: DataFrame, query: str, most: int | None = TERMS, of_phrase: int | None = PHRASE) -> DataFrame:
        """(query, term, weight, named, n, phrase, bonus): variants of each query's first `most` words. Of `phrase`, its first `of_phrase` words with spaces, `named` words are terms with named = 1, n in all, and it adds `bonus`. None: all words.
        """
        q = queries.select(query, T.tokenize(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
        begun = F.col("w") if of_phrase is None else F.slice("w", 1, of_phrase)
        bonus = F.when(F.size("w") >= (of_phrase or 1), 2.0 * F.size(begun))
        phrase = F.when(bonus.isNotNull(), F.concat(F.lit(" "), F.array_join(begun, " "), F.lit(" ")))
        words = F.array_distinct("w") if most is None else F.slice(F.array_distinct("w"), 1, most)
        q = q.select(query, phrase.alias("phrase"), bonus.alias("bonus"), F.array_distinct(begun).alias("first"), variants(words).alias("v"))
        each = q.select(query, "phrase", "bonus", F.size("first").alias("n"), "first", F.explode("v").alias("term"))
        return each.select(query, "term", F.greatest(F.lit(1.0), F.length("term") / 4).alias("weight"), F.array_contains("first", F.col("term")).cast("int").alias("named"), "n", "phrase", "bonus")

    def expand(self, terms: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
        """Tokens (term, anywhere, token, rows) of the vocabulary that begin with a term, and lists: the terms with `anywhere` and the rows of all their tokens.

        Queries for none of whose terms there is such a token take the tokens that hold them anywhere. Each
        different term is looked up once. Terms meet tokens by their first two letters, and by any two
        adjacent ones in the second case: no cross join.
        """
        vocabulary = self._read("vocabulary")
        asked = terms.select("term", F.substring("term", 1, 2).alias("pair")).distinct()
        begins = vocabulary.withColumn("pair", F.substring("token", 1, 2)).join(small(asked), "pair").where(F.startswith("token", F.col("term")))
        begins = settle(begins.select("term", F.lit(False).alias("anywhere"), "token", "rows"), "search-tokens")
        known = terms.join(begins.select("term").distinct(), "term", "left_semi").select(query).distinct()
        rest = settle(terms.join(known, query, "left_anti"), "search-rest")
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))
        within = vocabulary.withColumn("pair", F.explode(pairs)).join(small(rest.select("term", F.substring("term", 1, 2).alias("pair")).distinct()), "pair").where(F.contains("token", F.col("term")))
        tokens = begins.unionAll(within.select("term", F.lit(True).alias("anywhere"), "token", "rows"))
        per = tokens.groupBy("term", "anywhere").agg(F.sum("rows").alias("rows"))
        own = terms.join(known, query, "left_semi").withColumn("anywhere", F.lit(False)).unionByName(rest.withColumn("anywhere", F.lit(True)))
        return tokens, settle(own.join(per, ["term", "anywhere"]), "search-lists")

    def _held(self, lists: DataFrame, tokens: DataFrame, query: str) -> DataFrame:
        """(query, key, score, named): what the terms of `lists` that a row holds weigh, and how many are of the phrase. A list that many queries ask for is read once; only its buckets are, where its tokens are few enough to be broadcast."""
        term = ["term", "anywhere"]
        asked = tokens.join(small(lists.select(*term).distinct()), term, "left_semi").select(*term, "token", bucket(F.col("token")).alias("bucket"))
        rows = self._read("postings").join(small(asked), ["bucket", "token"]).select(*term, self.key).distinct()
        return rows.join(small(lists.select(query, *term, "weight", "named")), term).groupBy(query, self.key).agg(F.sum("weight").alias("score"), F.sum("named").alias("held"))

    def candidates(self, lists: DataFrame, tokens: DataFrame, query: str, k: int) -> DataFrame:
        """(query, key): rows that can be among a query's k best; a proof leaves the others out.

        The rarest terms give k rows with partial scores, so the k-th of them is a lower bound of the
        k-th best. A row that holds only terms which together weigh less than that bound can't reach it, so
        the lists of a query's commonest terms are not read, as many as the bound allows. Rows that the
        other lists hold stay if those terms, and the phrase where it can stand, would lift them to the bound.
        """
        rare = Window.partitionBy(query).orderBy("rows", "term")
        seeds = lists.withColumn("read", F.sum("rows").over(rare)).withColumn("r", F.row_number().over(rare)).where((F.col("read") <= SEED) | (F.col("r") == 1))
        kth = Window.partitionBy(query).orderBy(F.desc("score"))
        best = self._held(seeds, tokens, query).withColumn("r", F.row_number().over(kth)).where(F.col("r") <= k)
        bound = best.groupBy(query).agg(F.max("r").alias("r"), F.min("score").alias("bound")).where(F.col("r") == k).select(query, "bound")
        common = Window.partitionBy(query).orderBy(F.desc("rows"), "term").rowsBetween(Window.unboundedPreceding, 0)
        # the phrase's bonus counts once all its words are among the terms passed over
        whole = F.col("phrase").isNotNull() & (F.sum("named").over(common) >= F.col("n"))
        reach = F.sum("weight").over(common) + F.when(whole, F.col("bonus")).otherwise(0.0)
        ranked = settle(lists.withColumn("reach", reach).join(bound, query, "left").withColumn("over", F.coalesce(F.col("reach") < F.col("bound"), F.lit(False))), "search-bounds")
        passed = lambda c: F.sum(F.when(F.col("over"), F.col(c)).otherwise(0))
        each = ranked.groupBy(query).agg(F.first("bound").alias("bound"), F.first("n").alias("n"), F.first("phrase").alias("phrase"), F.first("bonus").alias("bonus"), passed("weight").alias("left"), passed("named").alias("left_named"))
        can = F.col("phrase").isNotNull() & (F.col("held") + F.col("left_named") >= F.col("n"))
        most = F.col("score") + F.col("left") + F.when(can, F.col("bonus")).otherwise(0.0)
        # these lists give a better bound than the seeds did
        held = settle(self._held(ranked.where(~F.col("over")), tokens, query), "search-held")
        better = held.withColumn("r", F.row_number().over(kth)).where(F.col("r") <= k).groupBy(query).agg(F.max("r").alias("r"), F.min("score").alias("better")).where(F.col("r") == k).select(query, "better")
        met_all = held.join(small(each), query).join(small(better), query, "left")
        least = F.greatest("bound", "better")  # of those that are known
        return met_all.where(least.isNull() | (most >= least)).select(query, self.key)

    def search(self, queries: DataFrame, query: str, k: int, most: int | None = TERMS, of_phrase: int | None = PHRASE) -> DataFrame:
        """(query, rank, key, score): each query's k best rows; ties to the smaller key, fewer rows if fewer hold a term.

        Score: max(1, length / 4) for each variant with which a word of the row begins, and 2 for each word of
        the query's phrase where it stands. Queries without words have no rows; query ids are unique. The first `most`
        words of a query are looked up, its first `of_phrase` words are the phrase; None: all.
        """
        tokens, lists = self.expand(settle(self.terms(queries, query, most, of_phrase), "search-terms"), query)
        pairs = self.candidates(lists, tokens, query, k)
        asked = lists.groupBy(query).agg(F.collect_set(F.struct("term", "weight")).alias("t"), F.first("phrase").alias("phrase"), F.first("bonus").alias("bonus"), F.first("anywhere").alias("anywhere"))
        both = self._read("rows").join(pairs, self.key).join(small(asked), query)
        sought = lambda x: F.when(F.col("anywhere"), x["term"]).otherwise(F.concat(F.lit(" "), x["term"]))
        weight = F.aggregate("t", F.lit(0.0), lambda a, x: a + F.when(F.contains("words", sought(x)), x["weight"]).otherwise(0.0))
        bonus = F.when(F.contains("words", F.col("phrase")), F.col("bonus")).otherwise(0.0)
        w = Window.partitionBy(query).orderBy(F.desc("score"), self.key)
        return both.select(query, self.key, (weight + bonus).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, "rank", self.key, "score")


def with_vector_hits(lexical: DataFrame, queries: DataFrame, vectors: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best of lexical hits (query, rank, key, score; k or all) and of vectors (key, v) near a query's (query, q), with VECTOR * cosine where that is positive.

    A lexical hit scores 1 at least, a vector hit less, so queries with k lexical hits
    need no vectors: only the others meet them. Rows that were found lexically count once.
    """
    found = lexical.groupBy(query).agg(F.count("*").alias("n"))
    short = queries.join(found, query, "left").where(F.coalesce("n", F.lit(0)) < k).select(F.concat(F.lit("q"), F.col(query).cast("string")).alias("query_id"), query, "q", F.coalesce("n", F.lit(0)).alias("n"), G.norm(F.col("q")).alias("qn"))
    held = vectors.select(F.col(key).cast("string").alias("vec_id"), key, "v", G.norm(F.col("v")).alias("vn"))
    norms = F.col("qn") * F.col("vn")
    cosine = F.when(norms > 0, G.dot(F.col("q"), F.col("v")) / norms).otherwise(F.lit(0.0))
    near = met(short, held).select(query, key, "n", F.round(VECTOR * cosine, 6).alias("score")).where("score > 0")
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + F.col("n")).select(query, key, "score")  # k are left when those found lexically are taken out
    fresh = near.join(lexical.select(query, key), [query, key], "left_anti")
    both = lexical.select(query, key, "score").unionByName(fresh)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, "rank", key, "score")
