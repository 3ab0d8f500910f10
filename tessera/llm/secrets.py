"""Secret scan in DataFrame operations alone: fixed patterns, and a battery of randomness tests.

Patterns: assignments of 6+ characters to a telling name, access keys of 20+ and
lowercase hexadecimal runs of 24+ characters.

Battery: every other run of 20+ characters of the usual encodings is a candidate.
Its encoding is inferred (hexadecimal, base 32, letters of one case, alphanumeric,
base 64), and three statistics over that alphabet are taken: chi-squared against
uniformity, runs of character classes, and serial correlation of the symbols'
places. They give (a) p-values under randomness, which a secret must not fail, and
(b) one p-value under the hypothesis of ordinary text (chi-squared shifted by the
text's index of coincidence, class changes as rare as in words; Fisher's method). As
the shift grows with length, short runs of plain words cannot look random for long.

False discoveries: candidates are strata by length. In each the Benjamini-Hochberg
threshold at RATE is read off a histogram of p-values over the whole corpus, whose
size is fixed (strata x BINS); so nothing is ranked or collected.

Texts are scanned once, without a shuffle. Positions are running sums of the lengths
of matches and of what lies between them, in blocks, so that texts with very many
matches take time in proportion.

Defined results: a null or empty text has no spans. Offsets count code points, ends
are exclusive. Spans that begin alike stand in the order of KINDS. Candidates that tie
with a stratum's threshold are discoveries. An empty table gives no rows and no
thresholds. Repeated rows are scanned alike; other columns are not touched, and their
names don't matter unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, load

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "random"]
#: What the battery tests.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", 16),
    "lower": ("^[a-z]+$", 26),
    "upper": ("^[A-Z]+$", 26),
    "base32": ("^[A-Z2-7]+$", 32),
    "alnum": ("^[A-Za-z0-9]+$", 62),
    "base64": ("", 64),
}
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASS_OF = "u" * 26 + "l" * 26 + "d" * 10 + "s" * 4
#: Probability that two letters of ordinary text are the same; class changes per character there.
COINCIDENCE, CHANGES = 0.065, 0.04
#: Share of false discoveries, least p-value under randomness, lower ends of the length strata, histogram of -log10 p.
RATE, FAILS = 0.01, 0.001
STRATA = [20, 24, 32, 48, 96]
BINS, BIN = 400, 0.05
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def spans_of(pieces: Column, matches: Column) -> Column:
    """array<struct<s, e>>: places of matches, from the pieces between them."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    sizes = F.transform(matches, lambda m, i: F.struct(long(F.char_length(F.get(pieces, i))).alias("gap"), long(F.char_length(m)).alias("len")))

    def placed(x: Column) -> Column:
        part = lambda k: F.slice(x, k * BLOCK + 1, BLOCK)
        blocks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        total = lambda k: F.aggregate(part(k), long(0), lambda t, y: t + y["gap"] + y["len"])
        begins = F.aggregate(
            blocks,
            F.struct(long(0).alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda a, k: F.struct((a["at"] + total(k)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
            lambda a: a["out"],
        )

        def local(k: Column, begin: Column) -> Column:
            step = lambda a, y: F.struct((a["at"] + y["gap"] + y["len"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + y["gap"]).alias("s"), (a["at"] + y["gap"] + y["len"]).alias("e"))).alias("out"))
            return F.aggregate(part(k), F.struct(begin.alias("at"), empty.alias("out")), step, lambda a: a["out"])

        return let(begins, lambda b: F.flatten(F.transform(blocks, lambda k: local(k, F.get(b, k)))))

    return F.when(F.size(matches) == 0, empty).otherwise(let(sizes, placed))


def found(text: Column, pattern: str) -> Column:
    """Places of a pattern's matches."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return F.when(text.rlike(pattern), spans_of(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(empty)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the normal distribution (rational approximation, absolute error below 1e-7; floored at 1e-15)."""

    def half(x: Column) -> Column:  # for x >= 0
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly

    return let(z, lambda x: F.greatest(F.lit(1e-15), F.when(x >= 0, half(x)).otherwise(1 - half(-x))))


def tested(token: Column) -> Column:
    """struct<n, p, fits>: length, p-value under ordinary text, and whether no test speaks against randomness."""
    body = F.regexp_replace(token, "=+$", "")

    def size(x: Column) -> Column:
        out = F.lit(ALPHABETS["base64"][1])
        for pattern, k in reversed([v for v in ALPHABETS.values() if v[0]]):
            out = F.when(x.rlike(pattern), F.lit(k)).otherwise(out)
        return out.cast("double")

    def squares(x: Column) -> Column:
        return F.aggregate(F.array(*map(F.lit, SYMBOLS)), F.lit(0.0), lambda a, c: a + F.pow(F.length(x) - F.length(F.replace(x, c, F.lit(""))), F.lit(2.0)))

    def serial(x: Column) -> Column:
        """Lag-1 correlation of the symbols' places, circular."""
        place = lambda c: F.instr(F.lit(SYMBOLS), c).cast("double")
        zero = F.struct(place(F.right(x, F.lit(1))).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sp"))
        step = lambda a, c: let(place(c), lambda v: F.struct(v.alias("last"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["sp"] + v * a["last"]).alias("sp")))
        n = F.length(x)
        return F.aggregate(F.split(x, ""), zero, step, lambda a: (n * a["sp"] - a["s"] * a["s"]) / F.greatest(n * a["ss"] - a["s"] * a["s"], F.lit(1e-9)))

    def stats(x: Column) -> Column:
        classes = F.translate(x, SYMBOLS, CLASS_OF)
        counts = [(F.length(classes) - F.length(F.replace(classes, F.lit(c), F.lit("")))).cast("double") for c in "ulds"]
        return F.struct(
            F.length(x).cast("double").alias("n"), size(x).alias("k"), squares(x).alias("sq"), serial(x).alias("r"),
            F.regexp_count(classes, F.lit("u+|l+|d+|s+")).cast("double").alias("runs"), (counts[0] ** 2 + counts[1] ** 2 + counts[2] ** 2 + counts[3] ** 2).alias("csq"),
            (counts[0] ** 3 + counts[1] ** 3 + counts[2] ** 3 + counts[3] ** 3).alias("ccb"),
        )

    def verdict(v: Column) -> Column:
        n, k = v["n"], v["k"]
        chi = k * v["sq"] / n - n
        shift = n * (k * COINCIDENCE - 1)
        plain = upper_tail(-(chi - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift)))
        rate = CHANGES * n
        changes = upper_tail((v["runs"] - 1 - rate - 0.5) / F.sqrt(rate))
        fisher = let(F.log(plain) + F.log(changes), lambda x: F.exp(x) * (1 - x))
        uniform = upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
        # runs of several classes given how many of each there are (Wald and Wolfowitz, extended)
        mean = (n * (n + 1) - v["csq"]) / n
        spread = (v["csq"] * (v["csq"] + n * (n + 1)) - 2 * n * v["ccb"] - n**3) / (n * n * (n - 1))
        runs = F.when(spread <= 1e-9, F.lit(1.0)).otherwise(2 * upper_tail(F.abs(v["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))
        corr = 2 * upper_tail(F.abs(v["r"] + 1 / (n - 1)) * F.sqrt(n))
        return F.struct(long(n).alias("n"), F.greatest(fisher, F.lit(1e-30)).alias("p"), ((uniform >= FAILS) & (runs >= FAILS) & (corr >= FAILS)).alias("fits"))

    return let(body, lambda x: let(stats(x), verdict))


def stratum(n: Column) -> Column:
    out = F.lit(0)
    for i, lo in enumerate(STRATA):
        out = F.when(n >= lo, F.lit(i)).otherwise(out)
    return out


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of `keep`, base spans by kind and tested candidates; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cand_type = "array<struct<s:bigint,e:bigint,n:bigint,p:double,fits:boolean>>"
    span_type = "array<struct<s:bigint,e:bigint>>"

    def candidates(piece: Column, begin: Column) -> Column:
        tokens = F.regexp_extract_all(piece, F.lit(CANDIDATE), F.lit(0))
        place = lambda t: let(spans_of(F.split(piece, CANDIDATE, -1), t), lambda at: F.transform(t, lambda x, i: let(tested(x), lambda v: F.struct((F.get(at, i)["s"] + begin).alias("s"), (F.get(at, i)["e"] + begin).alias("e"), v["n"].alias("n"), v["p"].alias("p"), v["fits"].alias("fits")))))
        # what base patterns hold is found already
        return F.when(piece.rlike(CANDIDATE), F.filter(let(tokens, place), lambda c: ~F.substring(piece, (c["s"] - begin + 1).cast("int"), (c["e"] - c["s"]).cast("int")).rlike(f"{HEX}|{ACCESS}"))).otherwise(F.array().cast(cand_type))

    has = text.rlike(ASSIGN)
    read = docs.select(*keep, text.alias("__t"))
    text = F.col("__t")
    has = text.rlike(ASSIGN)
    out = read.select(
        *keep,
        F.when(has, F.struct(F.split(text, ASSIGN, -1).alias("pieces"), found(text, ASSIGN).alias("all"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("values"))).alias("__a"),
        found(text, ACCESS).cast(span_type).alias("access"),
        found(text, HEX).cast(span_type).alias("hex"),
        "__t",
    )
    cut = F.when(F.col("__a").isNull(), candidates(F.col("__t"), long(0))).otherwise(
        let(F.col("__a"), lambda a: F.flatten(F.transform(a["pieces"], lambda g, i: candidates(g, F.when(i == 0, long(0)).otherwise(F.get(a["all"], i - 1)["e"])))))
    )
    assign = let(F.col("__a"), lambda a: F.filter(a["all"], lambda x, i: F.char_length(F.get(a["values"], i)) >= ASSIGN_LEAST))
    return out.select(*keep, F.coalesce(assign, F.array().cast(span_type)).alias("assign"), "access", "hex", cut.cast(cand_type).alias("cand"))


def thresholds(scanned: DataFrame) -> list[float]:
    """Per length stratum the largest p-value that counts as a discovery (below 0: none does)."""
    each = scanned.select(F.explode("cand").alias("c")).select(stratum(F.col("c.n")).alias("k"), F.least(F.lit(BINS), F.floor(-F.log10("c.p") / BIN)).cast("int").alias("bin"))
    counts = each.groupBy("k", "bin").agg(F.count("*").alias("n"))  # strata x BINS rows at most
    w = Window.partitionBy("k")
    # candidates in bins from b on have p <= 10 ** (-b * BIN)
    counts = counts.withColumn("at", F.pow(F.lit(10.0), -F.col("bin") * BIN)).withColumn("tests", F.sum("n").over(w)).withColumn("hits", F.sum("n").over(w.orderBy(F.col("bin").desc())))
    best = counts.where(F.col("tests") * F.col("at") <= RATE * F.col("hits")).groupBy("k").agg(F.max("at").alias("at")).collect()
    out = [-1.0] * len(STRATA)
    for r in best:
        out[r["k"]] = r["at"]
    return out


def op_columns(scanned: DataFrame, limits: list[float], keep: list[str]) -> DataFrame:
    limit = F.array(*map(F.lit, limits))
    random = F.filter("cand", lambda c: c["fits"] & (c["p"] <= F.get(limit, stratum(c["n"]))))
    of = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    base = F.concat(*(of(F.col(kind), kind) for kind in KINDS[:3]))
    named = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["k"]), x["s"], x["e"])), ",")
    return scanned.select(
        *keep,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.size(random).cast("long").alias("n_random"),
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.concat(base, of(random, "random"))).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = durable(scan(load(spark, sf_dir, "documents"), ["doc_id"]), "secret-spans")
    return op_columns(scanned, thresholds(scanned), ["doc_id"])
