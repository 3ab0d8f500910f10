"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations alone.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
SHARE times all words; a source's target stops at MOST times its size, and what is
over is shared anew by weight until none is above.

Quotas: a source's documents are dealt by hash to shards of about SHARD_WORDS words or
SHARD_ROWS rows, whichever are more, and the house of (all target words / BLOCK_WORDS) blocks goes to the shards by
highest quotients target/(2k+1). The quotients aren't sorted: the divisor at which
the house is full is searched for with sums over the (small) table of shards, and
blocks that tie at it go out in order.

Selection: a shard's documents stand in seeded order, cut into blocks of BLOCK_WORDS
words. Of a quota of q blocks out of m, q div m go to whole passes and q mod m to a
run of blocks that starts at a seeded place and wraps round, so most documents are
taken whole. No block is taken more than MOST times.

Scale: texts are read once for their sizes; only (doc_id, source, size) is shuffled,
by (source, shard), so a hot source spreads over as many tasks as it has shards, its
texts empty or not. Sources and tied shards are numbered by ranges of their order and
sums over these ranges, never sorted in one task.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own; a row without a doc_id is placed by its text, after all others of
its shard that agree in their seeds; rows of one doc_id and size are in the order of
their texts' hashes; repeated rows count and are taken one by one; tied quotients go out in the order of sources and shards; an empty table or one without words
has targets and takings of 0. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, load, masked, partitions, unmasked, word_count

#: Weights in turn, share of all words that the mix takes, most times that a word is taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of a block, and about how many words and rows a shard has.
BLOCK_WORDS = 16
SHARD_WORDS = 2_000_000
SHARD_ROWS = 1024
SEED = "mix-1"


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def numbered(rows: DataFrame, order: list[Column], name: str, table: str) -> DataFrame:
    """Add `name`: numbers from 0 in an order without ties. Rows are dealt by ranges of the order; each range is numbered on its own, from the sizes of those before it."""
    parts = partitions(rows.sparkSession)
    ranged = durable(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), table)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # `parts` rows at most
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__range").orderBy(*order)
    placed = ranged.withColumn("__in_range", F.row_number().over(inner) - 1).join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return placed.withColumn(name, (F.col("__before") + F.col("__in_range")).cast("long")).drop("__range", "__in_range", "__r", "__before")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """Number the sources (source, source_size, source_rows) from 0 in code-point order, null last."""
    return numbered(totals, [F.col("source").asc_nulls_last()], "rank", "mix-ranges")


def with_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add weight and target to (source, source_size). The driver sees two sums per round, not the sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    t = durable(ranked_sources(totals).withColumn("weight", weight), "mix-sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    whole = share * total
    per_weight = -1.0  # words per unit of weight
    while True:
        full = F.lit(False) if per_weight < 0 else F.col("weight") * per_weight >= most * F.col("source_size")
        taken, open_weight = t.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        now = (whole - taken) / open_weight if open_weight else per_weight
        if now <= per_weight:
            break
        per_weight = now
    target = F.least(F.col("weight") * max(per_weight, 0.0), (most * F.col("source_size")).cast("double"))
    return t.withColumn("target", target)


def seats(divisor: Column | float) -> Column:
    """Blocks of a shard at a divisor: its quotients target/(2k+1) of at least half the divisor."""
    return F.floor(F.col("target") / divisor + 0.5)


def apportion(cells: DataFrame, house: int, order: list[str], rounds: int = 24, close: int = 10_000) -> DataFrame:
    """Give `house` blocks to cells (`target`) by highest quotients; ties go in the order of `order`. Adds quota.

    The divisor is searched for until it leaves `close` quotients open, or until those
    left are ties; these are put in order.
    """
    sums = cells.agg(F.sum("target"), F.max("target"), F.count("*")).first()
    if house <= 0 or not sums[0]:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    # between a divisor that gives too few and one that gives enough; each round cuts the gap 33-fold
    few, enough = 2.0 * sums[1] + 1.0, sums[0] / (house + sums[2] + 1.0)
    at_few, at_enough = 0, None
    for _ in range(rounds):
        marks = sorted({m for m in (enough * (few / enough) ** (k / 33) for k in range(1, 33)) if enough < m < few})
        if not marks:
            break
        got = cells.agg(*(F.sum(seats(F.lit(m))).alias(f"s{k}") for k, m in enumerate(marks))).first()
        for m, n in zip(marks, got, strict=True):
            if n >= house:
                enough, at_enough = (m, int(n)) if m > enough else (enough, at_enough)
            elif m < few:
                few, at_few = m, int(n)
        if few / enough < 1 + 1e-13 or at_enough is not None and at_enough - at_few <= close:
            break
    low, high = seats(F.lit(few)), seats(F.lit(enough))
    open_ = cells.where(high > low).withColumn("__k", F.explode(F.sequence(low, high - 1))).select(*order, "__k", (F.col("target") / (2 * F.col("__k") + 1)).alias("__q"))
    won = numbered(open_, [F.col("__q").desc(), *(F.col(c).asc_nulls_last() for c in order), F.col("__k")], "__won", "mix-open").where(F.col("__won") < house - at_few)
    more = won.groupBy(*(F.col(c).alias(f"__{c}") for c in order)).agg(F.count("*").alias("__more"))
    cond = F.lit(True)
    for c in order:
        cond &= same(F.col(c), F.col(f"__{c}"))
    return cells.join(more, cond, "left").withColumn("quota", (low + F.coalesce("__more", F.lit(0))).cast("long")).drop(*(f"__{c}" for c in order), "__more")


def seeded(*of: Column) -> Column:
    """A number below 2**60 from the seed and the given values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *of)), 1, 15), 16, 10).cast("long")


def overlap(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, hi) - F.greatest(a, lo))


def place_of() -> Column:
    """What a row is dealt by: its doc_id, or its text where that is null."""
    return F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")))))


def mix(sizes: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Mix rows (doc_id, source, size, place, and any more columns), which should be durable: they are read more than once. A column __row, a hash of the text, breaks ties.

    Adds source_size, target, passes, run_from, run_words and taken: the row's words
    are taken `passes` times whole, and run_words of them from its word run_from on
    (wrapping round at its end) once more.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    targets = durable(with_targets(totals), "mix-targets")
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows))
    t = targets.select(F.col("source").alias("__s"), "source_size", "target", shards.alias("__shards"))
    # the few sources meet the many rows: Spark broadcasts them if they are small, and splits a hot source otherwise
    rows = sizes.join(t, same(F.col("source"), F.col("__s"))).drop("__s")
    rows = rows.withColumn("__seed", seeded(F.col("place"))).withColumn("__shard", F.col("__seed") % F.col("__shards"))
    cells = rows.groupBy("source", "__shard").agg(F.sum("size").alias("__words"), F.first("target").alias("__target"), F.first("source_size").alias("__size"))
    cells = cells.withColumn("target", F.when(F.col("__size") > 0, F.col("__target") * F.col("__words") / F.col("__size")).otherwise(F.lit(0.0)))
    cells = durable(cells.select("source", "__shard", "__words", "target"), "mix-cells")
    house = int(round((cells.agg(F.sum("target")).first()[0] or 0.0) / block))
    quotas = durable(apportion(cells, house, ["source", "__shard"]), "mix-quotas")
    blocks = F.ceil(F.col("__words") / block)
    quota = F.least(F.col("quota"), MOST * blocks)
    m = F.greatest(blocks, F.lit(1))
    plan = quotas.select(
        F.col("source").alias("__s"), F.col("__shard").alias("__k"), F.col("__words").alias("__w"),
        F.floor(quota / m).alias("passes"),
        (seeded(F.coalesce("source", F.lit("null")), F.col("__shard").cast("string")) % m * block).alias("__lo"),
        (quota % m * block).alias("__len"), (m * block).alias("__ring"),
    )
    # rows of one id and size that differ in their texts stand in the order of these
    ties = [c for c in ("__row",) if c in sizes.columns]
    w = Window.partitionBy("source", "__shard").orderBy("__seed", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__b", F.sum("size").over(w)).withColumn("__a", F.col("__b") - F.col("size"))
    out = placed.join(plan, same(F.col("source"), F.col("__s")) & (F.col("__shard") == F.col("__k")))
    a, b, lo, hi = F.col("__a"), F.col("__b"), F.col("__lo"), F.col("__lo") + F.col("__len")
    main, wrapped = overlap(a, b, lo, hi), overlap(a, b, F.lit(0), hi - F.col("__ring"))
    # a document that the run leaves and enters again counts from where it enters
    run_from = F.when(main > 0, F.greatest(lo - a, F.lit(0))).otherwise(F.lit(0))
    return out.withColumns({"run_from": run_from.cast("long"), "run_words": (main + wrapped).cast("long")}).withColumn("taken", (F.col("passes") * F.col("size") + F.col("run_words")).cast("long")).drop("__s", "__k", "__w", "__lo", "__len", "__ring", "__a", "__b", "__seed", "__shard", "__shards", "place")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sizes = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_of().alias("place")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of docs: one for each whole pass over a document, and one with the words of its partial pass.

    A partial pass keeps the white space after each of its words; where it leaves the
    text's end and comes in again at its beginning, a line break stands between.
    n_chars follows the text where docs has it.
    """
    docs, names = masked(docs, ("doc_id", "text", "source", "n_chars"))
    row = F.xxhash64("text")
    sizes = durable(docs.select("doc_id", row.alias("__row"), "source", word_count(F.col("text")).alias("size"), place_of().alias("place")), "mix-sizes")
    # rows that agree in all of these are copies of one another, so any of them may have any of their takings
    w = Window.partitionBy("doc_id", "__row", "source").orderBy("passes", "run_from", "run_words")
    taken = durable(mix(sizes).where("taken > 0").select("doc_id", "__row", "source", "size", "passes", "run_from", "run_words"), "mix-taken")
    plan = taken.withColumn("__n", F.row_number().over(w)).select(F.col("doc_id").alias("__i"), F.col("__row").alias("__r"), F.col("source").alias("__s"), "size", "passes", "run_from", "run_words", "__n")
    # repeated rows become one with their number; the plan's rows then say what each gives
    numbered = docs.withColumn("__row", row).dropDuplicates(["doc_id", "__row", "source"])
    rows = numbered.join(plan, same(F.col("doc_id"), F.col("__i")) & (F.col("__row") == F.col("__r")) & same(F.col("source"), F.col("__s")))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.array_repeat(F.col("text"), (F.col("passes") + (F.col("run_words") >= F.col("size")).cast("long")).cast("int"))
    first = F.least(F.col("run_words"), F.col("size") - F.col("run_from"))
    rest = F.col("run_words") - first
    between = F.when(rest > 0, F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>"))
    picked = F.concat(F.slice(words, (F.col("run_from") + 1).cast("int"), first.cast("int")), between, F.slice(words, F.lit(1), rest.cast("int")))
    part = F.when((F.col("run_words") > 0) & (F.col("run_words") < F.col("size")), F.array(F.array_join(picked, ""))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumn("__t", F.explode(F.concat(whole, part)))
    chars = {"n_chars": F.char_length("__t").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unmasked(out.withColumns({"text": F.col("__t"), **chars}), names)


OP2_SQL = rf"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))) AS place FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s GROUP BY source
), filled AS (
  SELECT *, {MOST} * source_size / w AS ratio, row_number() OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST) AS i,
    ({SHARE} * sum(source_size) OVER ())::DOUBLE AS whole FROM totals
), open_ AS (
  SELECT *, (whole - coalesce(sum({MOST} * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight FROM filled
), level AS (
  SELECT coalesce(min(CASE WHEN per_weight <= ratio THEN i END), max(i)) AS stop_i FROM open_
), targets AS (
  SELECT source, source_size, source_rows, least(w * (SELECT per_weight FROM open_, level WHERE i = stop_i), ({MOST} * source_size)::DOUBLE) AS target FROM open_
), rows_ AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, ('0x' || substr(md5('{SEED}|' || s.place), 1, 15))::BIGINT AS seed,
    greatest(ceil(t.source_size / {SHARD_WORDS}.0), ceil(t.source_rows / {SHARD_ROWS}.0))::BIGINT AS shards FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cells AS (
  SELECT source, seed % shards AS shard, sum(size)::BIGINT AS words, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0.0 END AS target FROM rows_ GROUP BY ALL
), quotients AS (
  SELECT source, shard, target / (2 * k + 1) AS q FROM (SELECT *, unnest(range((target / {BLOCK_WORDS})::BIGINT + 3)) AS k FROM cells)
), given AS (
  SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source NULLS LAST, shard) AS n FROM quotients WHERE q > 0)
  WHERE n <= (SELECT round_even(sum(target) / {BLOCK_WORDS}, 0) FROM cells) GROUP BY ALL
), plans AS (
  SELECT c.source, c.shard, greatest(ceil(c.words / {BLOCK_WORDS}.0)::BIGINT, 1) AS m, least(coalesce(g.quota, 0), {MOST} * ceil(c.words / {BLOCK_WORDS}.0)::BIGINT) AS quota,
    ('0x' || substr(md5('{SEED}|' || coalesce(c.source, 'null') || '|' || c.shard), 1, 15))::BIGINT AS seed
  FROM cells c LEFT JOIN given g ON c.source IS NOT DISTINCT FROM g.source AND c.shard = g.shard
), placed AS (
  SELECT *, seed % shards AS shard, sum(size) OVER (PARTITION BY source, seed % shards ORDER BY seed, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM rows_
), spans AS (
  SELECT p.*, p.b - p.size AS a, quota // m AS passes, l.seed % m * {BLOCK_WORDS} AS lo, l.seed % m * {BLOCK_WORDS} + quota % m * {BLOCK_WORDS} AS hi, m * {BLOCK_WORDS} AS ring
  FROM placed p JOIN plans l ON p.source IS NOT DISTINCT FROM l.source AND p.shard = l.shard
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + greatest(0, least(b, hi) - greatest(a, lo)) + greatest(0, least(b, hi - ring) - greatest(a, 0)))::BIGINT AS taken, source FROM spans
"""
