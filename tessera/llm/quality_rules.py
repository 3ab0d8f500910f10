"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (TRAINING_ROWS, lowest
hash of doc_id, none of the held-out fold) and flattened into node arrays, which
score whole batches with a few numpy steps. Features whose growth means worse
text (symbols, repetition, repeated lines, capitals) are held to a falling effect.

Defined results: a null text counts as empty (no words, all counts 0, base rule
fails). Repeated rows are judged alike; of rows that repeat a labelled doc_id the one
whose text hashes lowest is fitted on, so fits agree from run to run. An empty table
gives no rows; other columns aren't touched, whatever their names. Without usable
labels every document that passes the base rule is kept. A document that ties with
KEEP_FROM is kept. Very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import FlatTrees, fit
from .common import load, masked, training_ids, unmasked

#: Most labelled rows that the trees are fitted on.
TRAINING_ROWS = 8000
#: A document stays if the trees give it at least this probability of being good.
KEEP_FROM = 0.5
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ["log_words", "word_length", "symbols_per_word", "pipes_per_word", "repeat_share", "dup_line_share", "distinct_share", "capital_share", "digit_share", "exclaim_per_word", "stops_per_word", "commas_per_word", "words_per_line", "short_share"]
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, -1, 0, -1, 0, 0, 0, 0])


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if n < 2_000_000:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # ids need more than 21 bits: number the pairs first
        pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
        key = np.unique(pair[:-1].astype("i8") * (int(ids.max()) + 1) + ids[2:], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five counts of the base rule, and the features of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: cuts at ASCII white space alone
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    of = lambda s: int(hist[list(s.encode())].sum())
    symbols, capitals, digits = of(SYMBOLS), int(hist[65:91].sum()), int(hist[48:58].sum())
    w = max(n, 1)
    features = [
        float(np.log1p(n)), chars / w, symbols / w, of("|") / w, repeats / w, dup_lines / max(len(lines), 1), len(number) / w, capitals / max(chars, 1),
        digits / max(chars, 1), of("!") / w, of(".?") / w, of(",;:") / w, n / max(len(lines), 1), sum(map((4).__gt__, map(len, words))) / w,
    ]
    return (n, chars, symbols, dup_lines, repeats), features


def base_failed(n_words: int, n_repeat_words: int, least: int = LEAST_WORDS) -> bool:
    return n_words < least or 100 * n_repeat_words > 50 * n_words


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `bound` labelled documents; a text seen twice counts once per row."""
    ids = training_ids(labels, "quality", bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("quality").alias("label"), F.col("doc_id"), F.xxhash64("text").alias("h"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [statistics(t)[1] for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(f, pa.list_(pa.float64()))], ["label", "doc_id", "h", "f"])

    # repeated rows of a doc_id keep to the bound
    got = rows.mapInArrow(run, "label int, doc_id long, h long, f array<double>").groupBy("doc_id").agg(F.min(F.struct("h", "label", "f")).alias("r")).select("doc_id", "r.label", "r.f").orderBy("doc_id").toPandas()
    return np.array(got["f"].tolist(), "f8").reshape(-1, len(FEATURES)), got["label"].to_numpy("f8")


def fit_rules(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> FlatTrees:
    x, y = training_rows(docs, labels, bound)
    return fit(x, y, MONOTONE)


def judge(docs: DataFrame, trees: FlatTrees, keep: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """Columns of `keep` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (with `least` words), score, kept. Columns of `keep` may have these names too."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    source = docs.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)), F.col("text").alias("__text"))
    mine = [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*(T.StructField(f"k{n}", f.dataType) for n, f in enumerate(docs.select(*keep).schema.fields)), *mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = [statistics(t.as_py()) for t in b.column(b.num_columns - 1)]
            failed = np.array([base_failed(c[0], c[4], least) for c, _ in got], bool)
            score = trees.probability(np.array([f for _, f in got], "f8")) if len(trees.roots) else np.ones(len(got))
            cols = [*b.columns[:-1], *(pa.array([c[i] for c, _ in got], pa.int64()) for i in range(5))]
            cols += [pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= KEEP_FROM))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *(f.name for f in mine))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, load(spark, sf_dir, "labels")), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, least: int = 1) -> DataFrame:
    """The rows of docs that pass, with their own columns.

    A document goes if the trees reject it, if over half of its words are repeated, or
    if it has fewer than `least` words: one here, since short documents can be clean
    (the trees know the number of words).
    """
    hidden, names = masked(docs, ("doc_id", "text"))
    return unmasked(judge(hidden, fit_rules(docs, labels), hidden.columns, least).where("kept"), names)
