"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are its own statistics and those of
its neighbours; transitions tie neighbouring lines together. Forward-backward
gives each line's marginal of being good, and the document's quality is their
mean weighted by line length. Weights are fitted on a bounded sample of labelled
documents, none of the held-out fold, each of whose lines carries the document's
label: TRAINING_ROWS rows at most, with TRAINING_LINES lines at most together. No row is
passed over for its length: where all have more lines than that, the longest give their
first ones, as many as leave all of theirs to the shorter ones (`lines_each`).

Defined results: a null or empty text is one empty line and gets its score; very long
texts are scored whole, in stretches of lines. Texts with equal lines tie in their scores.
Repeated rows score alike; of rows that repeat a labelled doc_id the one whose text
hashes lowest is fitted on, so fits agree from run to run. Other columns are not
touched, whatever their names. An empty table gives no rows. Without usable labels
every line scores 0.5. No label, language, source or id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import steps
from .common import fold_held_out, load, training_ids

#: Most labelled rows fitted on, and most lines of these together.
TRAINING_ROWS = 3000
TRAINING_LINES = 400_000
#: A document is predicted good from this score on.
GOOD_FROM = 0.3
#: Classes of bytes that lines are described by.
OTHER, UPPER, DIGIT, SYMBOL, PIPE, EXCLAIM, SPACE, STOP, COMMA, INNER = range(10)
STEP_CHARS = 1_500_000
#: Lines of a text that are worked through one after another.
CHAIN = 64
OWN, NEAR, LENGTH = 11, 6, 5  # features of a line itself; of them, those that its neighbours contribute


def byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for kind, chars in ((UPPER, bytes(range(65, 91))), (DIGIT, b"0123456789"), (SYMBOL, b"#*$%&<>@^~{}[]\\_="), (PIPE, b"|"), (EXCLAIM, b"!"), (SPACE, b" \t\r\x0b\x0c"), (STOP, b".?"), (COMMA, b",;:"), (INNER, bytes(range(0x80, 0xC0)) + b"\n")):
        table[list(chars)] = kind
    return table


CLASSES = byte_classes()
#: An odd number; its powers number byte positions in word hashes (64-bit arithmetic that wraps).
STEP = 0x9E3779B97F4A7C15


def repeats_of_previous(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per line: words equal to the word before them (of 64-bit hashes)."""
    gap = (CLASSES[data] == SPACE) | (data == 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype("i1")))
    begin, end = edge[::2], edge[1::2]
    power = np.ones(len(data), np.uint64)
    power[1:] = STEP
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    # two words are equal if their sums are, each scaled by the other's position
    span = total[end] - total[begin]
    size, at = end - begin, power[begin]
    line = np.searchsorted(ends, begin)
    same = (span[1:] * at[:-1] == span[:-1] * at[1:]) & (size[1:] == size[:-1]) & (line[1:] == line[:-1])
    return np.bincount(line[1:][same], minlength=len(ends)).astype("f8")


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x F), line lengths in characters, and each text's first line (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n_lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(n_lines)])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    sizes = np.diff(np.concatenate([[-1], ends]))
    kind = np.repeat(np.arange(len(ends), dtype=np.int64) * 10, sizes) + CLASSES[data]
    c = np.bincount(kind, minlength=10 * len(ends)).reshape(-1, 10).astype("f8")
    length = c[:, :INNER].sum(axis=1)
    w = np.maximum(length, 1)
    words = c[:, SPACE] + 1
    own = np.stack(
        [repeats_of_previous(data, ends) / words, c[:, UPPER] / w, c[:, SYMBOL] / words, c[:, PIPE] / words, c[:, EXCLAIM] / words, np.log1p(length), c[:, DIGIT] / w, np.minimum(w / words, 40) / 10, c[:, STOP] / words, c[:, COMMA] / words, (length == 0).astype("f8")], axis=1
    )
    before, after = np.zeros((len(own), NEAR + 1)), np.zeros((len(own), NEAR + 1))
    before[1:, :NEAR], after[:-1, :NEAR] = own[:-1, :NEAR], own[1:, :NEAR]
    before[first[:-1], :NEAR], after[first[1:] - 1, :NEAR] = 0, 0
    before[first[:-1], NEAR], after[first[1:] - 1, NEAR] = 1, 1  # a text's first and last line
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), length, first


def together(a: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Messages (log) one line on."""
    return np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])


def chain(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward messages of every line, its own score included.

    Texts are cut into runs of CHAIN lines, which take their steps side by side: once
    from each state to learn what a run makes of it, then, the runs of a text having
    been put together, from what really comes in. So a text of n lines takes about
    n / CHAIN + 3 * CHAIN steps, however many texts there are.
    """
    n = np.diff(first)
    runs = -(-n // CHAIN)
    text = np.repeat(np.arange(len(n)), runs)
    number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[:-1][text] + number * CHAIN
    size = np.minimum(CHAIN, n[text] - number * CHAIN)
    out = np.zeros_like(score)

    def walk(which: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Fill the runs from their incoming messages; gives the last ones."""
        order = np.argsort(-size[which], kind="stable")
        at = begin[which][order]
        active = np.searchsorted(-size[which][order], -np.arange(size[which].max(initial=0)), side="left")
        out[at] = start[order] + score[at]
        for t in range(1, len(active)):
            here = at[: active[t]] + t
            out[here] = together(out[here - 1], trans) + score[here]
        return out[begin[which] + size[which] - 1]

    start = np.zeros((len(text), 2))
    later = np.flatnonzero(number > 0)
    if len(later):
        row = np.zeros(len(text), np.int64)
        row[later] = np.arange(len(later))
        ends = [walk(later, np.tile(trans[s], (len(later), 1))) for s in (0, 1)]
        end = np.zeros((len(text), 2))
        heads = np.flatnonzero((number == 0) & (runs[text] > 1))
        end[heads] = walk(heads, np.zeros((len(heads), 2)))
        for k in range(1, int(runs.max())):
            at = np.flatnonzero(number == k)
            before = end[at - 1]
            start[at] = together(before, trans)
            end[at] = np.logaddexp(before[:, :1] + ends[0][row[at]], before[:, 1:] + ends[1][row[at]])
    walk(np.arange(len(text)), start)
    return out


def marginals(emission: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and for each line but a text's first one those of its pairs of states (zeros for first lines).

    emission: the good state's score over the bad one's.
    """
    score = np.stack([np.zeros_like(emission), emission], axis=1)
    fore = chain(score, trans, first)
    back = chain(score[::-1], trans.T, (len(score) - first)[::-1])[::-1]  # own score included
    both = fore + back - score
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((len(emission), 2, 2))
    inner = np.ones(len(emission), bool)
    inner[first[:-1]] = False
    k = np.flatnonzero(inner)
    pairs[k] = np.exp(fore[k - 1][:, :, None] + trans[None] + back[k][:, None, :] - total[k][:, None, None])
    return np.exp(both[:, 1] - total), pairs


@dataclass
class LineCRF:
    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0  # from the log-odds of a text's mean marginal to those of its label
    shift: float = 0.0

    def mean_marginal(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marginals of being good, weighted by line length."""
        good, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.trans, first)
        weight = length + 1
        return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 1e-9, 1 - 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self.mean_marginal(*line_features(texts))
        return 1 / (1 + np.exp(-(self.slope * np.log(m / (1 - m)) + self.shift)))


def fit_crf(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> LineCRF:
    """Maximise the mean log-likelihood per text (Adam, fixed number of rounds)."""
    width = x.shape[1]
    if not len(label):
        return LineCRF(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    n = np.diff(first)
    y = np.repeat(label, n)
    per_line = np.repeat(1 / n, n) / len(n)  # a text counts once, however long
    inner = np.ones(len(z), bool)
    inner[first[:-1]] = False
    seen = np.zeros((len(z), 2, 2))
    seen[np.arange(len(z)), y.astype(int), y.astype(int)] = 1
    seen[~inner] = 0
    theta = np.zeros(width + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        trans = theta[width:].reshape(2, 2)
        good, pairs = marginals(z @ theta[:width], trans, first)
        grad = np.concatenate([z.T @ ((y - good) * per_line), ((seen - pairs) * per_line[:, None, None]).sum(axis=0).ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    model = LineCRF(theta[:width], theta[width:].reshape(2, 2), mean, scale)
    m = model.mean_marginal(x, np.expm1(x[:, LENGTH]), first)
    odds = np.stack([np.log(m / (1 - m)), np.ones(len(m))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(30):  # Newton's method for the logistic fit of slope and shift, held near 1 and 0
        p = 1 / (1 + np.exp(-odds @ b))
        b = b + np.linalg.solve((odds * (p * (1 - p))[:, None]).T @ odds + np.eye(2), odds.T @ (label - p) - (b - [1.0, 0.0]))
    model.slope, model.shift = float(b[0]), float(b[1])
    return model


def lines_each(sizes: list[int], lines: int) -> int:
    """The most lines that every document may give so that all together give `lines` at most: short documents give all of theirs."""
    left, rest = lines, sorted(sizes)
    for k, n in enumerate(rest):
        share = left // (len(rest) - k)
        if n > share:
            return share
        left -= n
    return rest[-1] if rest else 0


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS, lines: int = TRAINING_LINES) -> LineCRF:
    ids = training_ids(labels, "quality", bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.col("quality").alias("label"), F.xxhash64("text").alias("h"), F.col("text").alias("__text"))
    n_lines = F.coalesce(F.size(F.split("__text", "\n", -1)), F.lit(1))
    # lines of `bound` rows at most
    most = lines_each([r["n"] for r in rows.groupBy("doc_id").agg(F.min(F.struct("h", n_lines.alias("n"))).alias("s")).select("s.n").collect()], lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            for a, z in steps(texts, STEP_CHARS):
                x, _, first = line_features(texts[a:z])
                features = [x[first[k] : min(first[k + 1], first[k] + most)].astype("<f4").tobytes() for k in range(z - a)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a) for i in range(3)), pa.array(features, pa.binary())], ["doc_id", "label", "h", "x"])

    got = rows.mapInArrow(run, "doc_id long, label int, h long, x binary").groupBy("doc_id").agg(F.min(F.struct("h", "label", "x")).alias("r")).select("doc_id", "r.label", "r.x").orderBy("doc_id").collect()
    width = OWN + 2 * (NEAR + 1) + 1
    x = [np.frombuffer(r.x, "<f4").reshape(-1, width) for r in got]
    first = np.concatenate([[0], np.cumsum([len(a) for a in x])]).astype(np.int64)
    return fit_crf(np.concatenate(x).astype("f8") if x else np.zeros((0, width)), first, np.array([r.label for r in got], "f8"))


def classify(docs: DataFrame, model: LineCRF, keep: list[str]) -> DataFrame:
    """Columns of `keep`, score and predicted, in one pass without a shuffle. Columns of `keep` that clash with these two stand before them under their own names."""
    fields = docs.select(*keep).schema.fields
    source = docs.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keep)), F.col("text").alias("__text"))
    schema = T.StructType([*(T.StructField(f"k{n}", f.dataType) for n, f in enumerate(fields)), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for a, z in steps(texts, STEP_CHARS):
                s = model.score(texts[a:z])
                cols = [c.slice(a, z - a) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= GOOD_FROM).astype("i4"))], schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, "score", "predicted")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = classify(docs, train(docs, load(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", fold_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
