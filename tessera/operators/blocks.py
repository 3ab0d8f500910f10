"""Order-dependent and numeric operators: grouped pandas code where expressions can't say it."""

from __future__ import annotations

import ast
import collections
import html.parser
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_text
from .grounding import slices

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def pack_chunks(text: str, size: int = 2000, overlap: int = 200) -> list[str]:
    """Pack whole sentences into chunks of up to `size` characters; each begins `overlap` characters before the last one's end.

    Chunks are spans of the text. A span that one long sentence makes too long is cut at its last space that fits.
    """
    if len(text) <= size:
        return [text] if text else []
    past_space = lambda at: at + (text[at : at + 1] == " ")
    ends = [m.start() for m in SENTENCE_END.finditer(text)] + [len(text)]
    spans, begin, last = [], 0, 0
    for end in ends:
        if last > begin and end - begin > size:
            spans.append((begin, last))
            begin = past_space(max(begin, last - overlap))
        last = end
    spans.append((begin, last))
    out = []
    for begin, end in spans:
        while end - begin > size:
            space = text.rfind(" ", begin, begin + size)
            stop = space if space > begin + overlap else begin + size
            out.append(text[begin:stop].strip())
            begin = past_space(stop - overlap)
        out.append(text[begin:end].strip())
    return [c for c in out if c]


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, chunk) of normalised texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(n, k, c) for n, t in enumerate(b.column(1).to_pylist()) for k, c in enumerate(pack_chunks(t, size, overlap))]
            n, k, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n, pa.int64())), pa.array(k, pa.int32()), pa.array(c, pa.string())], ["doc_id", "chunk_index", "chunk"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", normalise_text(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_index int, chunk string")


class PageReader(html.parser.HTMLParser):
    """Text of a page without its scripts, styles and navigation; headings are marked [Hn]."""

    SKIPPED = frozenset({"script", "style", "nav", "footer", "header", "aside", "noscript"})

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.title, self.lines, self.links = 0, "", [], []
        self.here = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.depth += 1
        self.here = tag
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED and self.depth:
            self.depth -= 1
        self.here = ""

    def handle_data(self, data: str) -> None:
        words = " ".join(data.split())
        if self.here == "title":
            self.title = words
        elif words and not self.depth:
            mark = f"[{self.here.upper()}] " if re.fullmatch(r"h[1-6]", self.here) else ""
            self.lines.append(mark + words)


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, links)."""

    def run(batches):
        for b in batches:
            got = []
            for h in b["html"]:
                r = PageReader()
                r.feed(h or "")
                got.append((r.title, "\n".join(r.lines), r.links))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "title": [g[0] for g in got], "text": [g[1] for g in got], "links": [g[2] for g in got]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string, links array<string>")


def isotonic(y: np.ndarray) -> np.ndarray:
    """The nearest rising sequence: pool neighbours that fall."""
    level: list[tuple[float, int]] = []
    for v in y:
        total, n = float(v), 1
        while level and level[-1][0] / level[-1][1] > total / n:
            t, k = level.pop()
            total, n = total + t, n + k
        level.append((total, n))
    return np.concatenate([np.full(n, t / n) for t, n in level]) if level else np.zeros(0)


def unimodal(y: np.ndarray) -> np.ndarray:
    """The nearest sequence that rises and then falls: the best split of two isotonic fits."""
    fits = [np.concatenate([isotonic(y[:k]), isotonic(y[k:][::-1])[::-1]]) for k in range(len(y) + 1)]
    return min(fits, key=lambda f: float(((f - y) ** 2).sum())) if len(y) else y


def trapezoid(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(y, low), high)


def dykstra(y: np.ndarray, projections: list[Callable[[np.ndarray], np.ndarray]], rounds: int = 100, enough: float = 1e-9) -> np.ndarray:
    """The nearest point in the intersection of convex sets, each given by its projection."""
    x, off = y.astype(float), [np.zeros(len(y)) for _ in projections]
    for _ in range(rounds):
        before = x.copy()
        for i, p in enumerate(projections):
            z = p(x + off[i])
            off[i] = x + off[i] - z
            x = z
        if np.abs(x - before).max(initial=0) < enough:
            break
    return x


def calibrated(facts: DataFrame, blend: float = 0.5) -> DataFrame:
    """(doc_id, fact_id, calibrated): confidence blended with its isotonic fit in a document's order of places."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        c = g["confidence"].to_numpy()
        return pd.DataFrame({"doc_id": g["doc_id"], "fact_id": g["fact_id"], "calibrated": blend * c + (1 - blend) * isotonic(c)})

    return facts.select("doc_id", "fact_id", "pos", "confidence").groupBy("doc_id").applyInPandas(run, "doc_id long, fact_id long, calibrated double")


def novel(chunks: DataFrame, most: float = 0.92, least: int = 3, share: float = 0.3) -> DataFrame:
    """(doc_id, chunk_index, kept): a chunk stays unless it is too like an earlier kept one and has no new capitalised names; at least max(least, share) stay."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_index")
        seen, names, kept, score = [], set(), [], []
        for t in g["chunk"]:
            words = frozenset(t.lower().split())
            own = set(re.findall(r"\b[A-Z][a-z]+\b", t))
            like = max((len(words & s) / max(len(words | s), 1) for s in seen), default=0.0)
            ok = like < most or bool(own - names)
            if ok:
                seen.append(words)
                names |= own
            kept.append(ok)
            score.append(like)
        need = max(least, int(share * len(g)))
        for i in np.argsort(score, kind="stable"):
            if sum(kept) >= min(need, len(g)):
                break
            kept[i] = True
        return pd.DataFrame({"doc_id": g["doc_id"], "chunk_index": g["chunk_index"], "kept": kept})

    return chunks.groupBy("doc_id").applyInPandas(run, "doc_id long, chunk_index int, kept boolean")


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest point of the E8 lattice to each row: the better of the two cosets of D8."""

    def d8(v: np.ndarray) -> np.ndarray:
        r = np.floor(v + 0.5)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        gap = v[odd] - r[odd]
        j = np.abs(gap).argmax(1)
        r[odd, j] += np.where(gap[np.arange(len(odd)), j] >= 0, 1.0, -1.0)
        return r

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def rotation(n: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def quantise(x: np.ndarray, bits: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, low ends and spans of rotated rows: 2**bits levels between each row's extremes."""
    y = x @ rotation(x.shape[1], seed).T
    low, span = y.min(1), np.maximum(np.ptp(y, axis=1), 1e-12)
    return np.rint((y - low[:, None]) / span[:, None] * ((1 << bits) - 1)).astype(np.uint8), low, span


def dequantise(codes: np.ndarray, low: np.ndarray, span: np.ndarray, bits: int = 4, seed: int = 7) -> np.ndarray:
    return (codes / ((1 << bits) - 1) * span[:, None] + low[:, None]) @ rotation(codes.shape[1], seed)


def octonion_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cayley-Dickson product of rows of 2**n numbers."""
    n = a.shape[1]
    if n == 1:
        return a * b
    h, conj = n // 2, lambda v: v * np.array([1] + [-1] * (v.shape[1] - 1))
    p, q, r, s = a[:, :h], a[:, h:], b[:, :h], b[:, h:]
    return np.concatenate([octonion_product(p, r) - octonion_product(conj(s), q), octonion_product(s, p) + octonion_product(q, conj(r))], axis=1)


def lattice_cells(points: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cell): the lattice point of each vector's first eight coordinates, as a join key."""

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float)[:8] for v in b[column]]) * 4 if len(b) else np.zeros((0, 8))
            yield pd.DataFrame({key: b[key], "cell": [",".join(f"{2 * c:.0f}" for c in r) for r in e8_nearest(x)]})

    return points.select(key, column).mapInPandas(run, f"{key} long, cell string")


def quantised_error(points: DataFrame, bits: int = 4) -> DataFrame:
    """(vec_id, error): distance of each vector from what its codes decode to."""

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b["embedding"]])
            back = dequantise(*quantise(x, bits), bits)
            yield pd.DataFrame({"vec_id": b["vec_id"], "error": np.sqrt(((x - back) ** 2).sum(1))})

    return points.select("vec_id", "embedding").mapInPandas(run, "vec_id long, error double")


def link_mentions(candidates: DataFrame, swaps: int = 5) -> DataFrame:
    """Collective choice of one candidate for each mention of a document: greedy by score, then swaps that raise
    score plus agreement (equal groups). candidates: doc_id, mention, candidate, score, group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list[dict]] = {}
        for m, less, c, group in sorted(zip(g["mention"], -g["score"], g["candidate"], g["group"], strict=True)):
            by.setdefault(m, []).append({"candidate": c, "score": -less, "group": group})
        names, pick = sorted(by), {m: 0 for m in by}
        groups = collections.Counter(by[m][0]["group"] for m in names)

        def gain(m: str, i: int) -> float:
            """What a swap adds: its score, and the pairs that the new group gains and the old one loses."""
            old, new = by[m][pick[m]], by[m][i]
            pairs = 0 if old["group"] == new["group"] else groups[new["group"]] - (groups[old["group"]] - 1)
            return round(new["score"] - old["score"] + 0.1 * pairs, 9)

        for _ in range(swaps):
            trials = [(gain(m, i), m, i) for m in names for i in range(len(by[m])) if i != pick[m]]
            most, m, i = max(trials, default=(0.0, "", 0), key=lambda t: (t[0], t[1], -t[2]))
            if most <= 0:
                break
            groups[by[m][pick[m]]["group"]] -= 1
            groups[by[m][i]["group"]] += 1
            pick[m] = i
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]] * len(names), "mention": names, "candidate": [by[m][pick[m]]["candidate"] for m in names]})

    return candidates.groupBy("doc_id").applyInPandas(run, "doc_id long, mention string, candidate long")


def session_centroids(turns: DataFrame, rate: float = 0.3) -> DataFrame:
    """(conv_id, turn, x): a running mean that forgets: x becomes (1 - rate) x + rate v at each turn."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("turn")
        x, out = None, []
        for v in g["v"]:
            x = v if x is None else (1 - rate) * x + rate * v
            out.append(x)
        return pd.DataFrame({"conv_id": g["conv_id"], "turn": g["turn"], "x": out})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, x double")


def code_graph(source: str) -> list[tuple[str, str, str]]:
    """(kind, owner, name) of a Python source: functions, classes, imports, calls, and rule hits. Broken sources give none."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    out = []

    def walk(node: ast.AST, owner: str) -> None:
        for c in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.append(("class" if isinstance(c, ast.ClassDef) else "function", owner, c.name))
                if ast.get_docstring(c) is None:
                    out.append(("missing docstring", owner, c.name))
                inner = c.name
            elif isinstance(c, ast.Import):
                out.extend(("import", owner, a.name) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                out.append(("import", owner, c.module or "."))
            elif isinstance(c, ast.Call):
                name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else ""
                if name:
                    out.append(("unsafe call" if name in ("eval", "exec") else "call", owner, name))
            elif isinstance(c, ast.ExceptHandler) and c.type is None:
                out.append(("bare except", owner, ""))
            walk(c, inner)

    walk(tree, "module")
    return out


def shard_axes(points: DataFrame, key: str = "label") -> DataFrame:
    """(vec_id, lat, lon): each key's points in the tangent space at their mean, on its two main axes, scaled to a map."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in g["p"]])
        n = np.minimum(np.linalg.norm(x, axis=1), 0.999999)
        t = x * (2 * np.arctanh(n) / np.maximum(n, 1e-12))[:, None]
        t = t - t.mean(0)
        axes = np.linalg.svd(t, full_matrices=False)[2][:2]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        y = t @ axes.T
        if y.shape[1] < 2:
            y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
        y = y / np.maximum(np.abs(y).max(0), 1e-12)
        return pd.DataFrame({"vec_id": g["vec_id"], "lat": 90 * y[:, 0], "lon": 180 * y[:, 1]})

    return points.groupBy(key).applyInPandas(run, "vec_id long, lat double, lon double")


def batch_verify(facts: DataFrame) -> DataFrame:
    """(doc_id, fact_id, status): in order of confidence; a fact below 0.6 is looked into again and gains 0.1 for each
    accepted fact of its value; 0.7 verifies."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["confidence", "fact_id"], ascending=[False, True])
        accepted: dict[str, int] = {}
        status = []
        for c, v in zip(g["confidence"], g["canonical_value"], strict=True):
            c = c + 0.1 * accepted.get(v, 0) if c < 0.6 else c
            status.append("verified" if c >= 0.7 else "partially_verified" if c >= 0.6 else "unverified")
            if c >= 0.7:
                accepted[v] = accepted.get(v, 0) + 1
        return pd.DataFrame({"doc_id": g["doc_id"], "fact_id": g["fact_id"], "status": status})

    return facts.select("doc_id", "fact_id", "confidence", "canonical_value").groupBy("doc_id").applyInPandas(run, "doc_id long, fact_id long, status string")


def beam(steps: list[list[tuple[str, float]]], width: int = 3) -> list[tuple[tuple[str, ...], float]]:
    """The best paths of one claim per step; paths of the same claims in another order count once."""
    paths: dict[tuple[str, ...], tuple[tuple[str, ...], float]] = {(): ((), 0.0)}
    for claims in steps:
        grown: dict[tuple[str, ...], tuple[tuple[str, ...], float]] = {}
        for (_, (p, s)), (c, w) in itertools.product(sorted(paths.items()), claims):
            key = tuple(sorted({*p, c}))
            if key not in grown or grown[key][1] < s + w:
                grown[key] = ((*p, c), s + w)
        paths = dict(sorted(grown.items(), key=lambda kv: (-kv[1][1], kv[0]))[:width])
    return [v for _, v in paths.items()]


def thompson(gaps: list[tuple[str, int, int]], seed: int) -> list[str]:
    """Gap names by a draw from Beta(1 + wins, 1 + losses) each, highest first."""
    r = np.random.default_rng(seed)
    draws = {name: r.beta(1 + w, 1 + lost) for name, w, lost in gaps}
    return sorted(draws, key=lambda n: (-draws[n], n))
