"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

Merging from the bottom up repeats work for words that begin alike. Here the
distinct words of a batch go into a trie that is walked depth first. A node
(one prefix) needs a single number: the *last token* of the prefix's encoding.
The encoding of a prefix is the encoding of a shorter prefix plus that token,
and exactly one of the tokens that end the prefix fits: the one that no merge
across its left border would have broken up. So each prefix is worked out once,
however many words share it, and a word's ids are read off by walking back.

Depth-first order over a trie is the sorted order of its words, so the trie is
held as the path to the current word: memory is the longest word, not the trie.

Defined results: a null or empty text has no ids; other texts are lossless.
Repeated rows are encoded alike; other columns are not touched. An empty table gives
no rows. Very long texts are encoded whole, a batch of words at a time. No two merges
tie: each has a rank of its own, and of equal ones in a word the leftmost goes first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 350_000
#: Pairs of tokens whose fit a worker remembers.
BORDERS = 400_000
#: Characters of text per step, so that one step's words stay small.
STEP_CHARS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    shown.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return shown


class TrieBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(s) for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        special_ids = set(self.specials.values())
        self.ids = {b: i for i, b in self.bytes_of.items() if i not in special_ids}
        # rank of a merge and the halves that a token was merged from
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = self.ids[as_bytes(a)], self.ids[as_bytes(b)]
            self.rank[x, y] = r
            self.made.setdefault(self.ids[as_bytes(a + b)], (r, x, y))
        self.split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.words = regex.compile(PATTERN)
        self.space = regex.compile(r"\s")
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.four = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.borders: dict[int, bool] = {}
        self.known: dict[str, bytes | None] = {}

    def stands(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: no merge across their border comes before those that built them."""
        key = left << 20 | right
        if (got := self.borders.get(key)) is not None:
            return got
        if len(self.borders) > BORDERS:
            self.borders.clear()
        rank, made = self.rank, self.made
        a, b, before, ok = left, right, len(rank) + 1, True
        # Undo the latest merge of either side, until a border merge would have come earlier, or only bytes remain.
        while True:
            if rank.get((a, b), before) < before:
                ok = False
                break
            ra, rb = made.get(a, (-1,))[0], made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, made[a][2]
            else:
                # of equal ranks the left place is merged first: a border merge of this rank precedes the right side's
                before, b = rb + 1, made[b][1]
        self.borders[key] = ok
        return ok

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as little-endian 32-bit integers."""
        ids, stands, borders, four = self.ids, self.stands, self.borders, self.four
        out: dict[str, bytes] = {}
        path, last, size = b"", [-1], [0]  # of the prefix of length n: its last token and that token's length
        for word in sorted(words):
            raw = word.encode()
            n, most = 0, min(len(path), len(raw))
            while n < most and path[n] == raw[n]:
                n += 1
            del last[n + 1 :], size[n + 1 :]
            k = size[n]
            for end in range(n + 1, len(raw) + 1):
                k += 1  # most often the last token grows by a byte; of all lengths just one fits
                t = ids.get(raw[end - k : end])
                if t is None or ((p := last[end - k]) >= 0 and not (got if (got := borders.get(p << 20 | t)) is not None else stands(p, t))):
                    for k in (2, 3, 1, *range(4, end + 1)) if end > 3 else range(1, end + 1):
                        t = ids.get(raw[end - k : end])
                        if t is not None and ((p := last[end - k]) < 0 or (got if (got := borders.get(p << 20 | t)) is not None else stands(p, t))):
                            break
                    else:
                        raise ValueError(f"no token ends {raw[:end]!r}")
                last.append(t)
                size.append(k)
            path, at, found = raw, len(raw), []
            while at:
                found.append(four[last[at]])
                at -= size[at]
            found.reverse()
            out[word] = b"".join(found)
        return out

    def pieces(self, text: str) -> list[str]:
        return self.words.findall(text)

    def learn(self, new: set[str]) -> None:
        """Remember the ids of chunks: a space and what follows up to the next one, or a text's beginning.

        A chunk that ends in white space, or has more of it after its space, can't
        be cut off there; it is remembered as None, and its texts take the slow path.
        """
        whole, ended, parts = set(), {}, {}
        for c in new:
            body = c[c[:1] == " " :]
            if body.isalpha():
                whole.add(c)
            elif body[:-1].isalpha() and body[-1] in ".,;:!?":
                ended[c] = (c[:-1], body[-1])
            else:
                parts[c] = [] if not c else None if not body or c is not body and self.white(body[0]) or self.white(body[-1]) else self.pieces(c)
        found = self.encode_words({*whole, *(w for p in ended.values() for w in p), *(w for p in parts.values() if p for w in p)})
        known = self.known
        for c in whole:
            known[c] = found[c]
        for c, (w, end) in ended.items():
            known[c] = found[w] + found[end]
        for c, p in parts.items():
            known[c] = None if p is None else b"".join(map(found.__getitem__, p))

    def white(self, c: str) -> bool:
        return c.isspace() or self.space.match(c) is not None

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cut before each space; the first chunk has none."""
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = list(map(self.chunks, texts))
        coded = [list(map(self.known.get, c)) for c in cut]
        missing = [(c, x, [n for n, v in enumerate(x) if v is None]) for c, x in zip(cut, coded, strict=True) if None in x]
        # the more words at once, the more prefixes they share
        self.learn({c[n] for c, _, at in missing for n in at}.difference(self.known))
        for c, x, at in missing:
            for n in at:
                x[n] = self.known[c[n]]
        slow = {n: self.pieces(texts[n]) for n, x in enumerate(coded) if None in x}
        found = self.encode_words({w for p in slow.values() for w in p})
        return [b"".join(map(found.__getitem__, slow[n]) if n in slow else x) for n, x in enumerate(coded)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers; special tokens' strings become their ids."""
        texts = [t or "" for t in texts]
        if not (self.split and any(s in t for t in texts for s in self.specials)):
            return self.encode_plain(texts)
        plain, plan = [], []
        for t in texts:
            begin, parts = 0, []
            for m in self.split.finditer(t):
                parts += [t[begin : m.start()], self.specials[m.group()]]
                begin = m.end()
            plan.append([*parts, t[begin:]])
            plain += [p for p in plan[-1] if isinstance(p, str)]
        done = iter(self.encode_plain(plain))
        return [b"".join(next(done) if isinstance(p, str) else p.to_bytes(4, "little") for p in parts) for parts in plan]

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I").tolist()))


_coders: dict[str, TrieBPE] = {}


def coder(path: str) -> TrieBPE:
    """One coder per worker and file; workers are reused by later tasks."""
    if path not in _coders:
        _coders[path] = TrieBPE(path)
    return _coders[path]


def steps(texts: list[str | None], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters together; a longer text stands alone."""
    begin, chars = 0, 0
    for n, t in enumerate(texts):
        size = len(t or "")
        if n > begin and chars + size > most:
            yield begin, n
            begin, chars = n, 0
        chars += size
    if begin < len(texts):
        yield begin, len(texts)


def encode_decode(docs: DataFrame, vocab: str, keep: list[str], digests_only: bool = False, texts_too: bool = True) -> DataFrame:
    """Encode and decode every row of docs (`text`), in one pass without a shuffle.

    Gives the columns of `keep`, n_tokens, ids_sha256 and decoded_sha256, and unless
    digests_only also ids (array<int>) and, if texts_too, decoded. Null or empty texts: no ids, "".
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    extra = [] if digests_only else ["ids", "decoded"] if texts_too else ["ids"]
    more = "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[k] for k in extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocab)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            for a, b in steps(texts):
                coded = c.encode(texts[a:b])
                back = [c.decode(x) for x in coded]
                cols = [batch.column(batch.schema.get_field_index(k)).slice(a, b - a) for k in keep]
                cols += [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                ]
                if "ids" in extra:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in coded], pa.list_(pa.int32())))
                if "decoded" in extra:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    return source.mapInArrow(run, schema)


def byte_vocab() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(load(spark, sf_dir, "documents"), byte_vocab(), ["doc_id"], digests_only=True)
