"""Token-ID files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned 16- or
32-bit integers), then a skippable frame with the documents' ids, and last the seek
table of zstandard's public seekable format: each frame's compressed and
decompressed size and the low 32 bits of XXH64 over its content. A reader takes the
table from the file's end and decompresses the documents it wants, checking each.

Writing: documents are encoded and compressed where they are read, put in doc_id
order by range, and each task streams its range into files of about FILE_BYTES. A
file is written under a name of its own and renamed when whole, so a lost executor's
task can run again anywhere. Files go to the folder that all executors share.

Defined results: a null or empty text has the end id alone. Rows of one doc_id stand
in order of their frames' hashes; null ids come first. No rows give no files. Repeated
rows have a frame each. Very long texts are one frame, encoded and written whole. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, steps
from .common import durable, load, new_path, partitions

#: Magic numbers of zstandard's skippable frames and seek tables.
SKIPPABLE = 0x184D2A50
SEEK_FRAME = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
#: Fixed value: the pre-tokenizer's pattern of this vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 2
LEVEL = 1
FILE_BYTES = 64 << 20
#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_200_000
STEP_CHARS = 4_000_000


class WordCoder:
    """Encodes as a tokenizers file does whose pre-tokenizer drops white space, remembering what each word comes to."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.kind, self.code = ("<u2", "H") if self.whole.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        with open(path, encoding="utf-8") as f:
            self.marks = [t["content"].encode() for t in json.load(f)["added_tokens"]]
        self.pieces = regex.compile(PIECES)
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.known: dict[bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def word(self, word: str) -> bytes:
        """A piece that the pre-tokenizer would not split."""
        return self.pack([t.id for t in self.whole.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])

    def learn(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # of ASCII
            return self.pack([t.id for t in self.whole.model.tokenize(chunk.decode())])
        text = chunk.decode("utf-8", "surrogatepass")
        low = text.lower()
        # lower case and composition are plain in the Latin blocks
        if max(low) < "ɐ" and len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            out = []
            for piece in self.pieces.findall(low):
                key = piece.encode()
                got = self.known.get(key)
                out.append(got if got is not None else self.known.setdefault(key, self.word(piece)))
            return b"".join(out)
        return self.pack(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        low = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: ASCII alone; the vocabulary folds case anyway
        if b"<|" in low and any(m in low for m in self.marks):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        chunks = low.split()
        known, at = self.known, -1
        coded = list(map(known.get, chunks))
        try:
            while True:
                at = coded.index(None, at + 1)
                c = chunks[at]
                v = known.get(c)
                coded[at] = v if v is not None else known.setdefault(c, self.learn(c))
        except ValueError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        return b"".join(coded)


_coders: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def file_system(uri: str) -> tuple[Any, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class FrameWriter:
    """Writes one file; `close` puts it in its place."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.bytes = 0

    def add(self, doc_id: int | None, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.bytes += len(frame)
        self.table.append((len(frame), size, check))
        self.ids.append(doc_id)

    def close(self) -> None:
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array([i is None for i in self.ids], "u1").tobytes()
        body = zstandard.ZstdCompressor(level=LEVEL).compress(ids)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        rows = np.array(self.table, "<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(rows) + len(foot)) + rows + foot)
        self.out.close()
        self.fs.move(self.part, self.path)


class FrameReader:
    """Reads documents of a file by their number in it."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        self.table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype("i8"))])
        head, length = struct.unpack("<II", self.file.read_at(8, int(self.starts[-1])))
        if head != SKIPPABLE:
            raise ValueError(f"{uri}: no document ids")
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, int(self.starts[-1]) + 8))
        null = np.frombuffer(raw[8 * count :], "u1")
        self.doc_ids = [None if n else int(i) for i, n in zip(np.frombuffer(raw[: 8 * count], "<i8"), null, strict=True)]
        self.unzip = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def read(self, n: int, kind: str) -> np.ndarray:
        packed, size, check = map(int, self.table[n])
        data = self.unzip.decompress(self.file.read_at(packed, int(self.starts[n])), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"document {n}: checksum differs")
        return np.frombuffer(data, kind)


def write_files(docs: DataFrame, vocab: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into files; gives the durable list of files: part, k, path, docs, tokens (in doc_id order by part, k)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, z = word_coder(vocab), zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)
        end = c.pack([end_id])
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in steps(texts, STEP_CHARS):
                ids = [c.encode(t) + end for t in texts[x:y]]
                checks = [xxhash.xxh64_intdigest(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array([z.compress(i) for i in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64()), pa.array([k & 0xFFFFFFFF for k in checks], pa.int64()), pa.array([k >> 1 for k in checks], pa.int64())],
                    ["doc_id", "frame", "size", "check", "tie"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        part, k, out, made = TaskContext.get().partitionId(), 0, None, []
        width = int(word_coder(vocab).kind[-1])
        tokens = 0

        def shut() -> None:
            nonlocal out, tokens
            out.close()
            made.append((part, k, f"{folder}/part-{part:06d}-{k:04d}.zst", len(out.ids), tokens))
            out, tokens = None, 0

        for b in batches:
            for doc_id, frame, size, check in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
                if out is not None and out.bytes >= FILE_BYTES:
                    shut()
                    k += 1
                if out is None:
                    fs.create_dir(at, recursive=True)
                    out = FrameWriter(f"{folder}/part-{part:06d}-{k:04d}.zst")
                out.add(doc_id, frame, size, check)
                tokens += size // width
        if out is not None:
            shut()
        names = ["part", "k", "path", "docs", "tokens"]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)

    coded = durable(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, frame binary, size long, check long, tie long"), "token-frames")
    ranged = coded.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return durable(ranged.mapInArrow(write, "part int, k int, path string, docs long, tokens long"), "token-file-list")


def read_files(files: DataFrame, kind: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit integers)."""
    # one row per file of FILE_BYTES: the running sum is over the list of files, not over documents
    w = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = FrameReader(path)
                for x in range(0, len(r), 5000):
                    ids = range(x, min(x + 5000, len(r)))
                    sizes, crcs = [], []
                    for n in ids:
                        got = r.read(n, kind)
                        sizes.append(len(got))
                        crcs.append(zlib.crc32(got.astype("<u4").tobytes()))
                    starts = start + np.concatenate([[0], np.cumsum(sizes)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays([pa.array([r.doc_ids[n] for n in ids], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(partitions(files.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def word_vocab() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = word_vocab()
    return read_files(write_files(load(spark, sf_dir, "documents"), vocab), word_coder(vocab).kind)
