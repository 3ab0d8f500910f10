"""Sentences and grounded spans of whole texts, row by row in Arrow batches: no text is shuffled and none is joined."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import ground, sentence_spans

#: Rows of a batch whose results are made at once: a batch may have 10,000 long texts, and Python's lists of their sentences take many times their size.
ROWS = 64


def slices(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, without copies."""
    rows = rows or ROWS
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, start, end, sentence) of each text's sentences; places count code points, ends are exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, rows = [], []
            for n, text in enumerate(b.column(1)):
                t = text.as_py()
                for pos, (a, z) in enumerate(sentence_spans(t)):
                    keys.append(n)
                    rows.append((pos, a, z, t[a:z]))
            parts = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(parts, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True))], [key, "pos", "start", "end", "sentence"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, pos int, start int, end int, sentence string")


def grounded(facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """(key, valid, start, end, reason) of facts that carry their text: rows key, text, span, fact_text, start, end (the last two may be null)."""
    source = facts.select(key, "text", "span", "fact_text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [ground(*(c[n].as_py() for c in b.columns[1:])) for n in range(b.num_rows)]
            kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], kinds[k]) for k in range(4))], [key, "valid", "start", "end", "reason"])

    return source.mapInArrow(run, f"{key} {facts.schema[key].dataType.simpleString()}, valid boolean, start int, end int, reason string")
