"""File sources and sinks (S1 to S20): scan, hash, formats, notebooks, Markdown, gazetteers, JSON lines, reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of text formats, and the reader that takes each.
READERS = {
    "text": ["txt", "log", "csv", "tsv", "rst", "tex"],
    "markdown": ["md", "markdown"],
    "html": ["html", "htm", "xhtml"],
    "notebook": ["ipynb"],
    "docx": ["docx"],
    "epub": ["epub"],
    "rtf": ["rtf"],
    "pdf": ["pdf"],
    "source": ["py", "js", "ts", "java", "c", "h", "cpp", "go", "rs", "rb", "php", "cs", "sh", "sql", "r", "scala", "kt", "swift", "lua", "pl"],
}
SKIPPED = r"(^|/)(\.[^/]+|node_modules|__pycache__|venv|build|dist)(/|$)"


def reader_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for name, suffixes in READERS.items():
        out = F.when(suffix.isin(*suffixes), F.lit(name)).otherwise(out)
    return out


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content, reader, content_hash) of the files of known formats under root, but those in hidden or build folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", "^" + re.escape(root if "://" in root or ":" in root else "file:" + root), "")
    found = files.where(~below.rlike(SKIPPED)).withColumn("reader", reader_of(F.col("path")))
    return found.where("reader IS NOT NULL").select("path", "length", "content", "reader", F.sha1("content").alias("content_hash"))


def read_texts(files: DataFrame) -> DataFrame:
    """(path, reader, title, text): each file by its format's reader; unreadable ones give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [text_of(r, bytes(c)) for r, c in zip(b["reader"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "reader": b["reader"], "title": [g[0] for g in got], "text": [g[1] for g in got]})

    return files.select("path", "reader", "content").mapInPandas(run, "path string, reader string, title string, text string")


def text_of(reader: str, data: bytes) -> tuple[str, str]:
    try:
        if reader == "markdown":
            return markdown(data.decode("utf-8", "replace"))
        if reader == "html":
            from ..operators.blocks import PageReader

            p = PageReader()
            p.feed(data.decode("utf-8", "replace"))
            return p.title, "\n".join(p.lines)
        if reader == "notebook":
            return notebook(data)
        if reader in ("docx", "epub"):
            return zipped(reader, data)
        if reader == "rtf":
            return "", re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", "", data.decode("latin-1")).strip()
        if reader == "pdf":
            return "", ""  # a text layer needs a library that is not here; callers hook one in
        return "", data.decode("utf-8", "replace")
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return "", ""


def markdown(text: str) -> tuple[str, str]:
    """Title (front matter's, else the first heading) and text with [Hn] and [CODE] marks."""
    title, body = "", text
    front = re.match(r"---\n(.*?)\n---\n?", text, re.DOTALL)
    if front:
        body = text[front.end() :]
        for line in front[1].splitlines():
            key, _, value = line.partition(":")
            if key.strip().lower() == "title":
                title = value.strip().strip("\"'")
    out, code = [], False
    for line in body.splitlines():
        if line.startswith("```"):
            code = not code
            out.append("[CODE]" if code else "[/CODE]")
        elif not code and (h := re.match(r"(#{1,6})\s+(.*)", line)):
            title = title or h[2].strip()
            out.append(f"[H{len(h[1])}] {h[2].strip()}")
        else:
            out.append(line)
    return title, "\n".join(out).strip()


def notebook(data: bytes) -> tuple[str, str]:
    import json

    title, out = "", []
    for cell in json.loads(data).get("cells", []):
        body = "".join(cell.get("source", []))
        if cell.get("cell_type") == "markdown":
            title = title or next((x[2:].strip() for x in body.splitlines() if x.startswith("# ")), "")
            out.append(body)
        elif cell.get("cell_type") == "code":
            out.append(f"[CODE]\n{body}\n[/CODE]")
    return title, "\n\n".join(out)


def zipped(reader: str, data: bytes) -> tuple[str, str]:
    from ..operators.blocks import PageReader

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if reader == "docx":
            root = ElementTree.fromstring(z.read("word/document.xml"))
            local = lambda e: e.tag.rsplit("}", 1)[-1]
            lines = ["".join(t.text or "" for t in p.iter() if local(t) == "t") for p in root.iter() if local(p) == "p"]
            return "", "\n".join(x for x in lines if x)
        p = PageReader()
        for name in sorted(n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm"))):
            p.feed(z.read(name).decode("utf-8", "replace"))
        return p.title, "\n".join(p.lines)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a list with one on each line; blank lines and # comments don't count."""
    t = spark.read.text(path).select(F.trim("value").alias("term"))
    return t.where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def write_gazetteer(terms: DataFrame, column: str, path: str) -> None:
    terms.select(F.col(column).alias("value")).distinct().write.mode("overwrite").text(path)


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").json(path)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Overwrite the partitions that df has, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def report(rows: DataFrame, title: str, by: str, line: str, most: int = 200) -> str:
    """A Markdown report of at most `most` lines, grouped by a column."""
    out, group = [f"# {title}"], None
    for r in rows.select(by, line).orderBy(by, line).limit(most).collect():
        if r[by] != group:
            group = r[by]
            out.append(f"\n## {group}\n")
        out.append(f"- {r[line]}")
    return "\n".join(out)
