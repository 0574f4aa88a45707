"""Documents from files: text, DOCX and, where an extractor is given, PDF.

Files that cannot be read go to the rows with an ``error``; a job never fails
for one file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "doc_id string, file_name string, file_type string, page_number int, text string, sections array<string>, total_sections int, error string"


def extension(path: str) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: line ends become LF; bytes that are not UTF-8 are an error."""
    files = spark.read.format("binaryFile").load(path)
    name = F.col("_metadata.file_name")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return files.select(F.sha2("path", 256).alias("doc_id"), name.alias("file_name"), extension("path").alias("file_type"), F.lit(1).alias("page_number"), text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def docx_text(content: bytes) -> tuple[str, list[str], int]:
    """Text, heading-style paragraphs, and number of sections of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out: list[str] = []
    heads: list[str] = []
    breaks = 0
    for p in body.findall(f"{_W}p"):
        if p.find(f"{_W}pPr/{_W}sectPr") is not None and out:
            out.append("--- SECTION BREAK ---")
            breaks += 1
        text = said(p)
        if text.strip():
            out.append(text)
            style = p.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and (style.get(f"{_W}val") or "").startswith("Heading"):
                heads.append(text.strip())
    tables = body.findall(f"{_W}tbl")
    if tables:
        out.append("--- TABLES ---")
    for k, table in enumerate(tables, 1):
        out.append(f"[Table {k}]")
        for row in table.findall(f"{_W}tr"):
            cells = [said(c).strip() for c in row.findall(f"{_W}tc")]
            if any(cells):
                out.append(" | ".join(c for c in cells if c))
    return "\n".join(out), heads, max(len(heads), breaks + 1)


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """One row per page of every file. ``pdf``: bytes to the texts of the pages."""

    def one(name: str, content: bytes) -> list[tuple]:
        kind = name.rpartition(".")[2].lower() if "." in name else ""
        try:
            if kind == "txt":
                return [(kind, 1, content.decode().replace("\r\n", "\n").replace("\r", "\n"), [], 0, None)]
            if kind == "docx":
                text, heads, n = docx_text(content)
                return [(kind, 1, text, heads, n, None)]
            if kind == "pdf" and pdf:
                return [(kind, k, text, [], 0, None) for k, text in enumerate(pdf(content), 1)]
        except Exception as e:  # one bad file must not end the job: it becomes a row
            return [(kind, None, None, [], 0, f"{type(e).__name__}: {e}"[:300])]
        return [(kind, None, None, [], 0, f"unsupported file type: {kind}")]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, *r) for d, n, c in zip(b.doc_id, b.file_name, b.content, strict=True) for r in one(n, c)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path).select(F.sha2("path", 256).alias("doc_id"), F.col("_metadata.file_name").alias("file_name"), "content")
    return files.mapInPandas(extract, SCHEMA)
