"""Metadata of pages and documents (native columns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import like, lines, rx, strip, word_count


def extract_urls(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(rx(P.URL, "i")), F.lit(0))))


def extract_emails(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(rx(P.EMAIL)), F.lit(0))))


def is_heading(line: Column) -> Column:
    return (F.length(line) >= 5) & reduce(lambda a, b: a | b, [like(line, p, flags) for flags, p in P.HEADING_LINES])


def extract_headings(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(lines(t), strip), is_heading)))


def detect_toc(t: Column) -> Column:
    return reduce(lambda a, b: a | b, [like(t, p, flags) for flags, p in P.TOC])


def urls_in_order(t: Column) -> Column:
    """Every http(s) URL, repeats kept."""
    return F.regexp_extract_all(t, F.lit(rx(r"https?://\S+")), F.lit(0))


def detect_columns(t: Column, gap: int = 4) -> Column:
    wide = F.filter(lines(t), lambda line: (F.length(line) > 40) & line.rlike(rx(rf"\s{{{gap},}}")))
    return F.size(wide) > F.size(lines(t)) * F.lit(0.3)


def page_metadata(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with the metadata columns of each page."""
    t = F.coalesce(F.col(text), F.lit(""))
    return pages.withColumns({"char_count": F.length(t), "word_count": word_count(t), "urls": extract_urls(t), "emails": extract_emails(t), "headings": extract_headings(t), "has_toc": detect_toc(t), "sections": F.array().cast("array<string>")})


def document_metadata(pages: DataFrame) -> DataFrame:
    """One row per document from ``page_metadata``'s rows; no text is shuffled."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return pages.groupBy("doc_id", "file_name").agg(
        F.count(F.lit(1)).alias("total_pages"),
        (F.sum("char_count") + 2 * (F.count(F.lit(1)) - 1)).alias("total_chars"),
        F.sum("word_count").alias("total_words"),
        union("urls").alias("all_urls"),
        union("emails").alias("all_emails"),
        union("headings").alias("all_headings"),
        F.bool_or("has_toc").alias("has_toc"),
        F.array_sort(F.collect_list(F.when(F.col("has_toc"), F.col("page_number")))).alias("toc_page_numbers"),
    )


def page_range(pages: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Text of the pages first to last (inclusive), joined by a blank line."""
    wanted = pages.where(F.col("page_number").between(first, first if last is None else last))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return wanted.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))
