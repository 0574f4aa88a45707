"""Normalisation of pages with the help of their metadata.

The page function keeps a table of protected blocks and needs the places of all
matches, so one Arrow UDF does it and a text crosses to Python once. The steps
that are plain replacements also exist as native columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import NormalizeConfig
from paperloom.functions import patterns as P
from paperloom.functions.text import compiled, lines, rx, strip, sub, unlines

RESULT = (
    "struct<normalized_text:string,original_char_count:int,normalized_char_count:int,original_word_count:int,normalized_word_count:int,"
    "removed_urls:array<string>,removed_page_numbers:array<string>,protected_elements:array<string>,changes_applied:array<string>,warnings:array<string>>"
)


def stays(config: NormalizeConfig) -> Column:
    """Skipped pages go; forced pages stay; then pages of a contents list go."""
    n = F.col("page_number")
    skip = n.isin(*config.skip_pages) if config.skip_pages else F.lit(False)
    force = n.isin(*config.force_process_pages) if config.force_process_pages else F.lit(False)
    contents = F.col("has_toc") if config.remove_toc_pages else F.lit(False)
    return ~skip & (force | ~contents)


def filter_pages(pages: DataFrame, config: NormalizeConfig) -> DataFrame:
    return pages.where(stays(config))


# ------------------------------------------------------------- native columns


def collapse_lines(t: Column) -> Column:
    """Runs of spaces become one, and each line is stripped."""
    return unlines(F.transform(lines(sub(t, P.SPACES, " ")), strip))


def remove_listed_urls(t: Column, urls: Column) -> Column:
    """Each listed URL literally, the longest first."""
    longest = F.array_sort(urls, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, t, lambda acc, u: F.replace(acc, u, F.lit("")))


def remove_own_page_number(t: Column, number: Column) -> Column:
    for flags, p in P.PAGE_NUMBER_TEMPLATES:
        a, b = rx(p, flags).split("<n>")
        t = F.regexp_replace(t, F.concat(F.lit(a), number.cast("string"), F.lit(b)), F.lit(""))
    return t


def fix_sentences_safely(t: Column) -> Column:
    return sub(t, P.SAFE_SENTENCE[1], "$1 $2", P.SAFE_SENTENCE[0])


def apply_safe_ocr(t: Column) -> Column:
    for p, to in P.SAFE_OCR:
        t = sub(t, p, to)
    return t


def normalize_page_bullets(t: Column) -> Column:
    for flags, p in P.PAGE_BULLETS:
        t = sub(t, p, "• ", flags)
    return t


# ------------------------------------------------------------ page by page


class PageNormalizer:
    """All steps on one page, in their fixed order."""

    def __init__(self, config: NormalizeConfig) -> None:
        self.config = config
        self.protected = [
            (name, list(compiled(pats)))
            for name, wanted, pats in (
                ("CODE", config.protect_code_blocks, P.CODE_BLOCKS),
                ("TABLE", config.protect_tables, P.TABLE_BLOCKS),
                ("BULLET", config.protect_bullet_points, (P.BULLET_BLOCK,)),
                ("HEADING", config.protect_headings, P.HEADING_BLOCKS),
            )
            if wanted
        ]
        for i, p in enumerate(config.custom_protect_patterns):
            if _valid(p):
                self.protected.append((f"CUSTOM_{i}", [re.compile(p, re.M)]))
        self.headers = list(compiled(P.PAGE_HEADER_LINES)) + [re.compile(p, re.M | re.I) for p in config.custom_header_patterns if _valid(p)]
        self.hierarchy = [(level, re.compile(p, re.M | (re.I if "i" in flags else 0))) for level, flags, p in P.HIERARCHY]
        self.gap = re.compile(rf"\s{{{config.multi_column_threshold},}}")
        self.sentence, = compiled((P.SAFE_SENTENCE,))
        self.bullets = list(compiled(P.PAGE_BULLETS))

    def protect(self, text: str) -> tuple[str, dict[str, str], list[str]]:
        blocks: dict[str, str] = {}
        log: list[str] = []

        def hide(kind: str):
            def mark(m: re.Match) -> str:
                name = f"<<<PROTECTED_{kind}_{len(blocks)}>>>"
                blocks[name] = m[0]
                log.append(f"{kind}: {m[0][:50]}...")
                return name

            return mark

        for kind, found in self.protected:
            for p in found:
                text = p.sub(hide(kind), text)
        return text, blocks, log

    def headings(self, text: str) -> list[tuple[int, int, str]]:
        """(place, level, title) by place; several levels may share a place."""
        return sorted(((m.start(), level, m[0].strip()) for level, p in self.hierarchy for m in p.finditer(text)), key=lambda h: h[0])

    def _columns(self, text: str) -> str | None:
        rows = text.split("\n")
        if sum(1 for r in rows if len(r) > 40 and self.gap.search(r)) <= 0.3 * len(rows):
            return None
        out: list[str] = []
        for r in rows:
            out += [p for p in map(str.strip, self.gap.split(r)) if p] if self.gap.search(r) else [r]
        return "\n".join(out)

    def _own_number(self, text: str, number: int) -> tuple[str, list[str]]:
        found: list[str] = []
        for flags, p in P.PAGE_NUMBER_TEMPLATES:
            (one,) = compiled(((flags, p.replace("<n>", str(number))),))
            found += one.findall(text)
            text = one.sub("", text)
        return text, found

    def __call__(self, original: str, number: int, urls: list[str], headings: list[str]) -> dict:
        c, done = self.config, []
        text, blocks, log = self.protect(original)
        if log:
            done.append(f"Protected {len(log)} elements")
        if c.detect_multi_column and (split := self._columns(text)) is not None:
            text = split
            done.append("Converted multi-column layout")
        if c.preserve_hierarchy and (marks := self.headings(text)):
            for at, level, _ in reversed(marks):
                text = f"{text[:at]}\n<<<HIERARCHY_L{level}>>>\n{text[at:]}"
            done.append(f"Preserved hierarchy ({len(marks)} levels)")
        removed: list[str] = []
        numbers: list[str] = []
        for wanted, name, step in (
            (c.normalize_line_breaks, "Normalized line breaks", lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
            (c.remove_hyphen_line_breaks, "Removed hyphen line breaks", lambda t: re.sub(P.HYPHEN_BREAK, r"\1\2", t)),
        ):
            if wanted:
                text = step(text)
                done.append(name)
        if c.remove_urls and urls:
            for u in sorted(urls, key=lambda u: (-len(u), u)):
                if u in text:
                    text = text.replace(u, "")
                    removed.append(u)
            if removed:
                done.append(f"Removed {len(removed)} URLs")
        if c.remove_page_numbers:
            text, numbers = self._own_number(text, number)
            if numbers:
                done.append("Removed page number")
        for wanted, name, step in (
            (c.remove_headers_footers, "Removed headers/footers", lambda t: _all(self.headers, "", t)),
            (c.fix_ligatures, "Fixed ligatures", lambda t: t.translate(_LIGATURES)),
            (c.apply_ocr_corrections, "Applied OCR corrections", lambda t: _each(P.SAFE_OCR, t)),
            (c.merge_hyphenated_words, "Merged hyphenated words", lambda t: re.sub(P.HYPHEN_BREAK, r"\1\2", t)),
            (c.fix_broken_sentences, "Fixed broken sentences", lambda t: self.sentence.sub(r"\1 \2", t)),
            (c.normalize_bullet_points and not c.protect_bullet_points, "Normalized bullet points", lambda t: _all(self.bullets, "• ", t)),
            (c.collapse_whitespace, "Collapsed whitespace", lambda t: "\n".join(x.strip() for x in re.sub(P.SPACES, " ", t).split("\n"))),
            (c.collapse_blank_lines, "Collapsed blank lines", lambda t: re.sub(P.BLANK_LINES, "\n\n", t)),
            (c.unicode_normalize, "Unicode normalized", lambda t: unicodedata.normalize("NFKC", t)),
        ):
            if wanted:
                text = step(text)
                done.append(name)
        for mark, block in blocks.items():  # in order, once: a mark inside a later block stays
            text = text.replace(mark, block)
        text = text.strip()
        warnings = crosscheck(original, text, urls, headings) if c.enable_metadata_crosscheck else []
        if warnings:
            done.append(f"Crosscheck: {len(warnings)} warnings")
        return {
            "normalized_text": text,
            "original_char_count": len(original),
            "normalized_char_count": len(text),
            "original_word_count": len(original.split()),
            "normalized_word_count": len(text.split()),
            "removed_urls": removed,
            "removed_page_numbers": numbers,
            "protected_elements": log,
            "changes_applied": done,
            "warnings": warnings,
        }


_LIGATURES = str.maketrans(P.PAGE_LIGATURES)


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _all(found: list[re.Pattern], to: str, text: str) -> str:
    for p in found:
        text = p.sub(to, text)
    return text


def _each(pairs, text: str) -> str:
    for p, to in pairs:
        text = re.sub(p, to, text)
    return text


def crosscheck(original: str, text: str, urls: list[str], headings: list[str]) -> list[str]:
    """What normalising may have lost."""
    out = [f"Heading possibly lost: '{h[:50]}...'" for h in headings if h not in text]
    before, after = len(original.split()), len(text.split())
    lost = (before - after) / before * 100 if before else 0
    if lost > 50:
        out.append(f"Excessive text loss: {lost:.1f}% of words removed")
    if left := sum(u in text for u in urls):
        out.append(f"{left} URLs still present in normalized text")
    return out


def normalize_pages(pages: DataFrame, config: NormalizeConfig = NormalizeConfig(), dropped: bool = False) -> DataFrame:
    """One row per page that the page filter leaves: doc_id, file_name,
    page_number and the result's fields. ``pages``: rows of ``page_metadata``.
    With ``dropped`` every page is a row, with its text; the normalised text of
    those the filter drops is null."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        one = PageNormalizer(config)
        for text, number, urls, headings in batches:
            yield pd.DataFrame([one(t or "", int(n), list(u), list(h)) for t, n, u, h in zip(text, number, urls, headings, strict=True)], columns=_FIELDS)

    if dropped:
        rows = pages.withColumn("stays", F.coalesce(stays(config), F.lit(True)))
        rows = rows.withColumn("r", run(F.when(F.col("stays"), F.col("text")), "page_number", "urls", "headings"))
        return rows.select("doc_id", "file_name", "page_number", "text", F.when(F.col("stays"), F.col("r.normalized_text")).alias("normalized_text"))
    kept = filter_pages(pages, config)
    return kept.withColumn("r", run("text", "page_number", "urls", "headings")).select("doc_id", "file_name", "page_number", "r.*")


_FIELDS = [x.partition(":")[0] for x in RESULT[7:-1].split(",")]


def normalization_stats(results: DataFrame) -> DataFrame:
    """Totals per document."""
    ratio = F.coalesce(F.try_divide(F.col("char_reduction") * 100.0, F.col("original_chars")), F.lit(0.0))
    return (
        results.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("total_pages_processed"),
            F.sum("original_char_count").alias("original_chars"),
            F.sum("normalized_char_count").alias("normalized_chars"),
            F.sum("original_word_count").alias("original_words"),
            F.sum("normalized_word_count").alias("normalized_words"),
            F.sum(F.size("removed_urls")).alias("total_urls_removed"),
            F.sum(F.size("removed_page_numbers")).alias("total_page_numbers_removed"),
            F.sum(F.size("protected_elements")).alias("total_protected_elements"),
        )
        .withColumn("char_reduction", F.col("original_chars") - F.col("normalized_chars"))
        .withColumn("word_reduction", F.col("original_words") - F.col("normalized_words"))
        .withColumn("char_reduction_percent", ratio)
    )


def assemble(results: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """One text per document, pages in order, with marks if wanted."""
    mark = F.lit("")
    if config.add_page_markers:
        a, _, b = config.page_marker_template.partition("{page_num}")
        mark = F.concat(F.lit(a), F.col("page_number").cast("string"), F.lit(b))
    pages = F.array_sort(F.collect_list(F.struct("page_number", F.concat(mark, "normalized_text").alias("text"))))
    return results.groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n").alias("text"))
