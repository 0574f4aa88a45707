"""Text functions: Column to Column, inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def rx(pattern: str, flags: str = "") -> str:
    """A pattern in Java's dialect with Unicode classes, LF-only lines and an
    absolute end; a wrong one fails here and not in a task."""
    re.compile(pattern)
    return f"(?Ud{flags})" + pattern.replace(r"\Z", r"\z")


def sub(text: Column, pattern: str, to: str = "", flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(rx(pattern, flags)), F.lit(to))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(items: Column) -> Column:
    return F.array_join(items, "\n")


def like(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def once(column: Column) -> Column:
    """The same value, which the optimiser keeps as one column: it would copy a
    deterministic one into every place that looks at it."""
    return F.when(F.spark_partition_id() >= 0, column)


# ------------------------------------------------------- structure (T1 to T6)


def normalize_line_breaks(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def remove_hyphen_line_breaks(t: Column) -> Column:
    return sub(t, P.HYPHEN_BREAK, "$1$2")


def collapse_whitespace(t: Column) -> Column:
    return sub(t, P.SPACES, " ")


def collapse_blank_lines(t: Column, most: int = 2) -> Column:
    return sub(t, P.BLANK_LINES, "\n" * most)


def unicode_normalize(t: Column, form: str = "NFKC") -> Column:
    """The one text function the JVM side lacks: an Arrow UDF over batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return run(t)


def normalize_structure(t: Column) -> Column:
    return unicode_normalize(collapse_blank_lines(collapse_whitespace(remove_hyphen_line_breaks(normalize_line_breaks(t)))))


# ---------------------------------------------------------- noise (T7 to T11)


def _without(t: Column, flagged: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: sub(acc, p[1], "", p[0]), flagged, t)


def remove_headers_footers(t: Column, custom: Iterable[str] = ()) -> Column:
    return _without(t, [*P.HEADER_LINES, *(("mi", p) for p in custom)])


def remove_page_numbers(t: Column) -> Column:
    return _without(t, P.PAGE_NUMBER_LINES)


def remove_urls(t: Column, to: str = "") -> Column:
    return sub(t, P.URL_OR_DOTTED, to.replace("\\", "\\\\").replace("$", "\\$"))


def remove_toc_artifacts(t: Column) -> Column:
    return _without(t, [("m", p) for p in P.TOC_LINES])


def remove_noise(t: Column) -> Column:
    return remove_toc_artifacts(remove_urls(remove_page_numbers(remove_headers_footers(t))))


# ----------------------------------------------------- sentences (T12 to T17)


def fix_broken_sentences(t: Column) -> Column:
    return sub(t, P.BROKEN_SENTENCE, "$1 $2")


def merge_hyphenated_words(t: Column) -> Column:
    return sub(t, P.HYPHEN_BREAKS, "$1$2")


def clean_columns(t: Column, gap: int = 4) -> Column:
    """Lines with a wide gap become one line for each part."""
    wide = rx(rf"\s{{{gap},}}")
    parts = lambda line: F.filter(F.transform(F.split(line, wide), strip), lambda p: p != "")
    return unlines(F.flatten(F.transform(lines(t), lambda line: F.when(line.rlike(wide), parts(line)).otherwise(F.array(line)))))


def normalize_bullets(t: Column) -> Column:
    def one(line: Column) -> Column:
        out = line
        for flags, p in reversed(P.BULLETS):
            out = F.when(like(line, p, flags), sub(line, p, "• ", flags)).otherwise(out)
        return out

    return unlines(F.transform(lines(t), one))


def space_section_titles(t: Column) -> Column:
    """A blank line around title lines: before one if the last line put out is
    not blank, after one unless it is the last. A fold over the lines."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(False).alias("title"))

    def step(acc: Column, line: Column) -> Column:
        title = like(strip(line), P.SECTION_TITLE)
        before = F.when((F.size(acc["out"]) > 0) & (strip(F.try_element_at(acc["out"], F.lit(-1))) != ""), F.array(F.lit(""))).otherwise(none)
        put = F.when(title, F.concat(acc["out"], before, F.array(line), F.array(F.lit("")))).otherwise(F.concat(acc["out"], F.array(line)))
        return F.struct(put.alias("out"), title.alias("title"))

    def finish(acc: Column) -> Column:
        return F.when(acc["title"], F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"])

    return unlines(F.aggregate(lines(t), start, step, finish))


def normalize_sentences(t: Column) -> Column:
    return space_section_titles(normalize_bullets(clean_columns(fix_broken_sentences(merge_hyphenated_words(t)))))


# ----------------------------------------------------------- OCR (T18 to T22)


def _similar(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def drop_ocr_lines(text: str, threshold: float = 0.9) -> str:
    kept: list[str] = []
    last = None
    for line in text.split("\n"):
        bare = line.strip().lower()
        if bare and last is not None and _similar(bare, last) >= threshold:
            continue
        last = bare or None
        kept.append(line)
    return "\n".join(kept)


def remove_duplicated_ocr_lines(t: Column, threshold: float = 0.9) -> Column:
    """A line is compared with the last line kept, a state that only a fold has;
    in the JVM it would copy all lines for each line, so this is an Arrow UDF."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else drop_ocr_lines(x, threshold))

    return run(t)


def fix_ligatures(t: Column, table: dict[str, str] = P.LIGATURES) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), table.items(), t)


def fix_ocr_confusion(t: Column) -> Column:
    return reduce(lambda acc, p: sub(acc, p[0], p[1]), P.OCR_CONFUSIONS, t)


def remove_weird_chars(t: Column) -> Column:
    return sub(t, P.WEIRD_CHARS)


def correct_ocr(t: Column) -> Column:
    return remove_weird_chars(fix_ocr_confusion(fix_ligatures(remove_duplicated_ocr_lines(t))))


# -------------------------------------------------------- domain (T23 to T27)


def remove_disclaimers(t: Column, custom: Iterable[str] = ()) -> Column:
    return reduce(lambda acc, p: sub(acc, p, "", "is"), [*P.DISCLAIMERS, *custom], t)


def normalize_dates(t: Column) -> Column:
    return reduce(lambda acc, p: sub(acc, p[1], p[2], p[0]), P.DATES, t)


def normalize_numbers(t: Column) -> Column:
    """Accepted for completeness; numbers stay as they are."""
    return t


def normalize_domain(t: Column) -> Column:
    return normalize_numbers(normalize_dates(remove_disclaimers(t)))


def normalize_text(t: Column, structure: bool = True, noise: bool = True, ocr: bool = True, sentences: bool = True, domain: bool = True) -> Column:
    for wanted, f in ((structure, normalize_structure), (noise, remove_noise), (ocr, correct_ocr), (sentences, normalize_sentences), (domain, normalize_domain)):
        t = f(t) if wanted else t
    return strip(t)


# ------------------------------------------------- for functions over batches


def compiled(flagged: Iterable[tuple[str, str]]) -> Iterator[re.Pattern]:
    """The same patterns for Python's engine."""
    for flags, p in flagged:
        yield re.compile(p, sum(getattr(re, f.upper()) for f in flags))
