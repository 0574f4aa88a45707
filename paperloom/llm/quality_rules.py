"""Quality rules as a short-circuit cascade.

Counts every rule needs (words, characters in words, symbols, repeated lines,
words in repeated 8-word windows) are taken over whole texts, a slice of
documents at a time. Documents that pass the base rule go through a cascade of
further rules; a document leaves at the first rule that rejects it.

The order of the rules is chosen before the run: each rule's cost (seconds per
document) and selectivity (share rejected) are measured on a sample of at most
``sample_rows`` documents, and rules run by falling rejection per cost. The
rules are pure and joined by "and", so the sample decides only the speed, never
a verdict.

Edge cases: a null or empty text has no words and fails the base rule; repeated
rows are judged alike; an empty table gives an empty result; other columns are
ignored. Memory follows a slice of text or one longer document.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Rolling, doc_of, mix, pick, slices, spans, sums, word_hashes, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_WINDOWS = Rolling(0x8CB92BA72F3D8DD7)
_ODD = np.uint64(0x9E3779B97F4A7C15)
REPEAT = 8


def _within(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made distinct by document."""
    return mix(values ^ (doc.astype(np.uint64) * _ODD))


@dataclass
class Texts:
    """A slice of documents and what the base rule has counted."""

    data: np.ndarray
    offs: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_lines: np.ndarray
    n_repeat_words: np.ndarray

    @classmethod
    def read(cls, data: np.ndarray, offs: np.ndarray) -> Texts:
        s, e, begins = words(data, offs)
        inside = np.zeros(len(data) + 1, np.int64)
        np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data], out=inside[1:])
        ls, le, lbegins = spans(data != 10, offs)
        full = np.searchsorted(s, le) > np.searchsorted(s, ls)
        line_doc = doc_of(lbegins)
        key = _within(word_hashes(data, ls, le), line_doc)
        later = np.ones(len(ls), dtype=bool)
        later[np.unique(key, return_index=True)[1]] = False
        h = word_hashes(data, s, e)
        g = _WINDOWS.grams(_WINDOWS.prefix(h), REPEAT)
        ends = np.repeat(begins[1:], np.diff(begins))
        at = np.flatnonzero(np.arange(len(g)) + REPEAT <= ends[: len(g)])
        word_doc = doc_of(begins)
        _, inverse, count = np.unique(_within(g[at], word_doc[at]), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + REPEAT, -1)
        return cls(data, offs, np.diff(begins), inside[offs[1:]] - inside[offs[:-1]], sums(SYMBOLS[data], offs), sums(later & full, lbegins), sums(full, lbegins), sums(np.cumsum(cover)[:-1] > 0, begins))

    def take(self, keep: np.ndarray) -> Texts:
        at = np.flatnonzero(keep)
        parts = [self.data[self.offs[i] : self.offs[i + 1]] for i in at]
        offs = np.zeros(len(at) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offs[1:])
        rest = [getattr(self, k)[at] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")]
        return Texts(np.concatenate(parts) if parts else self.data[:0], offs, *rest)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


# ---------------------------------------------------------------------- rules

Rule = Callable[[Texts], np.ndarray]


def too_many_symbols(t: Texts) -> np.ndarray:
    """Over one symbol for five words."""
    return 5 * t.n_symbols > t.n_words


def odd_word_length(t: Texts) -> np.ndarray:
    """Mean word length outside 2 to 14 characters."""
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)


def repeated_lines(t: Texts) -> np.ndarray:
    """Over three tenths of the lines equal an earlier one."""
    return 10 * t.n_dup_lines > 3 * t.n_lines


def shouting(t: Texts) -> np.ndarray:
    """Over half of the ASCII letters are capitals."""
    return 2 * sums(_UPPER[t.data], t.offs) > sums(_LETTER[t.data], t.offs)


def exclaiming(t: Texts) -> np.ndarray:
    """Over one exclamation mark for five words."""
    return 5 * sums(t.data == 33, t.offs) > t.n_words


RULES: tuple[Rule, ...] = (too_many_symbols, odd_word_length, repeated_lines, shouting, exclaiming)


def cascade(t: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """True for documents that no rule rejects. Later rules see only documents
    still alive, once enough have left for the copy to pay."""
    kept = np.ones(len(t.n_words), dtype=bool)
    alive, rest = np.arange(len(t.n_words)), t
    for rule in rules:
        if not len(alive):
            break
        if 4 * kept[alive].sum() <= 3 * len(alive):
            rest = rest.take(kept[alive])
            alive = alive[kept[alive]]
        kept[alive[rule(rest)]] = False
    return kept


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> tuple[Rule, ...]:
    """Rules by falling share rejected per second, from a sample of the texts."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in slices(batch):
                t = Texts.read(data, offs)
                t = t.take(~t.base_failed)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    out = int(rule(t).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([time.perf_counter() - began]), pa.array([out])], ["rule", "seconds", "rejected"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).limit(sample_rows)
    seen = sample.mapInArrow(measure, "rule long, seconds double, rejected long").groupBy("rule").agg(F.sum("rejected").alias("n"), F.sum("seconds").alias("s")).collect()
    gain = {r["rule"]: r["n"] / max(r["s"], 1e-9) for r in seen}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 512) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept."""
    source = pick(docs, doc_id=doc_id, text=text)
    ordered = plan(source.select("text"), rules, sample_rows)
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch):
                t = Texts.read(data, offs)
                failed = t.base_failed
                kept = np.zeros(len(failed), dtype=bool)
                kept[~failed] = cascade(t.take(~failed) if failed.any() else t, ordered)
                counts = [pa.array(x.astype(np.int64)) for x in (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *counts, pa.array(failed), pa.array(kept)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return source.mapInArrow(judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
lines AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM lines GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS le, length(regexp_replace(t, '[^!]', '', 'g')) AS ex
  FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN ln ON w.r = ln.r),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * up > le OR 5 * ex > n_words) AS kept
FROM b
"""
