"""Registered queries and the SQL each of them is held against.

Most queries run on *decorated* pages: two pages per document, with headings,
lists, tables, code, links and line-end variants built around the document's text
by one SQL text that both engines understand. The first page holds the first half
of the text, the second page the rest (a null text is empty); every seventh
document has a third page, which repeats the whole text of the document before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import ChunkConfig, NormalizeConfig, PrepareConfig, ServiceConfig
from paperloom.functions import extract as X
from paperloom.functions import text as T
from paperloom.operators import chunk as C
from paperloom.operators import ingest as O
from paperloom.operators import pages as N
from paperloom.operators import prepare as E
from paperloom.operators import search as V

FLAGSHIP = "flagship_chunks"

DECORATED = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text FROM {documents})
SELECT doc_id, page_number, file_name, CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text FROM (
SELECT doc_id, 1 AS page_number, 'doc' || CAST(doc_id AS STRING) || '.txt' AS file_name,
  'OVERVIEW OF RESULTS' || chr(10) || chr(10) || chr(10) || chr(10) || left(text, CAST(floor(length(text) / 2) AS INT)) || chr(10) || chr(10) || 'See https://example.com/d/' || CAST(doc_id AS STRING) || ' and write to user' || CAST(doc_id AS STRING)
  || '@example.org today.' || chr(10) || 'Page 1' || chr(10) || 'confidential' || chr(10) || 'On March  5 2024 or 12-31-2023 the 5th 0CR l1ne ended.' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Contents of it ........ 12' ELSE '' END AS text FROM w
UNION ALL
SELECT doc_id, 2 AS page_number, 'doc' || CAST(doc_id AS STRING) || '.txt' AS file_name,
  '1. Title of ' || CAST(doc_id AS STRING) || chr(10) || '- first  item' || chr(10) || '* second item' || chr(10) || '3) third item' || chr(10) || '| a | b |' || chr(10) || '```' || chr(10) || 'def f(): pass' || chr(10) || '```' || chr(10)
  || 'an exam-' || chr(10) || '  ple of ﬁne æther' || chr(10) || '© 2024 Some House' || chr(10) || 'left part      right part' || chr(10) || '2' || chr(10) || chr(10) || 'DISCLAIMER: none of it counts.' || chr(10) || chr(10) || substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS text FROM w
UNION ALL
SELECT doc_id + 1 AS doc_id, 3 AS page_number, 'doc' || CAST(doc_id + 1 AS STRING) || '.txt' AS file_name, text FROM w WHERE (doc_id + 1) % 7 = 0
) d
"""
_SQL_PAGES = DECORATED.format(documents="documents")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DECORATED, documents=_docs(spark, sf_dir))


def _text_query(f: Callable[[Column], Column]):
    return lambda pages: pages.select("doc_id", "page_number", f(F.col("text")).alias("out"))


def _text_sql(expression: str) -> str:
    return f"WITH p AS ({_SQL_PAGES}) SELECT doc_id, page_number, {expression} AS out FROM (SELECT *, regexp_extract_all(lower(text), '\\S+') AS words FROM p)"


def _chain(*steps: tuple[str, str]) -> str:
    out = "text"
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return out


_W, _S = r"[\pL\pN_]", r"[\s\x0b\x1c-\x1f]"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_ALL = lambda p, x="text": f"regexp_extract_all({x}, '{p}')"
_SET = lambda x: f"array_to_string(list_sort(list_distinct({x})), chr(31))"
_JOINED = lambda c: F.array_join(c, "\x1f")
_HEADING = r"^[A-Z][A-Z\s]{5,}$|^(?i:(?:Chapter|Section|Part)\s+\d+[:\s])|^\d+\.\s+[A-Z][a-zA-Z\s]{3,}$|^\d+\.\d+\s+[A-Z][a-zA-Z\s]{3,}$"
_HEADINGS = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {_STRIP('l')}), lambda l: length(l) >= 5 AND regexp_matches(l, '{_HEADING}'))"
_TOC = r"regexp_matches(text, '(?i)table\s+of\s+contents') OR regexp_matches(text, '\.{3,}') OR regexp_matches(text, '(?m)^\d+\.\d+\s+.+\s+\d+\s*$')"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_BULLET_SQL = r"""array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE
 WHEN regexp_matches(l, '^\s*[•·∙●○◦▪▫■□]\s*') THEN regexp_replace(l, '^\s*[•·∙●○◦▪▫■□]\s*', '• ')
 WHEN regexp_matches(l, '^\s*[*\-+]\s+') THEN regexp_replace(l, '^\s*[*\-+]\s+', '• ')
 WHEN regexp_matches(l, '^\s*\d+[.)]\s+') THEN regexp_replace(l, '^\s*\d+[.)]\s+', '• ')
 WHEN regexp_matches(l, '^(?i)\s*[a-z][.)]\s+') THEN regexp_replace(l, '^(?i)\s*[a-z][.)]\s+', '• ') ELSE l END), chr(10))"""
_LIG = "text"
for _a, _b in T.P.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"

#: name: (Spark column, DuckDB expression or None)
TEXT: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "extract_urls": (lambda t: _JOINED(X.extract_urls(t)), _SET(_ALL(r"(?i)(?:https?|ftp)://\S+|www\.\S+"))),
    "extract_emails": (lambda t: _JOINED(X.extract_emails(t)), _SET(_ALL(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"))),
    "extract_headings": (lambda t: _JOINED(X.extract_headings(t)), _SET(_HEADINGS)),
    "detect_toc": (X.detect_toc, f"({_TOC})"),
    "urls_in_order": (lambda t: _JOINED(X.urls_in_order(t)), f"array_to_string({_ALL(r'https?://\S+')}, chr(31))"),
    "char_count": (lambda t: F.length(t).cast("long"), "CAST(length(text) AS BIGINT)"),
    "word_count": (lambda t: T.word_count(t).cast("long"), rf"CAST(len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f]+')) AS BIGINT)"),
    "detect_columns": (X.detect_columns, r"(len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 40 AND regexp_matches(l, '\s{4,}'))) > len(string_split(text, chr(10))) * 0.3)"),
    "line_breaks": (T.normalize_line_breaks, _chain((r"\r\n?", "chr(10)"))),
    "hyphen_breaks": (T.remove_hyphen_line_breaks, _chain((rf"({_W}+)-\s*\n\s*({_W}+)", r"'\1\2'"))),
    "collapse_spaces": (T.collapse_whitespace, _chain((r"[ \t]+", "' '"))),
    "collapse_blank_lines": (T.collapse_blank_lines, _chain((r"\n\s*\n\s*\n+", "chr(10) || chr(10)"))),
    "unicode_nfkc": (T.unicode_normalize, None),
    "structure_all": (T.normalize_structure, None),
    "headers_footers": (T.remove_headers_footers, _chain((r"(?im)^\s*(?:confidential|proprietary|draft|internal use only)\s*$", "''"), (r"(?m)^\s*©\s*\d{4}.*$", "''"), (r"(?m)^\s*\d{4}\s*©.*$", "''"))),
    "page_numbers": (T.remove_page_numbers, _chain((r"(?m)^\s*-?\s*\d+\s*-?\s*$", "''"), (r"(?im)^\s*Page\s+\d+\s*$", "''"), (r"(?im)^\s*\d+\s+of\s+\d+\s*$", "''"))),
    "remove_urls": (T.remove_urls, None),
    "toc_artifacts": (T.remove_toc_artifacts, _chain((r"(?m)^.{5,}\.{3,}\s*\d+\s*$", "''"), (r"(?m)^\d+\.\d+\s+.{5,}\s+\.{3,}\s*\d+\s*$", "''"), (r"(?m)^.{5,}\s{3,}\d+\s*$", "''"))),
    "noise_all": (T.remove_noise, None),
    "broken_sentences": (T.fix_broken_sentences, _chain((r"([a-z,])\n+([A-Z])", r"'\1 \2'"))),
    "merge_hyphens": (T.merge_hyphenated_words, _chain((rf"({_W}+)-\s*\n+\s*({_W}+)", r"'\1\2'"))),
    "column_cleanup": (T.clean_columns, rf"array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '\s{{4,}}') THEN list_filter(list_transform(regexp_split_to_array(l, '\s{{4,}}'), lambda x: {_STRIP('x')}), lambda x: x <> '') ELSE [l] END)), chr(10))"),
    "bullets": (T.normalize_bullets, _BULLET_SQL),
    "section_titles": (T.space_section_titles, None),
    "sentences_all": (T.normalize_sentences, None),
    "ocr_lines": (T.remove_duplicated_ocr_lines, None),
    "ligatures": (T.fix_ligatures, _LIG),
    "ocr_confusion": (T.fix_ocr_confusion, None),
    "weird_chars": (T.remove_weird_chars, None),
    "ocr_all": (T.correct_ocr, None),
    "disclaimers": (T.remove_disclaimers, None),
    "dates": (T.normalize_dates, _chain((r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", r"'\1/\2/\3'"), (rf"(?i)\b({_MONTHS})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", r"'\1 \2, \3'"), (rf"(?i)\b(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})\b", r"'\1 \2 \3'"))),
    "numbers": (T.normalize_numbers, "text"),
    "domain_all": (T.normalize_domain, None),
    "normalize_text": (T.normalize_text, None),
    "page_lines": (N.collapse_lines, rf"array_to_string(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda l: {_STRIP('l')}), chr(10))"),
    "safe_sentences": (N.fix_sentences_safely, _chain((r"(?m)([a-z,;:])\s*\n+\s*([a-z])", r"'\1 \2'"))),
    "safe_ocr": (N.apply_safe_ocr, None),
    "page_bullets": (N.normalize_page_bullets, _chain((r"(?m)^\s*[·∙●○◦▪▫■□]\s+", "'• '"), (r"(?m)^\s*[*\-+]\s+", "'• '"))),
    "clean_for_embedding": (E.clean_for_embedding, None),
    "content_hash": (E.content_hash, rf"sha256(regexp_replace({_STRIP('lower(text)')}, '{_S}+', ' ', 'g'))"),
    "content_hash_md5": (lambda t: E.content_hash(t, "md5"), rf"md5(regexp_replace({_STRIP('lower(text)')}, '{_S}+', ' ', 'g'))"),
    "content_hash_sha1": (lambda t: E.content_hash(t, "sha1"), rf"sha1(regexp_replace({_STRIP('lower(text)')}, '{_S}+', ' ', 'g'))"),
    "ngram_hash": (E.ngram_hash, r"sha256(array_to_string(list_sort(list_transform(range(1, len(words) - 1), lambda i: left(md5(array_to_string(words[i : i + 2], ' ')), 8))), ''))"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def page_query(name: str, sql: str | None = None):
    """Registers a function of decorated pages."""

    def register(f: Callable[[DataFrame], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: f(decorated(spark, sf_dir)))
        return f

    return register


for _name, (_f, _sql) in TEXT.items():
    page_query(_name, _text_sql(_sql) if _sql else None)(_text_query(_f))


# ------------------------------------------------------------------ documents


@page_query("document_rollup", f"""WITH p AS ({_SQL_PAGES}), m AS (SELECT *, {_ALL(r"(?i)(?:https?|ftp)://\S+|www\.\S+")} AS u, ({_TOC}) AS toc, {_HEADINGS} AS h FROM p)
SELECT doc_id, count(*) AS total_pages, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS total_chars, array_to_string(list_sort(list_distinct(flatten(list(u)))), chr(31)) AS all_urls,
array_to_string(list_sort(list_distinct(flatten(list(h)))), chr(31)) AS all_headings, bool_or(toc) AS has_toc, array_to_string(list_sort(list(page_number) FILTER (WHERE toc)), ',') AS toc_pages FROM m GROUP BY doc_id""")
def document_rollup(pages):
    d = X.document_metadata(X.page_metadata(pages))
    toc = F.col("toc_page_numbers").cast("array<string>")
    return d.select("doc_id", "total_pages", "total_chars", _JOINED(F.col("all_urls")).alias("all_urls"), _JOINED(F.col("all_headings")).alias("all_headings"), "has_toc", F.when(F.size(toc) > 0, F.array_join(toc, ",")).alias("toc_pages"))


@page_query("page_range", f"WITH p AS ({_SQL_PAGES}) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM p GROUP BY doc_id")
def page_range(pages):
    return X.page_range(pages, 1, 3)


@page_query("page_filter", f"WITH p AS ({_SQL_PAGES}) SELECT doc_id, page_number FROM p WHERE NOT ({_TOC})")
def page_filter(pages):
    return N.filter_pages(X.page_metadata(pages), NormalizeConfig()).select("doc_id", "page_number")


@page_query("own_page_number", r"WITH p AS (" + _SQL_PAGES + r""") SELECT doc_id, page_number, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*-?\s*' || page_number || '\s*-?\s*$', '', 'g'), '(?im)^\s*Page\s+' || page_number || '\s*$', '', 'g'), '(?im)^\s*' || page_number || '\s+of\s+\d+\s*$', '', 'g') AS out FROM p""")
def own_page_number(pages):
    return pages.select("doc_id", "page_number", N.remove_own_page_number(F.col("text"), F.col("page_number")).alias("out"))


@page_query("listed_urls", f"WITH p AS ({_SQL_PAGES}) SELECT doc_id, page_number, list_reduce(list_prepend(text, list_sort(list_distinct({_ALL(r'(?i)(?:https?|ftp)://\S+|www\.\S+')}))), lambda a, u: replace(a, u, '')) AS out FROM p")
def listed_urls(pages):
    return X.page_metadata(pages).select("doc_id", "page_number", N.remove_listed_urls(F.col("text"), F.col("urls")).alias("out"))


@page_query("normalize_pages")
def normalize_pages(pages):
    out = N.normalize_pages(X.page_metadata(pages))
    return out.select("doc_id", "page_number", "normalized_text", "original_char_count", "normalized_char_count", *[_JOINED(F.col(c)).alias(c) for c in ("removed_urls", "removed_page_numbers", "protected_elements", "changes_applied", "warnings")])


@page_query("normalization_stats")
def normalization_stats(pages):
    return N.normalization_stats(N.normalize_pages(X.page_metadata(pages)))


@page_query("assemble_document")
def assemble_document(pages):
    return N.assemble(N.normalize_pages(X.page_metadata(pages)))


# --------------------------------------------------------------------- chunks


def _plain_pages(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), F.lit(1).alias("page_number"), "text")


_PLAIN = f"""d AS (SELECT doc_id, {_STRIP("coalesce(text, '')")} AS text FROM documents),
c0 AS (SELECT doc_id, 0 AS i, text AS t, 'page' AS k FROM d WHERE length(text) BETWEEN 1 AND 1000 UNION ALL
 SELECT doc_id, i, {_STRIP("substr(text, i + 1, 500)")}, 'paragraph' FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS i FROM d WHERE length(text) > 1000)),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, t, k FROM c0 WHERE t <> '')"""
_TAIL = r"CASE WHEN {t} IS NULL THEN '' WHEN b > 0 AND length({t}) - b <= 100 THEN substr({t}, b + 1) ELSE right({t}, 100) END"
_END = r"greatest(length(regexp_extract({t}, '(?s)^.*[.!?]\s+[A-Z]')) - 1, 0)"
_CHUNKS = f"""{_PLAIN}, l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev FROM c),
o AS (SELECT doc_id, chunk_index, k, {_TAIL.format(t="prev")} AS prefix, t FROM (SELECT *, {_END.format(t="prev")} AS b FROM l)),
f AS (SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, k AS boundary_type, prefix || t AS text, length(prefix) AS overlap_with_previous FROM o)"""


@query("chunk_plain", f"WITH {_PLAIN} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, t AS text, k AS boundary_type FROM c")
def chunk_plain(spark, sf_dir):
    return C.split(_plain_pages(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("base_text").alias("text"), "boundary_type")


@query("chunk_overlap_sentence", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text, CAST(overlap_with_previous AS BIGINT) AS overlap_with_previous FROM f")
def chunk_overlap_sentence(spark, sf_dir):
    return _overlapped(spark, sf_dir, ChunkConfig())


@query("chunk_overlap_character", f"WITH {_PLAIN}, l AS (SELECT *, coalesce(right(lag(t) OVER (PARTITION BY doc_id ORDER BY chunk_index), 100), '') AS p FROM c) SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, p || t AS text, CAST(length(p) AS BIGINT) AS overlap_with_previous FROM l")
def chunk_overlap_character(spark, sf_dir):
    return _overlapped(spark, sf_dir, ChunkConfig(overlap_strategy="character"))


def _overlapped(spark, sf_dir, config):
    out = C.overlap(C.split(_plain_pages(spark, sf_dir), config), config)
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.col("overlap_with_previous").cast("long").alias("overlap_with_previous"))


@page_query("chunk_structured")
def chunk_structured(pages):
    return C.chunk(pages).select("chunk_id", "page_number_start", "section_title", F.array_join("heading_path", " > ").alias("path"), "boundary_type", "normalized_text", "contains_tables", "contains_code", "contains_bullets")


@page_query("chunk_marked_text")
def chunk_marked_text(pages):
    text = N.assemble(N.normalize_pages(X.page_metadata(pages)))
    return C.split_marked(text.withColumn("file_name", F.lit("all.txt"))).select("doc_id", "page_number", "text")


_DESCRIBED = rf"""WITH {_CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, format('{{}}_chunk_{{:04d}}', doc_id, chunk_index) AS chunk_id, CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS total_chunks, CAST(length(text) AS BIGINT) AS chars,
CAST(len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f]+')) AS BIGINT) AS words, boundary_type, text, (contains(text, '|') OR contains(text, '[Table') OR contains(text, '--- TABLES ---')) AS contains_tables,
(contains(text, '```') OR contains(text, 'def ') OR contains(text, 'class ')) AS contains_code FROM f"""


@query("chunk_described", _DESCRIBED)
def chunk_described(spark, sf_dir):
    c = C.chunk(_plain_pages(spark, sf_dir))
    return c.select("doc_id", "chunk_id", F.col("total_chunks").cast("long").alias("total_chunks"), F.col("chunk_char_len").cast("long").alias("chars"), F.col("chunk_word_count").cast("long").alias("words"), "boundary_type", F.col("normalized_text").alias("text"), "contains_tables", "contains_code")


# -------------------------------------------------------- preparation, payload

_CLEAN = rf"""array_to_string(list_transform(string_split({_STRIP("regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '\\s{3,}', ' ', 'g')")}, chr(10)), lambda l: {_STRIP("l")}), chr(10))""".replace("\\\\", "\\")
_HASHED = rf"""{_CHUNKS}, e AS (SELECT *, {_CLEAN} AS input FROM f), hh AS (SELECT *, sha256(regexp_replace({_STRIP("lower(input)")}, '{_S}+', ' ', 'g')) AS h FROM e),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY chunk_index) AS n FROM hh) WHERE n = 1)"""


@query(FLAGSHIP, f"WITH {_HASHED} SELECT CAST(doc_id AS VARCHAR) AS doc_id, format('{{}}_emb_{{:04d}}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1) AS embedding_id, chunk_index, h AS embedding_hash, input AS text FROM u")
def flagship_chunks(spark, sf_dir):
    """Documents to chunks with overlap, cleaned, hashed and deduplicated."""
    r = E.prepare(C.chunk(_plain_pages(spark, sf_dir)))
    return r.select("doc_id", "embedding_id", F.col("chunk_index").cast("long").alias("chunk_index"), "embedding_hash", F.col("embedding_input_text").alias("text"))


@query("dedup_corpus", f"WITH {_HASHED}, g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY CAST(doc_id AS VARCHAR), chunk_index) AS m FROM hh) SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, h AS embedding_hash FROM g WHERE m = 1")
def dedup_corpus(spark, sf_dir):
    config = PrepareConfig(dedup_scope="corpus")
    r = E.first_wins(E.with_hash(C.chunk(_plain_pages(spark, sf_dir)), config), config)
    return r.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "embedding_hash")


@query("dedup_stats", f"WITH {_HASHED} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS total_chunks, count(DISTINCT h) AS unique_chunks, count(*) - count(DISTINCT h) AS duplicate_chunks, round((count(*) - count(DISTINCT h)) * 100.0 / count(*), 6)::DOUBLE AS deduplication_rate FROM hh GROUP BY doc_id")
def dedup_stats(spark, sf_dir):
    return E.dedup_stats(E.with_hash(C.chunk(_plain_pages(spark, sf_dir)))).withColumn("deduplication_rate", F.round("deduplication_rate", 6))


@query("duplicate_groups", f"WITH {_HASHED} SELECT CAST(doc_id AS VARCHAR) AS doc_id, h AS embedding_hash, string_agg(format('{{}}_chunk_{{:04d}}', doc_id, chunk_index), ',' ORDER BY chunk_index) AS chunk_ids FROM hh GROUP BY doc_id, h HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    g = E.duplicate_groups(E.with_hash(C.chunk(_plain_pages(spark, sf_dir))))
    return g.withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def _recs(pages):
    return E.prepare(C.chunk(pages), custom={"origin": "test"})


@page_query("payload_full")
def payload_full(pages):
    return E.payload(_recs(pages)).withColumns({"metadata": F.to_json("metadata"), "heading_path": F.array_join("heading_path", " > ")})


@page_query("payload_flat")
def payload_flat(pages):
    return E.flat_payload(_recs(pages))


@page_query("csv_rows")
def csv_rows(pages):
    return E.csv_rows(_recs(pages))


@page_query("ingest_report")
def ingest_report(pages):
    return O.ingest_report(pages, ServiceConfig())


@query("embed_texts")
def embed_texts(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return V.embed(docs, "text").select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


# ------------------------------------------------------------------ retrieval


def _points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "point_id")


def _first_vector(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").first()[0]


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS point_id, label, CAST(embedding AS DOUBLE[]) AS v, qv FROM embeddings, q)"
_COS = "list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)))"


def _near(name, distance, expression, order, where="TRUE", **kw):
    @query(name, f"WITH {_Q} SELECT point_id, label, round(score, 6) AS score FROM (SELECT point_id, label, {expression} AS score FROM s) WHERE {where} ORDER BY score {order}, point_id LIMIT 10")
    def run(spark, sf_dir):
        return V.knn(_points(spark, sf_dir), _first_vector(spark, sf_dir), 10, distance, **kw).select("point_id", "label", F.round("score", 6).alias("score"))

    return run


_near("knn_cosine", "Cosine", _COS, "DESC")
_near("knn_dot", "Dot", "list_dot_product(v, qv)", "DESC")
_near("knn_euclidean", "Euclidean", "list_distance(v, qv)", "ASC")
_near("knn_filtered", "Cosine", _COS, "DESC", "label = 3", filters={"label": 3})
_near("knn_range", "Cosine", _COS, "DESC", "label >= 2 AND label < 5", filters={"label": {"gte": 2, "lt": 5}})
_near("knn_threshold", "Cosine", _COS, "DESC", "score >= 0.2", threshold=0.2)


@query("knn_each", f"WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS point_id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) SELECT query_id, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def knn_each(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding")
    return V.knn_each(p, q, 10, "Dot").withColumn("score", F.round("score", 6))


def _near_each(name, distance, expression, order, where="TRUE", **kw):
    """A search variant over the stated query set: every row whose id is divisible by 20."""

    @query(name, f"WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS point_id, label, CAST(embedding AS DOUBLE[]) AS v, qv FROM embeddings, q), c AS (SELECT query_id, point_id, label, {expression} AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, point_id) AS rank FROM c WHERE {where}) SELECT query_id, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
    def run(spark, sf_dir):
        p = _points(spark, sf_dir)
        q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "embedding")
        return V.knn_each(p, q, 10, distance, **kw).withColumn("score", F.round("score", 6))

    return run


_near_each("knn_each_cosine", "Cosine", _COS, "DESC")
_near_each("knn_each_euclidean", "Euclidean", "list_distance(v, qv)", "ASC")
_near_each("knn_each_filtered", "Cosine", _COS, "DESC", "label = 3", filters={"label": 3})
_near_each("knn_each_range", "Cosine", _COS, "DESC", "label >= 2 AND label < 5", filters={"label": {"gte": 2, "lt": 5}})
_near_each("knn_each_threshold", "Cosine", _COS, "DESC", "score >= 0.2", threshold=0.2)


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pM\pN\p{Pc}]+'), lambda w: length(w) BETWEEN 2 AND 20)"


@query("match_text", f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'and', 'of']) AND lang = 'en' ORDER BY doc_id LIMIT 10")
def match_text(spark, sf_dir):
    return V.match_text(_docs(spark, sf_dir), "The and, of a", {"lang": "en"}, key="doc_id").select("doc_id")


@query("metadata_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 500 ORDER BY doc_id LIMIT 100 OFFSET 5")
def metadata_scan(spark, sf_dir):
    return V.scan(_docs(spark, sf_dir), {"lang": "de", "n_chars": {"gte": 500}}, offset=5, key="doc_id").select("doc_id", "lang", "n_chars")


@query("metadata_any_of", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') ORDER BY doc_id LIMIT 100")
def metadata_any_of(spark, sf_dir):
    return V.scan(_docs(spark, sf_dir), {"lang": {"in": ["de", "fr"]}}, key="doc_id").select("doc_id", "lang")


@query("metadata_list", "SELECT doc_id, lang FROM documents WHERE lang = 'de' AND lang = 'fr'")
def metadata_list(spark, sf_dir):
    return V.scan(_docs(spark, sf_dir), {"lang": ["de", "fr"]}, key="doc_id").select("doc_id", "lang")


@query("collection_stats", "SELECT label, count(*) AS points_count FROM embeddings GROUP BY label")
def collection_stats(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("points_count"))
