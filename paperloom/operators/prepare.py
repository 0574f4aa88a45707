"""Embedding records: cleaning, hashes, deduplication, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import PrepareConfig
from paperloom.functions import patterns as P
from paperloom.functions.text import lines, rx, strip, sub, unlines


def clean_for_embedding(t: Column, aggressive: bool = False) -> Column:
    for p in (*P.MARKS, P.CONTROL):
        t = sub(t, p)
    t = sub(sub(t, r"\s{3,}", " "), r"\n{3,}", "\n\n")
    for p, to in P.MARKDOWN if aggressive else ():
        t = sub(t, p, to)
    return unlines(F.transform(lines(strip(t)), strip))


def content_hash(t: Column, algorithm: str = "sha256") -> Column:
    plain = F.regexp_replace(strip(F.lower(t)), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.md5(plain) if algorithm == "md5" else F.sha1(plain) if algorithm == "sha1" else F.sha2(plain, 256)


def ngram_hash(t: Column, n: int = 3) -> Column:
    """Hash of the sorted hashes of the word n-grams; of nothing for fewer words."""
    words = F.regexp_extract_all(F.lower(t), F.lit(rx(r"\S+")), F.lit(0))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, F.lit(n)), " ")), 1, 8))
    # bound to a lambda's variable, the words are found once and not once for each n-gram
    return F.transform(F.array(words), lambda w: F.sha2(F.when(F.size(w) >= n, F.array_join(F.array_sort(grams(w)), "")).otherwise(""), 256))[0]


def with_hash(chunks: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    cleaned = chunks.withColumn("embedding_input_text", clean_for_embedding(F.col("normalized_text"), config.aggressive))
    t = F.col("embedding_input_text")
    return cleaned.withColumn("embedding_hash", ngram_hash(t) if config.ngram_hash else content_hash(t, config.hash_algorithm))


def first_wins(rows: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """The first chunk of each hash, within its document or the corpus.

    A hash may be very frequent: of each the first row is kept within every
    partition before rows are shuffled (a group limit of the window)."""
    if not config.deduplicate:
        return rows
    within = ("doc_id", "embedding_hash") if config.dedup_scope == "document" else ("embedding_hash",)
    order = Window.partitionBy(*within).orderBy("doc_id", "chunk_index")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dedup_stats(rows: DataFrame) -> DataFrame:
    """Totals per document."""
    per = rows.groupBy("doc_id", "embedding_hash").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("doc_id").agg(F.sum("n").alias("total_chunks"), F.count(F.lit(1)).alias("unique_chunks"))
    rate = F.coalesce(F.try_divide((F.col("total_chunks") - F.col("unique_chunks")) * 100.0, F.col("total_chunks")), F.lit(0.0))
    return out.withColumn("duplicate_chunks", F.col("total_chunks") - F.col("unique_chunks")).withColumn("deduplication_rate", rate)


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """doc_id, embedding_hash and chunk_ids (first one first) of repeated hashes."""
    ids = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))
    out = rows.groupBy("doc_id", "embedding_hash").agg(ids.alias("c")).where(F.size("c") > 1)
    return out.select("doc_id", "embedding_hash", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))


def file_type(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^.]+)$", 1)


def records(rows: DataFrame, config: PrepareConfig = PrepareConfig(), custom: dict[str, str] | None = None) -> DataFrame:
    """Embedding records of hashed (and deduplicated) chunks."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    at = F.row_number().over(order) - 1
    path = F.array_join("heading_path", " > ")
    has_urls = F.size("urls_in_chunk") > 0
    meta = F.struct(
        F.struct("doc_id", "file_name", file_type(F.col("file_name")).alias("file_type")).alias("source"),
        F.struct(F.col("page_number_start").alias("page_start"), F.col("page_number_end").alias("page_end"), "chunk_index", "total_chunks").alias("location"),
        F.struct("section_title", "heading_path", F.size("heading_path").alias("level")).alias("hierarchy"),
        F.struct(F.col("chunk_char_len").alias("char_length"), F.col("chunk_word_count").alias("word_count"), F.col("chunk_token_count").alias("token_count"), "boundary_type", "has_overlap").alias("content"),
        F.struct("contains_tables", "contains_code", "contains_bullets", has_urls.alias("has_urls")).alias("flags"),
        F.struct("created_at").alias("timestamps"),
        (F.create_map(*[F.lit(x) for kv in sorted(custom.items()) for x in kv]) if custom else F.create_map().cast("map<string,string>")).alias("custom"),
    )
    return rows.withColumns(
        {
            "embedding_id": F.format_string("%s_emb_%04d", F.col("doc_id"), at),
            "heading_path_str": path,
            "has_urls": has_urls,
            "embedding_metadata": meta,
            "version": F.lit(config.version),
            "processing_pipeline": F.lit(config.pipeline),
        }
    )


def prepare(chunks: DataFrame, config: PrepareConfig = PrepareConfig(), custom: dict[str, str] | None = None) -> DataFrame:
    return records(first_wins(with_hash(chunks, config), config), config, custom)


def payload(recs: DataFrame, *more: str) -> DataFrame:
    """The full payload, 28 columns, and ``more`` columns of the records."""
    a, b = F.col("page_number_start"), F.col("page_number_end")
    return recs.select(
        "chunk_id", "embedding_id", "embedding_hash", "doc_id", "file_name", a.alias("page_start"), b.alias("page_end"), F.concat_ws("-", a.cast("string"), b.cast("string")).alias("page_range"),
        F.coalesce("section_title", F.lit("")).alias("section_title"), "heading_path", "heading_path_str", F.size("heading_path").alias("hierarchy_level"), "chunk_index", "total_chunks",
        F.col("chunk_char_len").alias("char_len"), F.col("chunk_word_count").alias("word_count"), F.coalesce("chunk_token_count", F.lit(0)).alias("token_count"), "boundary_type", "has_overlap",
        "contains_tables", "contains_code", "contains_bullets", "has_urls", F.col("embedding_input_text").alias("text"), F.col("embedding_metadata").alias("metadata"), "version", "created_at", F.col("processing_pipeline").alias("pipeline"), *more,
    )


def flat_payload(recs: DataFrame) -> DataFrame:
    """The flat payload, 15 columns."""
    return payload(recs).select("chunk_id", "embedding_hash", "doc_id", "file_name", "page_start", "page_end", "section_title", "heading_path_str", "chunk_index", "word_count", "boundary_type", "contains_tables", "contains_code", "text", "version")


def csv_rows(recs: DataFrame) -> DataFrame:
    cut = F.substring("embedding_input_text", 1, 500).alias("embedding_input_text")
    return recs.select("chunk_id", "embedding_id", "embedding_hash", "doc_id", "file_name", F.col("page_number_start").alias("page_start"), F.col("page_number_end").alias("page_end"), F.coalesce("section_title", F.lit("")).alias("section_title"), "heading_path_str", "chunk_index", F.col("chunk_word_count").alias("word_count"), "contains_tables", "contains_code", "contains_bullets", cut)
