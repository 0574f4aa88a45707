"""From documents to vectors in one plan, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import ServiceConfig
from paperloom.functions.extract import page_metadata

from . import chunk as C
from . import pages as N
from . import prepare as E
from .search import HashingEmbedder, embed, knn
from .store import Collections


def normalized_or_raw(pages: DataFrame, config: ServiceConfig) -> DataFrame:
    """Pages to chunk: the normalised ones, or a document's raw text as page 1
    where normalising left nothing of it."""
    done = N.normalize_pages(page_metadata(pages), config.normalize, dropped=True)
    document = Window.partitionBy("doc_id")
    some = F.max(F.length("normalized_text") > 0).over(document)
    rows = done.select("doc_id", "file_name", "page_number", "text", "normalized_text", F.coalesce(some, F.lit(False)).alias("some"))
    page = F.when(~F.col("some"), F.struct("page_number", "text"))  # nothing is gathered of other documents
    rows = rows.withColumns({"at": F.row_number().over(document.orderBy("page_number")), "raw": F.collect_list(page).over(document)})
    raw = F.array_join(F.transform(F.array_sort("raw"), lambda x: x["text"]), "\n\n")
    kept = rows.where(F.when(F.col("some"), F.col("normalized_text").isNotNull()).otherwise(F.col("at") == 1))
    return kept.select("doc_id", "file_name", F.when(F.col("some"), F.col("page_number")).otherwise(1).alias("page_number"), F.when(F.col("some"), F.col("normalized_text")).otherwise(raw).alias("text"))


def ingest(pages: DataFrame, config: ServiceConfig = ServiceConfig(), custom: dict[str, str] | None = None) -> DataFrame:
    """Embedding records of ``pages`` (doc_id, file_name, page_number, text)."""
    chunks = C.chunk(normalized_or_raw(pages, config), config.chunk, config.prepare.created_at)
    return E.prepare(chunks, config.prepare, custom)


def ingest_report(pages: DataFrame, config: ServiceConfig = ServiceConfig()) -> DataFrame:
    """Counts per document; documents without chunks are reported too."""
    chunks = C.chunk(normalized_or_raw(pages, config), config.chunk, config.prepare.created_at)
    stats = E.dedup_stats(E.with_hash(chunks, config.prepare).select("doc_id", "embedding_hash"))
    n = pages.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "file_name").agg(F.count(F.lit(1)).alias("pages_extracted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return n.join(stats, "doc_id", "left").select(
        "doc_id", "file_name", "pages_extracted", zero(F.col("total_chunks")).alias("chunks_created"), zero(F.col("unique_chunks")).alias("unique_chunks"), zero(F.col("duplicate_chunks")).alias("duplicates_removed"), F.lit(True).alias("success")
    )


def batch_summary(report: DataFrame) -> DataFrame:
    """One row for a batch, from ``ingest_report``: documents, successful and failed
    ones, and the sums of the counts (0 for an empty batch)."""
    good = F.coalesce(F.col("success"), F.lit(False)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = ("pages_extracted", "chunks_created", "unique_chunks", "duplicates_removed")
    return report.agg(F.count(F.lit(1)).alias("documents"), total(good).alias("successful"), total(1 - good).alias("failed"), *[total(c).alias(c) for c in counts])


def store(pages: DataFrame, config: ServiceConfig = ServiceConfig(), embedder=None, custom: dict[str, str] | None = None) -> dict[str, int]:
    """Ingest and load a collection, made if missing."""
    collections = Collections(pages.sparkSession, config.store_path)
    collections.create(config.collection, config.vector_size, config.distance)
    recs = embed(ingest(pages, config, custom), "embedding_input_text", embedder or HashingEmbedder(config.vector_size))
    return collections.upsert(config.collection, E.payload(recs, "embedding"))


def search(spark, query: str, config: ServiceConfig = ServiceConfig(), limit: int = 10, filters: dict | None = None, threshold: float | None = None, embedder=None) -> DataFrame:
    """point_id, score, text and metadata of the nearest chunks."""
    collections = Collections(spark, config.store_path)
    vector = (embedder or HashingEmbedder(config.vector_size)).encode([query])[0].tolist()
    hits = knn(collections.points(config.collection), vector, limit, collections.describe(config.collection).distance, filters, threshold)
    return hits.select("point_id", "score", "text", "metadata")
