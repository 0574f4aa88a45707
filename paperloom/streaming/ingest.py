"""Files that arrive in a folder are ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import ServiceConfig
from paperloom.operators.ingest import store

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, config: ServiceConfig = ServiceConfig(), embedder=None):
    """Run until all text files in ``path`` are loaded; a later run goes on from
    ``checkpoint`` and loads new files only."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    pages = files.select(F.sha2("path", 256).alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.lit(1).alias("page_number"), F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"))

    def load(batch: DataFrame, _: int) -> None:
        store(batch.where("text is not null"), config, embedder)

    return pages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
