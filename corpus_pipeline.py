"""Corpus preparation: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; between stages the driver writes Parquet and reads it again, so a stage's
input reads the same however often it is read.

1. ``quality``: documents the classifier scores under 0.3 go.
2. ``near_duplicates``: of documents linked by a similarity of 0.8 or more (five-word
   shingles) the one of least id stays.
3. ``decontaminate``: documents in which a benchmark window occurs go.
4. ``secrets``: secrets are replaced by a mark; no document goes.
5. ``packing``: pieces of documents and their place in sequences.

Each stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate as _decontaminate
from paperloom.llm import packing as _packing
from paperloom.llm import quality_classifier as _quality
from paperloom.llm import secrets as _secrets
from paperloom.llm import similar as _similar
from paperloom.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _similar.keep_dissimilar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack(docs, _packing.word_bpe_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: A learned model and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
