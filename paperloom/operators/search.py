"""Embedding of texts and retrieval: vectors, words, metadata."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import rx

DISTANCES = ("Cosine", "Euclidean", "Dot")


class HashingEmbedder:
    """Deterministic feature hashing of words, L2-normalised. It has the shape of
    a sentence encoder, for use where no model is at hand, not its quality."""

    def __init__(self, size: int = 384) -> None:
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.size] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm, norm, 1)


def embed(df: DataFrame, text: str, embedder=None, to: str = "embedding") -> DataFrame:
    """``embedder``: anything with ``encode(list of texts) -> matrix``."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.encode([x or "" for x in s])), index=s.index)

    return df.withColumn(to, run(text))


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda acc, x: acc + x)


def score(a: Column, b: Column, distance: str = "Cosine") -> Column:
    """Similarity, or distance for Euclidean. Unknown names mean Cosine."""
    d = lambda x: x.cast("double")
    if distance == "Euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (d(x) - d(y)) * (d(x) - d(y))))
    dot = _sum(a, b, lambda x, y: d(x) * d(y))
    if distance == "Dot":
        return dot
    return F.try_divide(dot, F.sqrt(_sum(a, a, lambda x, y: d(x) * d(y))) * F.sqrt(_sum(b, b, lambda x, y: d(x) * d(y))))


def where_metadata(filters: dict | None) -> Column:
    """All conditions hold: a dict is a range (gte, lte, gt, lt) or ``in``, a list
    is one equality for each element, anything else an equality."""
    ops = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "in": lambda c, v: c.isin(*v)}
    parts = []
    for key, value in (filters or {}).items():
        c = F.col(key)
        if isinstance(value, dict):
            parts += [ops[k](c, v) for k, v in value.items()]
        elif isinstance(value, (list, tuple)):
            parts += [c == v for v in value]
        else:
            parts.append(c == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def knn(points: DataFrame, query: list[float], limit: int = 10, distance: str = "Cosine", filters: dict | None = None, threshold: float | None = None, vector: str = "embedding", key: str = "point_id") -> DataFrame:
    """The nearest points to one vector; ties by key. The vector is a constant of
    the plan, and only ``limit`` rows leave each task."""
    near = distance == "Euclidean"
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = points.where(where_metadata(filters)).withColumn("score", score(F.col(vector), q, distance)).where("score is not null")
    if threshold is not None:
        hits = hits.where(F.col("score") <= threshold if near else F.col("score") >= threshold)
    return hits.orderBy(F.asc("score") if near else F.desc("score"), key).limit(limit).drop(vector)


def knn_each(points: DataFrame, queries: DataFrame, limit: int = 10, distance: str = "Cosine", vector: str = "embedding", key: str = "point_id", most_queries: int = 10_000, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, key, score and rank of each query's nearest points, among those
    that pass the filters and the threshold. The queries (query_id, vector) are a
    stated set, broadcast in blocks of at most ``most_queries``: consecutive runs
    by query_id (which is unique), whose results are united."""
    near = distance == "Euclidean"
    kept = points.where(where_metadata(filters)).select(key, F.col(vector).alias("_p"))
    asked = queries.select("query_id", F.col(vector).alias("_q"))
    order = Window.partitionBy("query_id").orderBy(F.asc("score") if near else F.desc("score"), key)

    def block(some: DataFrame) -> DataFrame:
        scored = kept.crossJoin(F.broadcast(some)).select("query_id", key, score(F.col("_p"), F.col("_q"), distance).alias("score"))
        if filters or threshold is not None:
            scored = scored.where("score is not null")
        if threshold is not None:
            scored = scored.where(F.col("score") <= threshold if near else F.col("score") >= threshold)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    blocks, rest = [], asked
    while True:
        ends = rest.select("query_id").orderBy(F.asc_nulls_last("query_id")).offset(most_queries - 1).limit(2).collect()
        if len(ends) < 2:
            return reduce(DataFrame.unionByName, [*blocks, block(rest)])
        blocks.append(block(rest.where(F.col("query_id") <= ends[0][0])))
        rest = rest.where((F.col("query_id") > ends[0][0]) | F.col("query_id").isNull())


def tokens(t: Column) -> Column:
    """Lower-cased words of 2 to 20 characters."""
    return F.array_distinct(F.filter(F.split(F.lower(t), rx(r"[^\w]+")), lambda w: F.length(w).between(2, 20)))


def match_text(points: DataFrame, query: str, filters: dict | None = None, limit: int = 10, text: str = "text", key: str = "point_id") -> DataFrame:
    """Points whose text has all words of the query; not ranked, by key."""
    return points.where(where_metadata(filters)).where(F.size(F.array_except(tokens(F.lit(query)), tokens(F.col(text)))) == 0).orderBy(key).limit(limit)


def scan(points: DataFrame, filters: dict | None = None, limit: int = 100, offset: int = 0, key: str = "point_id") -> DataFrame:
    return points.where(where_metadata(filters)).orderBy(key).offset(offset).limit(limit)
