"""Hashed word and character n-gram features of whole texts, and bounded
samples of labelled documents to learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column, text_bytes, word_hashes, words

_SALTS = {3: 0x9E3779B1, 4: 0x85EBCA77}


def gram_features(data: np.ndarray, offs: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n bytes (3 or 4) from each place on, document by document,
    and the index of each document's first feature (docs + 1 values)."""
    m = len(data) - n + 1
    sizes = np.maximum(np.diff(offs) - n + 1, 0)
    begins = np.zeros(len(offs), np.int64)
    np.cumsum(sizes, out=begins[1:])
    if m <= 0:
        return np.zeros(0, np.uint32), begins
    x = data.astype(np.uint32)
    v = x[:m].copy()
    for k in range(1, n):
        v |= x[k : m + k] << np.uint32(8 * k)
    v = (v * np.uint32(_SALTS[n])) >> np.uint32(32 - bits)
    inside = np.ones(m, dtype=bool)
    for k in range(1, n):
        at = offs[1:-1] - k
        inside[at[(at >= 0) & (at < m)]] = False
    return v[inside], begins


def word_features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, begins = words(data, offs)
    return (word_hashes(data, s, e) >> np.uint64(64 - bits)).astype(np.uint32), begins


def features(data: np.ndarray, offs: np.ndarray, bits: int, use_words: bool, grams: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [gram_features(data, offs, n, bits) for n in grams] + ([word_features(data, offs, bits)] if use_words else [])


def mean_weights(data: np.ndarray, offs: np.ndarray, weights: np.ndarray, bits: int, use_words: bool, grams: tuple[int, ...]) -> np.ndarray:
    """Mean of ``weights`` (buckets x k) over each document's features; zero
    for a document without any."""
    total = np.zeros((len(offs) - 1, weights.shape[1]))
    count = np.zeros(len(offs) - 1)
    for f, begins in features(data, offs, bits, use_words, grams):
        some = np.flatnonzero(np.diff(begins))
        count += np.diff(begins)
        if len(some):
            for k in range(weights.shape[1]):
                total[some, k] += np.add.reduceat(weights[:, k][f], begins[some], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None]


def sample_by_label(rows: DataFrame, label: str, key: str, cap: int) -> tuple[DataFrame, dict]:
    """About ``cap`` rows of each label, chosen by a hash of the key, and the
    number of rows of each label."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), int(min(1.0, cap / n) * (1 << 20))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) < share), counts


def collect_features(sample: DataFrame, bits: int, use_words: bool, grams: tuple[int, ...]) -> list[tuple]:
    """(label, key, buckets, shares) of each sampled document, in a fixed order.
    ``sample``: label, key, text. A row holds at most 2^bits buckets, so the
    driver gets a bounded amount whatever the texts' length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, offs = text_bytes(text_column(batch.slice(i, 1)))
                f = np.concatenate([x for x, _ in features(data, offs, bits, use_words, grams)])
                if not len(f):
                    continue
                idx, n = np.unique(f, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([idx.astype(np.int32).tobytes()], pa.binary()), pa.array([(n / n.sum()).astype(np.float32).tobytes()], pa.binary())], ["label", "key", "idx", "share"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    got = sample.select("label", "key", "text").mapInArrow(count, f"label {kinds['label']}, key {kinds['key']}, idx binary, share binary").collect()
    got.sort(key=lambda r: (str(r["key"]), bytes(r["idx"])))
    return [(r["label"], r["key"], np.frombuffer(r["idx"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got]
