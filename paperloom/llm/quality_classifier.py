"""Quality classifier: supervised subword embeddings.

Words and byte n-grams are hashed to learned vectors, averaged per document and
put through a softmax; vectors and output are trained together by stochastic
gradient descent in numpy, one document a step. It learns from at most about
``per_class`` labelled documents of each class, chosen by a hash of the id;
whole texts are used both to learn and to score. The softmax of an average is
linear in the vectors, so scoring adds one number per feature.

A document's labels, language, source and id are not inputs. Rows whose id
falls in fold 0 are never learned from. Edge cases: a null or empty text has no
features and gets the score of the bias alone; labels that are null or have a
null id are ignored, of several labels of one id the greatest counts; without
labels of both classes every score is the share of label 1 (0.5 without any);
repeated rows score alike; a null id is in no fold; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, pick, slices
from .features import collect_features, mean_weights, sample_by_label

BITS, DIM, GRAMS = 17, 8, (3, 4)


@dataclass
class QualityModel:
    weights: np.ndarray  # buckets x 1: what a feature adds to the log-odds
    bias: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = mean_weights(data, offs, self.weights, BITS, True, GRAMS)[:, 0] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(rows: list[tuple], priors: dict, epochs: int, rate: float, seed: int) -> QualityModel:
    n = {y: sum(1 for r in rows if r[0] == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        share = np.clip((priors.get(1, 0) + 0.5) / (sum(priors.values()) + 1), 1e-3, 1 - 1e-3)
        return QualityModel(np.zeros((1 << BITS, 1), np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, k = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, _, idx, share = rows[i]
            lr = rate * (1 - k / steps)
            k += 1
            hidden = share @ vectors[idx]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            vectors[idx] -= (lr * len(idx) ** 0.5) * share[:, None] * grad[None, :]
    shift = np.log(priors[1] / priors[0] * n[0] / n[1])  # the sample is balanced, the corpus is not
    return QualityModel((vectors @ (out[:, 1] - out[:, 0]))[:, None].astype(np.float32), float(bias[1] - bias[0] + shift))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> QualityModel:
    """``docs``: doc_id, text. ``labels``: doc_id, quality. Learns outside fold 0."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of("doc_id") != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    sample, priors = sample_by_label(known, "label", "doc_id", per_class)
    texts = docs.join(F.broadcast(sample), "doc_id").select("label", F.col("doc_id").alias("key"), "text")
    return _train(collect_features(texts, BITS, True, GRAMS), priors, epochs, rate, seed)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, **training) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    source = pick(docs, doc_id=doc_id, text=text)
    model = train_quality(source, pick(labels, doc_id=doc_id, quality=label), **training)
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch):
                score = model.score(data, offs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.withColumn("held_out", F.coalesce(fold_of("doc_id") == 0, F.lit(False))).mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``; of
    several columns of one name the first counts."""
    names = docs.columns
    flat, column = docs.toDF(*[f"_{i}" for i in range(len(names))]), f"_{names.index('text')}"
    model = train_quality(pick(docs, doc_id="doc_id", text="text"), pick(labels, doc_id="doc_id", quality="quality"), **training)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, column):
                yield rows.filter(pa.array(model.score(data, offs) >= threshold))

    return flat.mapInArrow(judge, flat.schema).toDF(*names)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
