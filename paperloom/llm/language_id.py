"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a linear classifier over
hashed byte n-grams, trained by stochastic gradient descent on the logistic
loss, tells languages with the bit from those without. A text's language is the
codeword of least loss, where each bit's logistic loss counts by how well that
classifier did on its sample. Texts whose two nearest codewords lie close are
flagged as ambiguous.

Learns from about ``per_language`` documents of each language, chosen by a hash
of the id, outside fold 0; whole texts are used both to learn and to predict;
language, source and id are not inputs. With up to seven languages the code is
exhaustive (every split of the languages), beyond that random with
``15 log2(languages)`` bits.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows
with a null language or id are not learned from; without any language to learn
all are ``und``; with one language every other text has it with score 1;
repeated rows are judged alike; a null id is in no fold.
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

BITS, GRAMS = 15, (3, 4)
UND = "und"


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of bits as +1 and -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, width, best = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n))), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        split = np.abs(code.sum(0)) < n
        apart = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if split.all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def predict(self, data: np.ndarray, offs: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score and ambiguity of each text."""
        z = mean_weights(data, offs, self.weights, BITS, False, GRAMS) + self.bias
        loss = np.zeros((len(z), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -z * word) @ self.trust
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        score = p[np.arange(len(z)), best]
        second = np.sort(loss, 1)[:, 1] if loss.shape[1] > 1 else np.full(len(z), np.inf)
        return best, score, second - loss[np.arange(len(z)), best] < margin


def _train(rows: list[tuple], epochs: int, rate: float, seed: int) -> LanguageModel | None:
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    code = codewords(len(languages))
    of = {x: k for k, x in enumerate(languages)}
    weights, bias = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    rng, steps, k = np.random.default_rng(seed), epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, _, idx, share = rows[i]
            word = code[of[label]]
            lr = rate * (1 - k / steps)
            k += 1
            z = share @ weights[idx] + bias
            slope = -word / (1 + np.exp(word * z))
            weights[idx] -= (lr * len(idx) ** 0.5) * share[:, None] * slope[None, :].astype(np.float32)
            bias -= 0.1 * lr * slope
    wrong = np.full(code.shape[1], 0.5)
    for label, _, idx, share in rows:
        wrong += (share @ weights[idx] + bias) * code[of[label]] <= 0
    odds = np.log((len(rows) + 1 - wrong) / wrong)
    return LanguageModel(languages, code, weights, bias, np.maximum(odds, 0) / max(odds.clip(0).mean(), 1e-9))


def train_language(docs: DataFrame, per_language: int = 400, epochs: int = 6, rate: float = 8.0, seed: int = 3) -> LanguageModel | None:
    """``docs``: doc_id, text, lang. Learns outside fold 0."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id") != 0)).select(F.col("lang").alias("label"), F.col("doc_id").alias("key"), "text")
    sample, _ = sample_by_label(known, "label", "key", per_language)
    return _train(collect_features(sample, BITS, False, GRAMS), epochs, rate, seed)


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = 0.5, **training) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    source = pick(docs, doc_id=doc_id, text=text, lang=lang)
    model = train_language(source, **training)
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages if model else []), UND], dtype=object)
        for batch in batches:
            for rows, data, offs in slices(batch):
                n = rows.num_rows
                best, score, close = model.predict(data, offs, margin) if model else (np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool))
                letters = rows.column(3).to_numpy(zero_copy_only=False) & (model is not None)
                pred = names[np.where(letters, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close & letters)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    ready = source.select("doc_id", "text", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return ready.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
