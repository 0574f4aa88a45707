"""The bound on learned documents' spans is a parameter."""

import numpy as np

from paperloom.llm import pii


def test_long_documents_are_learned_from_if_asked(spark):
    docs = spark.createDataFrame([(" ".join(f"mail u{k}@mail.example.org or 10.0.0.{k % 250}" for k in range(1100)),)], "text string")
    plain = pii.fit_crf([])
    assert np.array_equal(pii.train_pii(docs).node, plain.node)
    assert not np.array_equal(pii.train_pii(docs, sample_spans=10_000).node, plain.node)
