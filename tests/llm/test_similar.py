"""The near-duplicate stage's own bounds: nothing is lost where work is cut into parts."""

import random

import numpy as np
import pytest

from paperloom.llm import common, similar, simhash
from paperloom.llm.trie import TrieJoin


@pytest.fixture(scope="module")
def group():
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(50):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(150)] = f"y{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    return [(k, t, None) for k, t in enumerate(texts)] + [(None, None, "x"), (99, "", "x"), (99, None, "y"), (7, texts[7].upper(), "z")]


def test_bounds_change_no_row(spark, group):
    docs = spark.createDataFrame(group, "doc_id long, text string, TEXT string").repartition(3)
    kept = [sorted(map(tuple, similar.keep_dissimilar(docs, **bound).collect()), key=repr) for bound in ({}, {"most": 5, "most_bytes": 8000})]
    assert kept[0] == kept[1]
    assert [r[0] for r in kept[0] if r[1] in (None, "")] == [99] and len(kept[0]) < len(group)


def test_trie_walks_and_prunes_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toArrow().column("text").combine_chunks()
    v = np.unique(np.concatenate([simhash.fingerprints(*common.text_bytes(rows.slice(k, 200))) for k in range(0, len(rows), 200)]))
    trie = TrieJoin(v, 3)
    got = trie.join()
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    comp = np.arange(len(v))
    while True:
        new = np.where(near, comp[None, :], len(v)).min(1)
        if (new == comp).all():
            break
        comp = new
    assert len(set(zip(comp.tolist(), got.tolist(), strict=True))) == len(set(comp.tolist())) == len(set(got.tolist()))
    pairs = len(v) * (len(v) - 1) // 2
    assert 0 < trie.pruned < trie.visited < pairs / 2  # of about 900 values; the share falls with their number


def test_majority_of_long_documents():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    first = np.array([0, 0, 1, 700, 700, 3000])
    want = [sum(1 << b for b in range(64) if 2 * int(((h[x:y] >> np.uint64(b)) & np.uint64(1)).sum()) > y - x) for x, y in zip(first[:-1], first[1:], strict=True)]
    assert simhash.majority(h, first).tolist() == want
