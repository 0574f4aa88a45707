"""The pipeline's near-duplicates against brute force on five-word shingle sets."""

import random
import re

import corpus_pipeline

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(min(len(w), 1), len(w) - 4))}


def test_near_duplicates_stage(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = make(rng.choice([20, 60, 400, 1500]))
        texts.append(" ".join(base))
        for share in (0.0, 0.01, 0.02, 0.05):
            copy = [f"x{rng.randrange(9999)}" if rng.random() < share else w for w in base]
            texts.append(" ".join(copy))
    base = make(150)
    for _ in range(60):  # one large group whose members are often under the threshold
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(150)] = f"y{rng.randrange(9999)}"
        texts.append(" ".join(copy))
    rows = [(1000 - k, t, k) for k, t in enumerate(texts)] + [(None, "a null id stays", 0)]
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(rows[k][0])
    want = sorted((min(g, key=lambda x: (x is None, x or 0)) for g in groups.values()), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=repr) == want


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 0
