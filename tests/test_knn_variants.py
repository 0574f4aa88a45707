"""Every search variant runs over the stated query set (test_catalog holds them against SQL)."""

from paperloom.plans import catalog


def test_variants_over_the_query_set():
    assert {f"knn_each_{v}" for v in ("cosine", "euclidean", "filtered", "range", "threshold")} <= set(catalog.QUERIES) & set(catalog.ORACLES)
