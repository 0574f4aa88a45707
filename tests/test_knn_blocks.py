"""Searches of many queries, in blocks."""

import pytest

from paperloom.operators import search as V


@pytest.mark.parametrize("n", [1, 4, 5, 8, 9])
def test_blocks_do_not_change_the_result(spark, n):
    points = spark.createDataFrame([(k, [float(k % 5), float(k % 3), 1.0]) for k in range(30)], "point_id long, embedding array<float>")
    queries = points.where(f"point_id < {n}").withColumnRenamed("point_id", "query_id")
    want = sorted(map(tuple, V.knn_each(points, queries, 3, "Dot").collect()))
    assert len(want) == 3 * n
    assert sorted(map(tuple, V.knn_each(points, queries, 3, "Dot", most_queries=4).collect())) == want
