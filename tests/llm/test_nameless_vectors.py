"""Vectors whose key is NULL take part in links and counts."""

from snapgate.llm import pivots


def test_null_keys_link_and_count(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (None, [0.0, 1.0]),
            (7, None), (None, None), (None, [0.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, pivots.near_vectors(df).collect()), key=repr)
    assert found == sorted([
        (1, 2, 1, True), (None, 2, 1, False), (None, 2, 1, False),
        (None, 1, None, True), (None, 1, None, True),
        (7, 0, 7, True), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)], key=repr)
