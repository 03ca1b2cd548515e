"""What a grid of blocks and a mean of vectors send."""

from cadenza.operators import knn as knn_module, rhythm


def test_blocks_of_a_grid_grow_with_the_sides():
    assert knn_module.block_rows(10_000, 10_000, 64, 24) == 4096
    assert knn_module.block_rows(700_000, 120_000, 64, 24) == 32768
    assert knn_module.block_rows(700_000, 120_000, 1 << 20, 24) == 4096
    assert knn_module.block_rows(40_000, 40_000, 64, 24) == 5773


def test_mean_vectors_are_not_unfolded(spark):
    """One row per key and task is shuffled; a key is as wide as its widest vector."""
    some = [("a", [1.0, 2.0, 3.0]), ("a", [3.0, 4.0]), ("a", None), ("b", [None, 5.0]), ("c", []), ("d", None), (None, [7.0])]
    got = rhythm.mean_vectors(spark.createDataFrame(some, "k string, v array<double>"), ["k"], "v")
    assert {r["k"]: r["v"] for r in got.collect()} == {"a": [2.0, 3.0, 3.0], "b": [None, 5.0], None: [7.0]}
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
