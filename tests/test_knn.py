"""The three kNN layouts agree with brute force, ties and copies included."""

import numpy as np
import pytest

from cadenza.operators.knn import knn, self_knn
from cadenza.operators.profiles import vote_artist
from conftest import rows


def brute(qs, cs, k, exclude_self=False):
    out = []
    for qi, q in qs:
        d = sorted((round(float(np.sqrt(((np.array(q) - np.array(c)) ** 2).sum())), 9), ci) for ci, c in cs if not (exclude_self and ci == qi))
        out += [(qi, ci, dist, r + 1) for r, (dist, ci) in enumerate(d[:k])]
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(90)]
    return data, spark.createDataFrame(data, "q bigint, v array<double>")


@pytest.mark.parametrize("bound,block", [(8192, 4096), (0, 16), (0, 1000)])
def test_layouts(points, bound, block):
    data, q = points
    got = knn(q, q.withColumnRenamed("q", "c"), 4, exclude_self=True, bound=bound, block=block)
    assert rows(got, "q", "rank") == brute(data, data, 4, True)


def test_few_queries_travel(points, spark):
    data, q = points
    got = knn(q.where("q < 5"), q.withColumnRenamed("q", "c"), 3, bound=10)
    assert rows(got, "q", "rank") == brute(data[:5], data, 3)


def test_self_knn_collapses_copies(spark):
    data = [(i, [0.0, 0.0]) for i in range(30)] + [(30 + i, [1.0 + i, 0.0]) for i in range(10)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    assert rows(self_knn(df, 3, id_col="id"), "id", "rank") == brute(data, data, 3, True)


def test_fewer_candidates_than_k_and_none(spark, points):
    _, q = points
    two = q.where("q < 2").withColumnRenamed("q", "c")
    assert knn(q, two, 5).groupBy("q").count().where("count <> 2").isEmpty()
    assert knn(q, two.where("false"), 5).isEmpty()


def test_zero_length_vector_has_no_cosine(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "q bigint, v array<double>")
    c = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "c bigint, v array<double>")
    assert rows(knn(q, c, 3, metric="cosine"), "q") == [(1, 7, 0.0, 1)]


def test_string_ids_and_candidate_weights(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "q bigint, v array<double>")
    c = spark.createDataFrame([("b", [1.0, 0.0], [1.0, 1.0]), ("a", [0.0, 1.0], [1.0, 4.0])], "c string, v array<double>, w array<double>")
    assert rows(knn(q, c, 2, weight="w"), "rank") == [(1, "b", 1.0, 1), (1, "a", 2.0, 2)]


def test_vote_prefers_count_then_distance_then_name(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 3.0), (1, "y", 1.0), (1, "y", 2.0), (2, "b", 1.0), (2, "a", 1.0)], "q int, artist string, distance double")
    assert rows(vote_artist(df, "q"), "q") == [(1, "y"), (2, "a")]
