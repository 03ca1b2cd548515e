"""Steps that must stay whole and cheap as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import graph, knn as knn_module, requests, rhythm
from cadenza.operators.knn import block_top_k
from conftest import rows


def test_alike_sets_meet_as_blocks(spark):
    """Sets that share most items: no pair carries two lists of items through a join."""
    rng = np.random.default_rng(3)
    sets = {i: frozenset(rng.choice(12, rng.integers(4, 12), replace=False).tolist()) for i in range(150)}
    df = spark.createDataFrame([(i, f"i{x}") for i, s in sets.items() for x in s], "id bigint, i string")
    groups = {}
    for i, s in sets.items():
        groups.setdefault(s, []).append(i)
    want = {(m[0], m[0], len(m), len(m)): 1.0 for m in groups.values() if len(m) > 1}
    for s, m in groups.items():
        for t, o in groups.items():
            if m[0] < o[0] and len(s & t) / len(s | t) >= 0.7 - 1e-9:
                want[m[0], o[0], len(m), len(o)] = len(s & t) / len(s | t)
    got = graph.set_similarity(df, "id", "i", 0.7, block=40)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and {r[:4]: r[4] for r in found} == pytest.approx(want)
    assert "array_intersect" not in got._jdf.queryExecution().analyzed().toString()
    again = got.withColumn("jaccard", F.round("jaccard", 6)).orderBy("a", "b").collect()
    assert len(again) == len(want) and {tuple(r)[:4]: r.jaccard for r in again} == pytest.approx(want, abs=1e-6)


def test_sets_with_few_common_items_keep_the_prefix_join(spark):
    df = spark.createDataFrame([(i, f"{i // 2}:{x}") for i in range(200) for x in range(5 + i % 2)], "id bigint, i string")
    got = graph.set_similarity(df, "id", "i", 0.7)
    assert "array_intersect" in got._jdf.queryExecution().analyzed().toString()
    assert rows(got.select("a", "b"), "a") == [(i, i + 1) for i in range(0, 200, 2)]


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_of_vectors_are_multiplied(monkeypatch, weighted):
    """Only pairs near the k-th distance are summed term by term; the rows are those of the full comparison."""
    rng = np.random.default_rng(5)
    q, c = rng.integers(0, 3, (60, 6)) + rng.choice([0.0, 1e-5], (60, 6)), rng.integers(0, 3, (400, 6)).astype(float)
    c[7, 2], c[9, 0], q[11, 1] = np.nan, np.inf, np.nan
    c[20:60] = c[20]
    qw = rng.random((60, 6)) if weighted else None
    args = (np.arange(60), q, np.arange(400), c, None, 5, "euclidean", True, qw)
    got = block_top_k(*args).reset_index(drop=True)
    with monkeypatch.context() as m:
        m.setattr(knn_module, "_close_pairs", lambda *a: None)
        assert got.equals(block_top_k(*args).reset_index(drop=True))
    far = rng.normal(size=(300, 40))
    monkeypatch.setattr(knn_module, "_distances", lambda *a: pytest.fail("compared in full"))
    assert len(block_top_k(np.arange(30), far[:30], np.arange(300), far, None, 5, "euclidean", False)) == 150


def test_requests_are_not_sent_to_every_task(spark):
    """A log of requests has no bound, so its rows meet their lists by a sort, whatever size Spark guesses."""
    asked = spark.createDataFrame([(i, f"a{i % 3}", 2, {"tempo": 1.0}) for i in range(30)], "id bigint, artist string, k int, weights map<string,double>")
    profiles = spark.createDataFrame([(f"a{i}", float(i * i)) for i in range(5)], "artist string, tempo double")
    got = requests.run_similarity(asked.withColumn("errors", F.array().cast("array<string>")), profiles, ["tempo"], "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    near = {"a0": ["a1", "a2"], "a1": ["a0", "a2"], "a2": ["a1", "a0"]}
    assert [r[1] for r in rows(got, "id", "rank")] == [n for i in range(30) for n in near[f"a{i % 3}"]]


def test_sums_of_whole_products_are_whole():
    line = np.concatenate([np.zeros(600), np.full(900, 3.0), np.arange(700.0)])
    got = rhythm.lag_products(line, 600, 2200, 500)
    assert got.tolist() == [float(line[600:] @ line[600 - k : 2200 - k]) for k in range(501)]
