"""Approximate search by blocks of rows that share a code."""

import math

import numpy as np
import pytest

from cadenza.operators import retrieval


def _plain_search(codes, q, c, k):
    out = set()
    for i, v in q.items():
        near = []
        for j, u in c.items():
            if i != j and codes[i] & codes[j]:
                near.append((round(math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(v, u))), 9), j))
        out |= {(i, j, d, r + 1) for r, (d, j) in enumerate(sorted(near)[:k])}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_lsh_search_meets_in_blocks(spark, block):
    """All items of a query's codes, whatever the blocks, and no pair with two vectors in a join."""
    rng = np.random.default_rng(1)
    v = {i: np.round(rng.normal(size=6), 3).tolist() for i in range(60)}
    v[31] = v[30]
    df = spark.createDataFrame(list(v.items()), "c bigint, v array<double>")
    q = df.where("c % 4 = 0").withColumnRenamed("c", "q")
    held = retrieval.sign_codes(df, "c", "v", 3, 4).collect()
    codes = {i: {(r["table"], r["code"]) for r in held if r["c"] == i} for i in v}
    got = retrieval.lsh_search(q, df, 5, query_id="q", item_id="c", bits=3, tables=4, block=block)
    assert {tuple(r) for r in got.collect()} == _plain_search(codes, {i: x for i, x in v.items() if i % 4 == 0}, v, 5)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()


def test_lsh_search_joins_odd_rows_pair_by_pair(spark):
    """Ids that repeat, and missing or infinite components, keep the rows of the plain join."""
    some = [(1, [1.0, 2.0]), (2, [1.0, 2.5]), (2, [1.0, 3.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, None), (None, [1.0, 2.0])]
    df = spark.createDataFrame(some, "c bigint, v array<double>")
    got = retrieval.lsh_search(df.where("c = 1").withColumnRenamed("c", "q"), df, 9, query_id="q", item_id="c", bits=1, tables=16)
    found = {(r["c"], None if r["distance"] is None else str(r["distance"])) for r in got.collect()}
    assert (2, "0.5") in found and (2, "1.0") in found and (3, None) in found and not {c for c, _ in found} & {1, 5, None}


def test_sign_planes_are_worked_out_once_per_position(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, [2.0, 3.0])], "c bigint, v array<double>")
    plan = retrieval.sign_codes(df, "c", "v", 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    at = [line for line in plan.splitlines() if "md5" in line]
    assert at and all("Aggregate" not in line for line in at)
