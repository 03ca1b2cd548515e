"""The polynomial kernel over all products of three values, against kernel matrices on one machine."""

import math
from types import SimpleNamespace

import numpy as np

from cadenza.operators import cubic
from cadenza.plans import learning
from conftest import rows


def table(spark, x, y, partitions=3):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "vec_id bigint, label int, x array<double>").repartition(partitions)


def kernel(x, y, gamma):
    return (gamma * x @ y.T) ** 3


def dual(k, sign, c=1.0, steps=3000):
    """Greatest dual objective and the decision values' intercept, two shares at a time."""
    alpha, slope, n = np.zeros(len(sign)), np.ones(len(sign)), len(sign)
    for _ in range(steps * n):
        up = np.where(sign > 0, alpha < c, alpha > 0)
        down = np.where(sign > 0, alpha > 0, alpha < c)
        i, j = int(np.argmax(np.where(up, sign * slope, -np.inf))), int(np.argmin(np.where(down, sign * slope, np.inf)))
        apart = sign[i] * slope[i] - sign[j] * slope[j]
        if apart < 1e-6:
            break
        bend = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        room = [(c - alpha[i]) if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else (c - alpha[j])]
        t = min(apart / bend, *room)
        alpha[i] += sign[i] * t
        alpha[j] -= sign[j] * t
        slope -= sign * t * (k[:, i] - k[:, j])
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    b = float((sign * slope)[free].mean()) if free.any() else (sign[i] * slope[i] + sign[j] * slope[j]) / 2
    return alpha, b


def cubes(n, d, seed):
    """Classes by the sign and size of one product of three values."""
    x = np.random.default_rng(seed).normal(size=(n, d))
    made = x[:, 0] * x[:, 1] * x[:, 2]
    return x, np.where(made > 0.2, 2, np.where(made > -0.2, 1, 0))


def test_coordinates_have_the_kernel_as_inner_product():
    x = np.random.default_rng(0).normal(size=(5, 6))
    home, wide, narrow = cubic._spread(6)
    i, j, scale, names = cubic.places(6)
    made = (x[:, i] * x[:, j] * scale)[:, :, None] * x[:, None, :]
    told = np.empty((5, len(narrow)))
    told[:, home[names]] = made[:, names] * narrow[home[names]]
    assert len(narrow) == math.comb(8, 3)
    assert np.allclose(told @ told.T, kernel(x, x, 1.0))
    assert np.allclose(cubic._scores(x, x[:, i] * x[:, j] * scale, told[:2][:, home] * wide), kernel(x, x[:2], 1.0))


def test_objective_is_within_a_hundredth_of_one_machine(spark):
    x, y = cubes(200, 10, 1)
    gamma = 1 / (10 * x.var())
    labels, model, gaps = cubic.train_cubic(table(spark, x, y), gamma)
    assert labels == [0, 1, 2] and max(gaps) <= 0.01
    for label, other, w, b in model:
        mine = (y == label) | (y == other)
        sign = np.where(y[mine] == label, 1.0, -1.0)
        k = kernel(x[mine], x[mine], gamma)
        alpha, _ = dual(k, sign)
        least = alpha.sum() - 0.5 * (alpha * sign) @ k @ (alpha * sign)
        home, wide, _ = cubic._spread(10)
        i, j, scale, _ = cubic.places(10)
        part = math.sqrt(gamma) * x[mine]
        score = cubic._scores(part, part[:, i] * part[:, j] * scale, (w[home] * wide)[None])[:, 0] + b
        got = 0.5 * w @ w + np.maximum(0, 1 - sign * score).sum()
        assert least * 0.999 <= got <= least * 1.01


def test_query_votes_as_kernel_machines_do(spark):
    x, y = cubes(400, 10, 2)
    c = SimpleNamespace(labelled=table(spark, x, y), spark=spark)
    train, test = (df.orderBy("vec_id").collect() for df in learning.splits(c))
    known, asked = (np.array([r["x"] for r in part]) for part in (train, test))
    truth = np.array([r["label"] for r in train])
    gamma = 1 / (10 * known.var())
    votes, sure = np.zeros((len(asked), 3)), np.ones(len(asked), dtype=bool)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        mine = (truth == a) | (truth == b)
        sign = np.where(truth[mine] == a, 1.0, -1.0)
        alpha, shift = dual(kernel(known[mine], known[mine], gamma), sign)
        score = kernel(asked, known[mine], gamma) @ (alpha * sign) + shift
        votes[np.arange(len(asked)), np.where(score >= 0, a, b)] += 1
        sure &= np.abs(score) > 0.1
    got = learning.svm_poly(c)
    assert got.columns == ["vec_id", "truth", "pred"]
    told = rows(got, "vec_id")
    assert [(r[0], r[1]) for r in told] == [(r["vec_id"], r["label"]) for r in test]
    pred = np.array([r[2] for r in told])
    assert sure.sum() > 20 and (pred[sure] == votes.argmax(1)[sure]).all()
    held = np.array([r[1] for r in told])
    assert (pred == held).mean() > np.bincount(held).max() / len(held)


def test_one_class_and_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, 4, [1.0, 2.0]), (2, 4, None)], "vec_id bigint, label int, x array<double>")
    labels, model, gaps = cubic.train_cubic(df, 1.0)
    assert (labels, model, gaps) == ([4], [], [])
    assert rows(cubic.predict_cubic(df, labels, model, 1.0).select("vec_id", "pred"), "vec_id") == [(1, 4), (2, None)]
    x, y = cubes(40, 8, 3)
    labels, model, _ = cubic.train_cubic(table(spark, x, y), 0.5)
    assert cubic.predict_cubic(df.withColumn("x", df.x.cast("array<double>")).where("vec_id = 2"), labels, model, 0.5).first()["pred"] is None
