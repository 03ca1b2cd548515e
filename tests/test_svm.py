"""Newton steps over all rows against single-machine dual ascent on the same objective."""

import numpy as np
import pytest

from cadenza.operators import svm
from conftest import rows


CONSTANT = svm.FREE**-0.5  # a weight of this column counts as much in w.w as the intercept does


def table(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))], "id int, label int, x array<double>")


def blobs(n, classes, dims, seed, apart=1.5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, dims)) + apart * np.eye(classes, dims)[y], y


def objective(w, x, sign, c):
    """Weights with the constant's weight last."""
    return 0.5 * w @ w + c * np.maximum(0, 1 - sign * (x @ w)).sum()


def one_machine(x, sign, c, steps=400):
    """Dual coordinate ascent row by row."""
    alpha, w, order = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(0)
    yx, size = x * sign[:, None], (x * x).sum(1)
    for _ in range(steps):
        for i in order.permutation(len(x)):
            new = min(c, max(0.0, alpha[i] + (1 - yx[i] @ w) / size[i]))
            w += (new - alpha[i]) * yx[i]
            alpha[i] = new
    return w


@pytest.mark.parametrize("scheme, mean", [("rest", True), ("pairs", False)])
def test_objective_is_within_a_hundredth_of_one_machine(spark, scheme, mean):
    x, y = blobs(600, 3, 6, 1)
    model, gaps = svm.train_newton(table(spark, x, y), scheme=scheme, mean=mean, rows=100)
    assert max(gaps) <= 0.01
    wide = np.hstack([x, np.full((len(x), 1), CONSTANT)])
    for r in model.collect():
        mine = np.ones(len(y), dtype=bool) if r["other"] is None else (y == r["label"]) | (y == r["other"])
        sign = np.where(y[mine] == r["label"], 1.0, -1.0)
        c = 1.0 / mine.sum() if mean else 1.0
        got = objective(np.array([*r["w"], r["b"] / CONSTANT]), wide[mine], sign, c)
        best = objective(one_machine(wide[mine], sign, c), wide[mine], sign, c)
        assert got <= best * 1.01


def test_no_worse_than_the_published_number_of_subgradient_steps(spark):
    x, y = blobs(300, 3, 5, 2)
    df = table(spark, x, y)
    dual, _ = svm.train_newton(df)
    steps = svm.train_ovr(df, steps=60)
    loss = lambda m: {r["label"]: r["loss"] for r in svm.hinge_loss(df, m).collect()}
    a, b = loss(dual.select("label", "w", "b")), loss(steps)
    assert all(a[k] <= b[k] * 1.02 for k in b)


def test_votes_of_pairs_and_ties(spark):
    pairs = [(0, 1, [1.0, 0.0], 0.0), (0, 2, [0.0, 1.0], 0.0), (1, 2, [1.0, 1.0], 0.0)]
    model = spark.createDataFrame(pairs, "label int, other int, w array<double>, b double")
    x = [[1.0, 1.0], [-1.0, 2.0], [-1.0, -1.0], [3.0, -1.0]]  # the last: one vote each
    got = rows(svm.predict_pairs(table(spark, x, [0, 1, 2, 0]), model).select("id", "pred"), "id")
    assert got == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_one_vector_with_a_third_of_the_rows_and_odd_tables(spark):
    x, y = blobs(300, 2, 4, 3)
    x[:100], y[:100] = x[0], 0
    model, gaps = svm.train_newton(table(spark, x, y), rows=50)
    assert max(gaps) <= 0.01 and model.count() == 2
    empty, _ = svm.train_newton(table(spark, x, y).limit(0))
    assert empty.count() == 0
    single, _ = svm.train_newton(table(spark, x[:20], np.zeros(20)), scheme="pairs")
    assert single.count() == 0
