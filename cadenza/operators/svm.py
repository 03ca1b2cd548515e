"""Linear SVM: scores and losses as columns; training by subgradient steps or by Newton steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.session import cut_lineage, small_table


def decision_scores(df: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Adds ``scores``: ``w . x + b`` per class, from a ``(label, w[], b)`` model of one row per class."""
    value = model.agg(F.array_sort(F.collect_list(F.struct("label", "w", "b")))).scalar()

    def score(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col(x), c["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.struct(c["label"].alias("label"), (dot + c["b"]).alias("score"))

    return df.withColumn("_m", value).withColumn("scores", F.transform("_m", score)).drop("_m")


def predict(df: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Class with the largest score; the first class on ties."""
    best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["label"]).alias("l"))))
    return decision_scores(df, model, x).withColumn("pred", (-best["l"]).cast("int"))


def hinge_loss(df: DataFrame, model: DataFrame, label: str = "label", x: str = "x", c: float = 1.0) -> DataFrame:
    """``0.5 w.w + C mean(max(0, 1 - y f(x)))`` per class."""
    long = decision_scores(df, model, x).select(F.col(label).alias("truth"), F.inline("scores"))
    y = F.when(F.col("truth") == F.col("label"), 1.0).otherwise(-1.0)
    hinge = long.groupBy("label").agg(F.avg(F.greatest(F.lit(0.0), 1 - y * F.col("score"))).alias("h"))
    norm = F.aggregate(F.transform("w", lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
    return hinge.join(model, "label").select("label", (norm * 0.5 + c * F.col("h")).alias("loss"))


def train_ovr(train: DataFrame, label: str = "label", x: str = "x", c: float = 1.0, rate: float = 0.1, steps: int = 500) -> DataFrame:
    """Batch subgradient descent on the same objective for every class at once.

    A step is one pass: each task sums the gradient of its rows (classes x dimensions numbers) and Spark
    adds the sums. Only the weights, whose size is that of the model, visit the driver.
    """
    data = train.select(F.col(label).cast("int").alias("y"), F.col(x).cast("array<double>").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    classes = [r[0] for r in data.select("y").distinct().orderBy("y").collect()]
    first = data.select(F.size("x").alias("d")).first()
    d, n = first["d"], data.count()
    w = np.zeros((len(classes), d + 1))
    order = np.array(classes)
    for step in range(steps):
        held = w.copy()

        def partial(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(held)
            for b in batches:
                if len(b):
                    xs = np.hstack([np.vstack(b["x"]), np.ones((len(b), 1))])
                    ys = np.where(b["y"].to_numpy()[:, None] == order[None, :], 1.0, -1.0)
                    bad = (ys * (xs @ held.T) < 1) * ys
                    total += bad.T @ xs
            k, j = np.indices(total.shape)
            yield pd.DataFrame({"k": k.ravel(), "j": j.ravel(), "g": total.ravel()})

        sums = data.mapInPandas(partial, "k int, j int, g double").groupBy("k", "j").agg(F.sum("g").alias("g")).toPandas()
        push = np.zeros_like(w)
        push[sums["k"], sums["j"]] = sums["g"] / n
        keep = w.copy()
        keep[:, -1] = 0.0
        w = w - rate / (1 + 0.02 * step) * (keep - c * push)
    data.unpersist()
    rows = [(int(k), [float(v) for v in w[i, :-1]], float(w[i, -1])) for i, k in enumerate(classes)]
    return small_table(train.sparkSession, rows, "label int, w array<double>, b double")


# ---- Newton steps on a narrowing smooth hinge -----------------------------------------------

STEPS = np.array([0.4**i for i in range(8)])  # step lengths tried in one pass
FREE = 1e-3  # the intercept's part in w.w: next to nothing, but enough for a solution where no row is near the border


def packed_rows(train: DataFrame, label: str, x: str, rows: int = 4096) -> DataFrame:
    """``(y, x)`` lists of about ``rows`` rows each, written once. Rows with a null label or vector are left out.

    Rows are dealt at random, so neither a class nor a vector with a third of all rows makes one list long.
    """
    data = train.where(F.col(x).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(x).cast("array<double>").alias("x"))
    data = cut_lineage(data)
    many = max(1, -(-data.count() // rows))
    dealt = data.withColumn("block", F.floor(F.rand(42) * many).cast("int")).groupBy("block")
    return cut_lineage(dealt.agg(F.collect_list("y").alias("y"), F.collect_list(F.col("x")).alias("x")))


def _summed(blocks: DataFrame, size: int, work) -> np.ndarray:
    """Sum over all blocks of ``work(x with a constant, y)``, an array of ``size`` numbers; one row leaves a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            for ys, xs in zip(b["y"], b["x"]):
                total += work(np.hstack([np.vstack(xs), np.ones((len(ys), 1))]), np.asarray(ys))
        yield pd.DataFrame({"told": [total.tolist()]})

    sums = blocks.select("y", "x").mapInPandas(run, "told array<double>").select(F.posexplode("told").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"))
    out = np.zeros(size)
    got = sums.toPandas()
    out[got["i"]] = got["s"]
    return out


def smooth_hinge(margin: np.ndarray, mu: float) -> np.ndarray:
    """The hinge loss with its corner rounded over ``mu``; at most mu / 2 below it."""
    return np.where(margin >= 1, 0.0, np.where(margin > 1 - mu, (1 - margin) ** 2 / (2 * mu), 1 - margin - mu / 2))


def train_newton(train: DataFrame, label: str = "label", x: str = "x", *, scheme: str = "rest", c: float = 1.0, mean: bool = True, gap: float = 0.01, rounds: int = 100, rows: int = 4096) -> tuple[DataFrame, list[float]]:
    """Hinge-loss SVMs for all classes at once; ``(model, gaps)``.

    ``scheme``: ``rest`` trains one class against the others, ``pairs`` every class against every other. The objective of
    each is 0.5 w.w plus ``c`` times the mean (``mean``) or the sum of the hinge losses; the intercept counts ``FREE`` times.
    A round is two passes: one sums gradient and Hessian of the smoothed objective, whose size is that of the model, the
    next the losses of several step lengths. The smoothing narrows as its minimum comes near. What it takes away from the
    loss, and the decrease that Newton's step promises, bound how far the objective can be from its least; a problem ends
    when that is at most ``gap`` of it. The number of rounds does not grow with the rows or the parts they lie in.

    The model has a row per problem: ``label``, ``other`` (null for ``rest``), ``w``, ``b``.
    """
    spark = train.sparkSession
    blocks = packed_rows(train, label, x, rows)
    counts = {r["y"]: r["n"] for r in blocks.select(F.explode("y").alias("y")).groupBy("y").agg(F.count("*").alias("n")).collect()}
    labels, n = sorted(counts), sum(counts.values())
    problems = [(a, None) for a in labels] if scheme == "rest" else [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    if not problems:
        return small_table(spark, [], "label int, other int, w array<double>, b double"), []
    d = blocks.select(F.size(F.col("x")[0])).first()[0] + 1
    weight = [c / (n if b is None else counts[a] + counts[b]) if mean else c for a, b in problems]
    w, mu, left = np.zeros((len(problems), d)), np.ones(len(problems)), np.full(len(problems), math.inf)
    best = [(math.inf, w[p]) for p in range(len(problems))]
    least, damp = np.full(len(problems), -math.inf), np.zeros(len(problems))
    width, hold = 3 + d + d * d, np.append(np.ones(d - 1), FREE)

    def rows_of(p: int, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, other = problems[p]
        mine = np.flatnonzero((ys == a) | (ys == other)) if other is not None else np.arange(len(ys))
        return mine, np.where(ys[mine] == a, 1.0, -1.0)

    for _ in range(rounds):
        active = [p for p in range(len(problems)) if left[p] > gap]
        if not active:
            break

        def slopes(xs: np.ndarray, ys: np.ndarray, active=active, w=w.copy(), mu=mu.copy()) -> np.ndarray:
            out = []
            for p in active:
                mine, sign = rows_of(p, ys)
                part = xs[mine]
                m = sign * (part @ w[p])
                share = np.clip((1 - m) / mu[p], 0.0, 1.0)
                bent = part[(m < 1) & (m > 1 - mu[p])]
                out += [[np.maximum(0, 1 - m).sum(), smooth_hinge(m, mu[p]).sum(), share.sum()], (share * sign) @ part, (bent.T @ bent).ravel()]
            return np.concatenate(out)

        told = _summed(blocks, width * len(active), slopes).reshape(len(active), width)
        going, steps, now, narrowed = [], {}, {}, {}
        for p, (hinge, smooth, alpha), g, h in zip(active, told[:, :3], told[:, 3 : 3 + d], told[:, 3 + d :]):
            norm, pull = 0.5 * w[p] @ (hold * w[p]), weight[p] * g
            if norm + weight[p] * hinge < best[p][0]:
                best[p] = (norm + weight[p] * hinge, w[p].copy())
            slope = hold * w[p] - pull
            bend = np.diag(hold) + weight[p] / mu[p] * h.reshape(d, d)
            promise, value = float(slope @ np.linalg.solve(bend, slope)), norm + weight[p] * smooth
            least[p] = max(least[p], weight[p] * alpha - 0.5 * pull @ (pull / hold), value - promise)
            left[p] = (best[p][0] - least[p]) / max(best[p][0], 1e-12)
            if left[p] > gap:
                going.append(p)
                # after a step that did not help the next one is shorter and nearer the slope
                steps[p], now[p] = -np.linalg.solve(bend + damp[p] * np.trace(bend) / d * np.eye(d), slope), value
                narrowed[p] = promise <= 0.02 * abs(value)
                if narrowed[p]:
                    mu[p] *= 0.3
        if not going:
            break

        def losses(xs: np.ndarray, ys: np.ndarray, going=going, w=w.copy(), mu=mu.copy(), steps=steps) -> np.ndarray:
            out = []
            for p in going:
                mine, sign = rows_of(p, ys)
                at, move = sign * (xs[mine] @ w[p]), sign * (xs[mine] @ steps[p])
                out.append([smooth_hinge(at + t * move, mu[p]).sum() for t in STEPS])
            return np.concatenate(out)

        tried = _summed(blocks, len(STEPS) * len(going), losses).reshape(len(going), len(STEPS))
        for p, row in zip(going, tried):
            value = [0.5 * (v := w[p] + t * steps[p]) @ (hold * v) + weight[p] * s for t, s in zip(STEPS, row)]
            if narrowed[p] or min(value) < now[p]:
                w[p], damp[p] = w[p] + STEPS[int(np.argmin(value))] * steps[p], 0.1 * damp[p] if damp[p] > 1e-6 else 0.0
            else:
                damp[p] = max(10 * damp[p], 1e-3)
    told = [(a, b, [float(v) for v in best[p][1][:-1]], float(best[p][1][-1])) for p, (a, b) in enumerate(problems)]
    return small_table(spark, told, "label int, other int, w array<double>, b double"), left.tolist()


def predict_pairs(df: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Class with the most votes of the pairwise models; the smallest class on ties."""
    value = model.agg(F.array_sort(F.collect_list(F.struct("label", "other", "w", "b")))).scalar()

    def vote(m: Column) -> Column:
        dot = F.aggregate(F.zip_with(F.col(x), m["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.when(dot + m["b"] >= 0, m["label"]).otherwise(m["other"])

    votes = df.withColumn("_m", value).withColumn("_votes", F.transform("_m", vote)).drop("_m")
    tally = F.transform(F.array_distinct("_votes"), lambda l: F.struct(F.size(F.filter("_votes", lambda v: v == l)).alias("n"), (-l).alias("l")))
    return votes.withColumn("pred", (-F.array_max(tally)["l"]).cast("int")).drop("_votes")
