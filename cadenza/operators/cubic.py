"""Support vector machines with the polynomial kernel of degree 3, over all products of three values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from cadenza.session import cut_lineage, shuffle_width

_SLICE = 512  # vectors whose products of two are held at once
_PART = 1 << 15  # numbers of a sum that travel in one row
_CUT = 8  # rounds after which the shares are written to the shared folder
_NAMES = ["at", "told", "y", "x", "own", "a", "prev", "v"]
_STATE = "at int, told binary, y int, x binary, own double, a binary, prev binary, v binary"


def places(d: int) -> tuple[np.ndarray, ...]:
    """``i, j, scale`` of the products of two values, and which (pair, third) places name each product of three once.

    Scaled products of two have the inner product ``(x.y)^2``; times the values themselves ``(x.y)^3``, the kernel.
    """
    i, j = np.triu_indices(d)
    return i, j, np.where(i < j, math.sqrt(2), 1.0), j[:, None] <= np.arange(d)[None, :]


def _spread(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Between coordinates, one per product of three with the kernel as inner product, and all places.

    ``(home, wide, narrow)``: the coordinate of each place, the factor from coordinate to place, and, per coordinate,
    from a sum at its naming place to the coordinate.
    """
    i, j, scale, names = places(d)
    third = np.broadcast_to(np.arange(d), (len(i), d))
    one, two, three = np.sort(np.stack([np.broadcast_to(v, third.shape) for v in (i[:, None], j[:, None], third)]), axis=0)
    _, home = np.unique(((one * d + two) * d + three).ravel(), return_inverse=True)
    home = home.reshape(third.shape)
    root = np.where((one < two) & (two < three), math.sqrt(6), np.where((one == two) & (two == three), 1.0, math.sqrt(3)))
    narrow = np.empty(home.max() + 1)
    narrow[home[names]] = (root / scale[:, None])[names]
    return home, scale[:, None] / root, narrow


def _products(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    i, j, scale, _ = places(x.shape[1])
    for at in range(0, len(x), _SLICE):
        part = x[at : at + _SLICE]
        yield slice(at, at + len(part)), part, part[:, i] * part[:, j] * scale


def _scores(part: np.ndarray, pairs: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows times weights ``(problem, pair, third)``."""
    made = pairs @ w.transpose(1, 0, 2).reshape(w.shape[1], -1)
    return np.einsum("npd,nd->np", made.reshape(len(part), len(w), -1), part)


def _vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    if len({len(v) for v in column}) > 1:
        raise ValueError("vectors of unequal length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


def _state(y: pa.Array, x: pa.Array, own: np.ndarray, a: np.ndarray, prev: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(y), pa.int32()), pa.nulls(len(y), pa.binary())]
    return pa.RecordBatch.from_arrays([*none, y, x, own if isinstance(own, pa.Array) else pa.array(own, pa.float64()), *map(_binary, (a, prev, v))], names=_NAMES)


def _told(total: np.ndarray) -> pa.RecordBatch:
    parts = range(0, len(total), _PART)
    empty = [pa.nulls(len(parts), t) for t in (pa.int32(), pa.binary(), pa.float64(), *[pa.binary()] * 3)]
    told = pa.array([total[a : a + _PART].tobytes() for a in parts], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), told, *empty], names=_NAMES)


def _passed(state: DataFrame, size: int, work) -> tuple[DataFrame, np.ndarray]:
    """One pass: the new state, kept, and the sum over all batches of ``size`` numbers, added part by part.

    ``work`` makes of a batch of state rows the new rows and its numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                rows, numbers = work(batch)
                total += numbers
                yield rows
        yield _told(total)

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(b, dtype=np.float64) for b in table.column("told").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "told": pa.array([whole.tobytes()], pa.binary())})

    made = state.where("at is null").mapInArrow(run, _STATE).persist(StorageLevel.MEMORY_AND_DISK)
    got = made.where("at is not null").select("at", "told").groupBy("at").applyInArrow(add, "at int, told binary").toArrow()
    out = np.zeros(size)
    for at, told in zip(got.column("at").to_pylist(), got.column("told").to_pylist()):
        out[at : at + _PART] = np.frombuffer(told, dtype=np.float64)
    return made, out


def scale_gamma(train: DataFrame, x: str = "x") -> float:
    """``1 / (d var)`` over all values of the training vectors, the published library's ``scale``."""
    got = train.select(F.size(x).alias("d"), F.explode(x).alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
    return 1.0 / (got["d"] * got["v"]) if got["v"] else 1.0


def train_cubic(train: DataFrame, gamma: float, label: str = "label", x: str = "x", *, c: float = 1.0, gap: float = 0.01, rounds: int = 500) -> tuple[list[int], list[tuple], list[float]]:
    """Every class against every other with the kernel ``(gamma x.y)^3``; ``(labels, model, gaps)``.

    The objective of each pair is 0.5 w.w plus ``c`` times the sum of the hinge losses, with a free intercept and a weight for
    every product of three values. Products are never stored: a score is a contraction of the weights with the products of
    two values of a slice of rows. The dual problem is solved by accelerated projected steps, shorter for rows with many
    near copies (by the sum of their kernel values); the shares of the rows (the dual variables) stay with the rows and only weights visit the driver. A round is
    two passes: scores and, on a grid of intercepts, how far the classes would be out of balance; then the new shares and their weights.
    Weighted so that both classes pull alike, the shares are a feasible solution, so ``gaps`` bounds how far each objective is above its least.

    ``model`` has ``(label, other, w, b)`` per pair, ``w`` over the distinct products of three. Rows with a null label or vector are left out.
    """
    rows = train.where(F.col(x).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(x).cast("array<double>").alias("x"))
    rows = cut_lineage(rows.repartition(shuffle_width(train)))
    labels = [r["y"] for r in rows.select("y").distinct().orderBy("y").collect()]
    problems = [(one, two) for i, one in enumerate(labels) for two in labels[i + 1 :]]
    if not problems:
        return labels, [], []
    many, root = len(problems), math.sqrt(gamma)
    length = F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda s, v: s + v) * gamma
    d, floor = rows.agg(F.max(F.size("x")), 0.05 * F.avg(length * length * length)).first()
    home, wide, narrow = _spread(d)
    size, order = len(narrow), home[places(d)[3]]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xs, none = root * _vectors(batch, 1), np.zeros((batch.num_rows, many))
                yield _state(batch.column(0), _binary(xs), np.maximum((xs * xs).sum(1) ** 3, max(floor, 1e-12)), none, none, none)

    def gather(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        names = places(d)[3]
        return batch, sum(((pairs.T @ part)[names] for _, part, pairs in _products(_numbers(batch, "x"))), np.zeros(size))

    def full(v: np.ndarray) -> np.ndarray:
        return v[:, home] * wide

    def steps_of(batch: pa.RecordBatch, which: list[int], ell: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vectors; 1 and -1 for the classes of a problem, 0 for rows of others, a column per problem; kernel values and lengths of steps."""
        xs, ys = _numbers(batch, "x"), batch.column("y").to_numpy()
        sign = np.stack([(ys == problems[p][0]).astype(float) - (ys == problems[p][1]) for p in which], axis=1)
        own = batch.column("own").to_numpy()[:, None]
        return xs, sign, own, 1 / (ell * own)

    state, told = _passed(rows.mapInArrow(begin, _STATE), size, gather)
    total = np.zeros((1, size))
    total[0, order] = told * narrow[order]

    def shorten(batches: Iterator[pa.RecordBatch], at=full(total)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = [_scores(part, pairs, at)[:, 0] for _, part, pairs in _products(_numbers(batch, "x"))]
                own = np.maximum(batch.column("own").to_numpy(), np.abs(np.concatenate(f)))
                yield batch.set_column(_NAMES.index("own"), "own", pa.array(own, pa.float64()))

    first, state = state, cut_lineage(state.where("at is null").mapInArrow(shorten, _STATE))
    first.unpersist()
    grid = 8 * np.sinh(8 * np.linspace(-1, 1, 257)) / np.sinh(8)
    w, was = np.zeros((many, size)), np.zeros((many, size))
    b, ell, pace, beta = np.zeros(many), np.ones(many), np.ones(many), np.zeros(many)
    left, least = np.full(many, math.inf), np.zeros(many)
    best = [(math.inf, w[p], 0.0) for p in range(many)]
    for turn in range(rounds):
        active = [p for p in range(many) if left[p] > gap]
        if not active:
            break
        ahead = w[active] + beta[active, None] * (w[active] - was[active])

        def score(batch: pa.RecordBatch, active=active, at=full(ahead), beta=beta[active], ell=ell[active], tries=b[active, None] + grid) -> tuple[pa.RecordBatch, np.ndarray]:
            xs, sign, _, length = steps_of(batch, active, ell)
            a, prev, v = _numbers(batch, "a"), _numbers(batch, "prev"), np.zeros((len(xs), many))
            told = np.zeros((len(active), 2, tries.shape[1]))
            for own, part, pairs in _products(xs):
                s, f = sign[own], _scores(part, pairs, at)
                y = a[own][:, active] + beta * (a[own][:, active] - prev[own][:, active])
                now = y + (1 - s * f) * length[own]
                v[own, active] = now
                for k in range(len(active)):
                    mine = s[:, k] != 0
                    side, f_k, z = s[mine, k : k + 1], f[mine, k : k + 1], length[own][mine, k : k + 1]
                    told[k, 0] += (side * np.clip(now[mine, k : k + 1] - tries[k] * side * z, 0, c)).sum(0)
                    told[k, 1] += np.maximum(0, 1 - side * (f_k + tries[k])).sum(0)
            return _state(batch.column("y"), batch.column("x"), batch.column("own"), a, prev, v), told.ravel()

        scored, told = _passed(state, len(active) * 2 * len(grid), score)
        for p, (balance, hinge), front in zip(active, told.reshape(len(active), 2, -1), ahead):
            tries = b[p] + grid
            value = 0.5 * front @ front + c * hinge
            if value.min() < best[p][0]:
                best[p] = (value.min(), front.copy(), float(tries[int(np.argmin(value))]))
            b[p] = np.interp(0.0, balance[::-1], tries[::-1])

        def share(batch: pa.RecordBatch, active=active, b=b[active], beta=beta[active], ell=ell[active]) -> tuple[pa.RecordBatch, np.ndarray]:
            xs, sign, own_kernel, length = steps_of(batch, active, ell)
            a, prev, v = _numbers(batch, "a"), _numbers(batch, "prev"), _numbers(batch, "v")
            old = a[:, active]
            y = old + beta * (old - prev[:, active])
            new = np.where(sign != 0, np.clip(v[:, active] - b * sign * length, 0, c), 0.0)
            a, prev = a.copy(), a
            a[:, active] = new
            names, told, pulls = places(xs.shape[1])[3], np.zeros((len(active), 4)), np.zeros((len(active), 2, size))
            told += np.stack([(own_kernel * (new - y) ** 2).sum(0), (own_kernel * (y - new) * (new - old)).sum(0), (new * (sign > 0)).sum(0), (new * (sign < 0)).sum(0)], axis=1)
            for own, part, pairs in _products(xs):
                for k in range(len(active)):
                    for side in range(2):
                        mine = (sign[own, k] == 1 - 2 * side) & (new[own, k] > 0)
                        pulls[k, side] += ((pairs[mine] * new[own][mine, k : k + 1]).T @ part[mine])[names]
            return _state(batch.column("y"), batch.column("x"), batch.column("own"), a, prev, v), np.concatenate([told, pulls.reshape(len(active), -1)], axis=1).ravel()

        shared, told = _passed(scored, len(active) * (4 + 2 * size), share)
        told = told.reshape(len(active), -1)
        sides = np.zeros((len(active), 2, size))
        # sums come in the order of the naming places, coordinates in that of sorted triples
        sides[:, :, order] = told[:, 4:].reshape(len(active), 2, size) * narrow[order]
        held = True
        for k, p in enumerate(active):
            moved, turned, up, down = told[k, :4]
            plus, minus = sides[k]
            if up > 0 and down > 0:
                pull = plus / up - minus / down
                cost = pull @ pull
                both = min(up, down) if cost == 0 else min(up, down, 2 / cost)
                least[p] = max(least[p], 2 * both - 0.5 * both * both * cost)
            left[p] = (best[p][0] - least[p]) / max(best[p][0], 1e-12)
            apart = plus - minus - ahead[k]
            if apart @ apart > 1.0001 * ell[p] * moved + 1e-12:
                # the steps were longer than the kernel allows: this round is made again with shorter ones
                ell[p] = max(1.2 * ell[p], min(3 * ell[p], 1.1 * (apart @ apart) / moved))
                held = False
        if held:
            for k, p in enumerate(active):
                if told[k, 1] > 0:
                    pace[p], beta[p] = 1.0, 0.0
                else:
                    faster = (1 + math.sqrt(1 + 4 * pace[p] ** 2)) / 2
                    beta[p], pace[p] = (pace[p] - 1) / faster, faster
                was[p], w[p] = w[p], sides[k, 0] - sides[k, 1]
            state.unpersist()
            state = shared
            if turn % _CUT == _CUT - 1:
                state = cut_lineage(shared)
                shared.unpersist()
        else:
            shared.unpersist()
        scored.unpersist()
    state.unpersist()
    model = [(*problems[p], best[p][1], float(best[p][2])) for p in range(many)]
    return labels, model, left.tolist()


def predict_cubic(df: DataFrame, labels: list[int], model: list[tuple], gamma: float, x: str = "x") -> DataFrame:
    """Adds ``pred``: the class with the most votes of the pairs; the smallest class on ties, none without a vector or a class."""
    if not model:
        only = F.lit(labels[0] if labels else None).cast("int")
        return df.withColumn("pred", F.when(F.col(x).isNotNull(), only))
    coordinates = len(model[0][2])
    d = next(n for n in range(1, coordinates + 1) if n * (n + 1) * (n + 2) // 6 == coordinates)
    home, wide, _ = _spread(d)
    weights, b, root = np.stack([m[2] for m in model])[:, home] * wide, np.array([m[3] for m in model]), math.sqrt(gamma)
    spot = {label: k for k, label in enumerate(labels)}
    first, second = [spot[m[0]] for m in model], [spot[m[1]] for m in model]
    order = np.array(labels)
    names = df.columns
    kinds = df.select("*", F.lit(None).cast("int").alias("pred")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(batch.column(names.index(x)).is_valid().to_numpy(zero_copy_only=False))
            pred = np.full(batch.num_rows, -1)
            if len(known):
                for own, part, pairs in _products(root * _vectors(batch.take(pa.array(known)), names.index(x))):
                    ahead = _scores(part, pairs, weights) + b >= 0
                    votes = np.zeros((len(part), len(order)), dtype=int)
                    for k, (one, two) in enumerate(zip(first, second)):
                        votes[:, one] += ahead[:, k]
                        votes[:, two] += ~ahead[:, k]
                    pred[known[own]] = votes.argmax(1)
            told = pa.array(np.where(pred < 0, 0, order[pred]), pa.int32(), mask=pred < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*names, "pred"])

    return df.mapInArrow(run, kinds)
