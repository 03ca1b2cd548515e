"""The k-th distance is bounded from the least of groups of candidates; lists stay what a full ranking gives."""

import numpy as np
import pytest

from cadenza.operators import knn


def test_reach_is_never_below_the_kth():
    rng = np.random.default_rng(0)
    for width in (1, 3, 17, 200, 1000):
        d = rng.integers(0, 50, (40, width)).astype(float)
        d[rng.random(d.shape) < 0.2] = np.inf
        for k in (1, 3, 10):
            reach = knn._reach(d, k)
            assert (reach >= np.sort(d, axis=1)[:, min(k, width) - 1]).all()
            assert ((d <= reach[:, None]).sum(1) >= min(k, width)).all()
    # the least of groups are ranked, not all
    assert knn._reach(np.tile(np.arange(4096.0), (2, 1)), 3).tolist() == [2.0, 2.0]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("own", [False, True])
def test_lists_with_copies_zeros_and_gaps(metric, own):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(900, 5))
    c[100:140], c[7], c[8] = c[100], 0.0, np.nan
    q = c[:60].copy()
    got = knn.block_top_k(np.arange(60), q, np.arange(900), c, None, 4, metric, own)
    with np.errstate(all="ignore"):
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        full = 1 - unit(q) @ unit(c).T if metric == "cosine" else np.linalg.norm(q[:, None] - c[None], axis=2)
    full = np.round(full, 9)
    if own:
        full[np.arange(60), np.arange(60)] = np.nan
    for i in range(60):
        ranked = [int(j) for j in np.lexsort((np.arange(900), full[i])) if np.isfinite(full[i, j])][:4]
        assert got[got["q"] == i]["c"].tolist() == ranked


def test_candidates_are_scaled_once_for_all_queries(monkeypatch):
    rows = []
    plain = knn._unit
    monkeypatch.setattr(knn, "_unit", lambda m: rows.append(len(m)) or plain(m))
    rng = np.random.default_rng(2)
    knn.block_top_k(np.arange(700), rng.normal(size=(700, 3)), np.arange(5000), rng.normal(size=(5000, 3)), None, 3, "cosine", False)
    assert rows.count(5000) == 1 and len(rows) > 2
