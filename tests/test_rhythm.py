"""Autocorrelation and tempogram by chunks against plain sums over the whole clip."""

import numpy as np
import pytest

from cadenza.operators import rhythm
from conftest import rows


def envelope(spark, clips):
    data = [(c, lo + t, float(v)) for c, (lo, x) in clips.items() for t, v in enumerate(x)]
    return spark.createDataFrame(data, "clip string, t int, strength double")


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(1)
    return {"a": (0, rng.normal(size=500)), "b": (-37, rng.normal(size=91)), "c": (1000, rng.normal(size=3)), "d": (5, np.zeros(40))}


@pytest.mark.parametrize("chunk, direct", [(8192, 256), (32, 256), (32, 0), (8192, 0)])
def test_autocorrelation(spark, clips, monkeypatch, chunk, direct):
    monkeypatch.setattr(rhythm, "CHUNK", chunk)
    got = {(r["clip"], r["lag"]): r["ac"] for r in rhythm.autocorrelation(envelope(spark, clips), 20, direct).collect()}
    assert len(got) == 4 * 21
    for name, (_, x) in clips.items():
        for k in range(21):
            want = float(x[k:] @ x[: len(x) - k]) if k < len(x) else 0.0
            assert got[name, k] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_tempogram(spark, clips, monkeypatch, chunk):
    monkeypatch.setattr(rhythm, "CHUNK", chunk)
    got = {(r["clip"], r["t"], r["lag"]): r["value"] for r in rhythm.tempogram(envelope(spark, clips), 6, 9).collect()}
    assert len(got) == 7 * sum(len(x) for _, x in clips.values())
    for name, (lo, x) in clips.items():
        p = np.array([[x[t] * x[t - k] if t >= k else 0.0 for k in range(7)] for t in range(len(x))])
        local = np.array([p[max(0, t - 4) : t + 5].sum(0) for t in range(len(x))])
        for t in range(len(x)):
            top = np.abs(local[t]).max()
            for k in range(7):
                assert got[name, lo + t, k] == pytest.approx(local[t, k] / top if top else 0.0, abs=1e-9)


def test_lag_products_by_fft_equal_sums():
    line = np.random.default_rng(2).normal(size=900)
    assert np.allclose(rhythm.lag_products(line, 300, 800, 290, 0), rhythm.lag_products(line, 300, 800, 290, 1000), atol=1e-9)


def test_dense_envelope_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(rhythm, "CHUNK", 16)
    onsets = spark.createDataFrame([("a", -20, 1.0), ("a", 3, 2.0), ("a", 50, 1.0), ("b", 7, 4.0)], "clip string, t int, strength double")
    got = rows(rhythm.dense_envelope(onsets), "clip", "t")
    assert got == [("a", t, {-20: 1.0, 3: 2.0, 50: 1.0}.get(t, 0.0)) for t in range(-20, 51)] + [("b", 7, 4.0)]


def test_no_rows(spark):
    empty = envelope(spark, {})
    assert rhythm.autocorrelation(empty, 5).collect() == [] and rhythm.tempogram(empty, 5, 4).collect() == []
