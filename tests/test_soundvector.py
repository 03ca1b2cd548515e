"""The wide sound vector against a plain numpy version of every one of its values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import audio, soundvector

WINDOW, HOP, RATE, MELS, COEFS, SMOOTH = 16, 4, 22050, 128, 20, 5


def stats(a, names):
    a = np.asarray(a, dtype=float)
    told = {"mean": a.mean(), "std": a.std(), "max": a.max(), "min": a.min(), "median": np.median(a)}
    return [told[n] for n in names]


def db(p):
    return 10 * np.log10(np.maximum(1e-10, p))


def safe(a, b):
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def plain_vector(x, lags=(1, 4), tempogram_window=4):
    n = (len(x) - WINDOW) // HOP + 1
    s = np.array([x[f * HOP : f * HOP + WINDOW] for f in range(n)])
    bins = WINDOW // 2 + 1
    m = np.abs(np.fft.rfft(s * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)), axis=1))
    hz = np.arange(bins) * RATE / (2 * (bins - 1))
    five, four, two, three = ["mean", "std", "max", "min", "median"], ["mean", "std", "max", "min"], ["mean", "std"], ["mean", "std", "max"]
    centre = m @ hz / m.sum(1)
    width = np.sqrt(np.maximum(m @ hz**2 / m.sum(1) - centre**2, 0))
    p = np.maximum(1e-10, m**2)
    flat = np.exp(np.log(p).mean(1)) / p.mean(1)
    cum = np.cumsum(m, 1)
    roll = [np.array([hz[np.argmax(c >= c[-1] * share)] for c in cum]) for share in (0.85, 0.99)]
    out = []
    for series in (centre, width, flat, *roll):
        out += stats(series, five)
    band = np.array([0 if f < 200 else min(math.floor(math.log2(f / 200) + 1e-12) + 1, 6) for f in hz])
    for b in range(7):
        part = np.sort(m[:, band == b], axis=1)
        take = max(1, round(part.shape[1] * 0.02))
        out += stats(db(part[:, -take:].mean(1)) - db(part[:, :take].mean(1)) if part.shape[1] else np.zeros(n), two)
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) * 27 / math.log(6.4)
    to_hz = lambda q: q * 200 / 3 if q < 15 else 1000 * math.exp((q - 15) * math.log(6.4) / 27)
    edge = [to_hz(to_mel(RATE / 2) * i / (MELS + 1)) for i in range(MELS + 2)]
    basis = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for f in hz] for a, b, c in zip(edge, edge[1:], edge[2:])])
    mel = db((m**2) @ basis.T)
    log = np.maximum(mel, mel.max() - 80)
    dct = np.array([[math.sqrt((1 if k == 0 else 2) / MELS) * math.cos(math.pi * k * (2 * b + 1) / (2 * MELS)) for b in range(MELS)] for k in range(COEFS)])
    mfcc = log @ dct.T
    k = np.arange(-4, 5)
    slope = np.array([(k / 60) @ mfcc[f - 4 : f + 5] for f in range(4, n - 4)])
    bend = np.array([((3 * k**2 - 20) / 462) @ mfcc[f - 4 : f + 5] for f in range(4, n - 4)])
    for series in (mfcc, slope, bend):
        for i in range(COEFS):
            out += stats(series[:, i], four)
    pitch = [round(math.log2(f / 440) * 12 + 69) % 12 if f else -1 for f in hz]
    stft = np.array([[sum((row**2)[b] for b in range(bins) if pitch[b] == c) for c in range(12)] for row in m])
    cq = np.zeros((n, 12))
    for b, f in enumerate(hz):
        if f:
            for note in range(84):
                near = 1 - abs(12 * math.log2(f / 32.703) - note)
                if near > 0:
                    cq[:, note % 12] += m[:, b] * near
    share = safe(cq, np.repeat(np.abs(cq).sum(1, keepdims=True), 12, axis=1))
    level = sum((share > t) * 0.25 for t in (0.4, 0.2, 0.1, 0.05))
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (SMOOTH + 1)) for i in range(SMOOTH)])
    w /= w.sum()
    half = SMOOTH // 2
    soft = np.array([sum(w[j + half] * level[f + j] for j in range(-half, half + 1) if 0 <= f + j < n) for f in range(n)])
    cens = safe(soft, np.repeat(np.linalg.norm(soft, axis=1, keepdims=True), 12, axis=1))
    top = lambda a: safe(a, np.repeat(a.max(1, keepdims=True), 12, axis=1))
    for series in (top(stft), top(cq), cens):
        for i in range(12):
            out += stats(series[:, i], two)
    mel_db = log - mel.max()
    out += stats(mel_db, five)
    for part in (mel_db[:, :43], mel_db[:, 43:86], mel_db[:, 86:]):
        out += stats(part, three)
    onset = np.concatenate([[0], np.maximum(0, np.diff(m, axis=0)).mean(1)])
    c = onset - onset.mean()
    lag = max(range(lags[0], lags[1] + 1), key=lambda g: (round(float(c[g:] @ c[: n - g]), 9), -g))
    out += [60 / (lag * HOP / RATE), *stats(onset, two)]
    prod = np.array([[onset[t] * onset[t - g] if t >= g else 0 for g in range(lags[1] + 1)] for t in range(n)])
    wide = tempogram_window // 2
    local = np.array([prod[max(0, t - wide) : t + wide + 1].sum(0) for t in range(n)])
    out += stats(safe(local, np.repeat(np.abs(local).max(1, keepdims=True), lags[1] + 1, axis=1)), two)
    turns = np.concatenate([[0], (x[1:] >= 0) != (x[:-1] >= 0)])
    out += stats([turns[f * HOP : f * HOP + HOP].mean() for f in range(n)], four)
    fifths = np.array(soundvector.tonnetz_rows())
    ton = share @ fifths.T
    for i in range(6):
        out += stats(ton[:, i], two)
    return out + stats(np.sqrt((s**2).mean(1)), four)


def table(spark, clips):
    rows = [(c, t, float(v)) for c, x in clips.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip bigint, t int, x double").withColumns({"frame": F.lit(1), "v": F.lit(2), "_chunk": F.lit(3)})


def make(samples, chunk):
    return soundvector.full_features(samples, window=WINDOW, hop=HOP, sample_rate=RATE, n_mels=MELS, n_coefs=COEFS, smooth=SMOOTH, lags=(1, 4), tempogram_window=4, chunk=chunk)


@pytest.mark.parametrize("chunk", [256, 8])
def test_all_390_values_against_numpy(spark, chunk):
    rng = np.random.default_rng(7)
    clips = {1: rng.normal(size=64), 2: rng.normal(size=51), 3: np.sin(np.arange(200) / 3.0), 4: rng.normal(size=300) * np.linspace(0.01, 3, 300)}
    clips |= {5: rng.normal(size=12), 6: rng.normal(size=20)}  # no full frame, too short for a delta
    got = {r["clip"]: r["features"] for r in make(table(spark, clips).repartition(5), chunk).collect()}
    assert set(got) == {1, 2, 3, 4}
    names = audio.feature_layout("full")
    for c, values in got.items():
        want = plain_vector(clips[c])
        assert len(want) == len(names) == len(values) == 390
        wrong = [(n, a, b) for n, a, b in zip(names, values, want) if not math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)]
        assert not wrong, wrong[:5]


def test_silence_and_empty_tables(spark):
    got = make(table(spark, {1: np.zeros(64)}), 256).collect()
    assert len(got) == 1 and all(math.isfinite(v) for v in got[0]["features"])
    assert make(table(spark, {}), 256).collect() == []


def test_samples_are_shuffled_once_and_only_by_chunk(spark):
    sent = soundvector.chunked_samples(table(spark, {1: np.zeros(64), 2: np.ones(80)}), WINDOW, HOP)
    made = soundvector.frame_values(sent, soundvector.ChunkSeries(WINDOW, HOP, RATE, MELS, COEFS, SMOOTH, 256, 20))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.split("\n") if " Exchange " in line and "ReusedExchange" not in line]
    # the samples once, then a number per chunk and a number per clip
    assert len(moved) == 3 and plan.count("ReusedExchange") == 1, plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_chunks_do_not_change_the_series(spark):
    x = np.random.default_rng(8).normal(size=400)
    wide, narrow = (soundvector.ChunkSeries(WINDOW, HOP, RATE, 16, 8, SMOOTH, c, 4) for c in (1000, 10))
    t = np.arange(400)
    _, whole = wide.series(0, t, x, 3.0)
    parts = []
    for chunk in range(10):
        lo, hi = max(0, (chunk * 10 - 4) * HOP - 1), ((chunk + 1) * 10 + 3) * HOP + WINDOW
        parts.append(narrow.series(chunk, t[lo:hi], x[lo:hi], 3.0)[1])
    np.testing.assert_allclose(np.concatenate(parts), whole, rtol=1e-9, atol=1e-9)
