"""The wide feature vector of a clip: 390 named statistics from one shuffle of its samples.

Samples are grouped once into chunks of frames, each with the frames that a window at its border looks at, so a clip
holding a third of the data is still many tasks. Inside a chunk every series is numpy over all frames at once (lambdas
over arrays took a millisecond a frame for the products with the mel and cosine bases alone). The spectrum is never
unfolded into cells, nor frames into values. What leaves a chunk are the loudest cell per clip, then the moments of its
series, and medians where the chunk is the whole clip (else the values they are taken from); merging these, exact medians of
longer clips, tempo and the assembly of the vector are joins and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cadenza.operators import audio, rhythm
from cadenza.operators.ordered import exact_quantiles
from cadenza.session import cut_lineage, shuffle_width, small_table

AMIN = audio.AMIN
CHROMAS = ("chroma_stft", "chroma_cqt", "chroma_cens")
MEDIANS = ("spectral_centroid", "spectral_bandwidth", "spectral_flatness", "spectral_rolloff", "spectral_rolloff_99", "mel_db")


# ---- chunks ---------------------------------------------------------------------------------


def chunked_samples(samples: DataFrame, window: int, hop: int, *, chunk: int = 256, halo: int = 20) -> DataFrame:
    """``(clip, _chunk, t, x)``: every sample in the chunks of ``chunk`` frames whose frames, or up to ``halo`` frames beside them, hold it.

    A sample is copied into two chunks near a border and into one elsewhere. Rows with a null clip or t are left out; a
    null x counts as 0.
    """
    t = F.col("t").cast("bigint")
    first, last = F.greatest(F.lit(0), F.ceil((t - (window - 1)) / hop)), F.floor(t / hop)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((first - halo) / chunk)), F.floor((last + halo) / chunk))
    rows = samples.where(F.col("clip").isNotNull() & (t >= 0) & (first <= last))
    return rows.select("clip", F.explode(reach).alias("_chunk"), t.alias("t"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))


# ---- fixed bases ----------------------------------------------------------------------------


def mel_rows(hz: Sequence[float], n_mels: int, sample_rate: int) -> list[list[float]]:
    top = audio._hz_to_mel(sample_rate / 2.0)
    edge = [audio._mel_to_hz(top * i / (n_mels + 1)) for i in range(n_mels + 2)]
    return [[max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2.0 / (hi - lo) for f in hz] for lo, mid, hi in zip(edge, edge[1:], edge[2:])]


def dct_rows(n_in: int, n_out: int) -> list[list[float]]:
    return [[math.sqrt((1.0 if k == 0 else 2.0) / n_in) * math.cos(math.pi * k * (2 * b + 1) / (2.0 * n_in)) for b in range(n_in)] for k in range(n_out)]


def nearest_class_rows(hz: Sequence[float]) -> list[list[float]]:
    """Each bin belongs to its nearest pitch class, C = 0."""
    pitch = [round(math.log2(f / 440.0) * 12 + 69) % 12 if f > 0 else -1 for f in hz]
    return [[float(p == c) for p in pitch] for c in range(12)]


def constant_q_rows(hz: Sequence[float], lowest: float = 32.703, octaves: int = 7) -> list[list[float]]:
    """Triangles two semitones wide around every semitone of ``octaves`` octaves above ``lowest``, folded to classes."""
    rows = [[0.0] * len(hz) for _ in range(12)]
    for b, f in enumerate(hz):
        if f > 0:
            place = 12 * math.log2(f / lowest)
            for note in (math.floor(place), math.floor(place) + 1):
                if 0 <= note < 12 * octaves:
                    rows[note % 12][b] += max(0.0, 1 - abs(place - note))
    return rows


def tonnetz_rows() -> list[list[float]]:
    # Angular steps and radii of the circles of fifths, minor and major thirds.
    steps = [7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3]
    radii = [1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    return [[radii[k] * math.cos(math.pi * (steps[k] * p - (0.5 if k % 2 == 0 else 0.0))) for p in range(12)] for k in range(6)]


# ---- series ---------------------------------------------------------------------------------


def decibels(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(AMIN, power))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    b = np.broadcast_to(b, a.shape)
    return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)


def across(a: np.ndarray, weights: Sequence[float], edges: bool) -> np.ndarray:
    """Weighted sums over neighbouring rows; beyond the ends rows count as 0, or give no value."""
    half = len(weights) // 2
    padded = np.concatenate([np.full((half, a.shape[1]), 0.0 if edges else np.nan), a, np.full((half, a.shape[1]), 0.0 if edges else np.nan)])
    return sum(w * padded[i : i + len(a)] for i, w in enumerate(weights))


class ChunkSeries:
    """The series of one chunk of a clip, as numpy over all its frames at once."""

    def __init__(self, window: int, hop: int, sample_rate: int, n_mels: int, n_coefs: int, smooth: int, chunk: int, halo: int):
        self.window, self.hop, self.chunk, self.halo = window, hop, chunk, halo
        self.taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        bins = window // 2 + 1
        self.hz = np.arange(bins) * sample_rate / (2.0 * (bins - 1))
        rows = lambda a: np.array(a, dtype=float).T
        self.mel, self.dct = rows(mel_rows(self.hz.tolist(), n_mels, sample_rate)), rows(dct_rows(n_mels, n_coefs))
        self.nearest, self.constant_q, self.tonnetz = rows(nearest_class_rows(self.hz.tolist())), rows(constant_q_rows(self.hz.tolist())), rows(tonnetz_rows())
        with np.errstate(divide="ignore"):
            octave = np.floor(np.log2(self.hz / 200.0) + 1e-12) + 1
        self.band = np.where(self.hz < 200.0, 0, np.minimum(octave, 6)).astype(int)
        soft = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (smooth + 1)) for i in range(smooth)]
        self.soft = [w / sum(soft) for w in soft]

    def frames(self, chunk: int, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frame numbers of the chunk and its halo, their samples, and the sample before each (the first is its own)."""
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        lo = max(0, chunk * self.chunk - self.halo)
        base = max(0, lo * self.hop - 1)
        line = np.zeros(max(0, int(t[-1]) + 1 - base))
        line[t[t >= base] - base] = x[t >= base]
        hi = min((chunk + 1) * self.chunk - 1 + self.halo, (int(t[-1]) + 1 - self.window) // self.hop)
        number = np.arange(lo, hi + 1)
        if not len(number):
            return number, np.zeros((0, self.window)), np.zeros(0)
        start = number * self.hop - base
        return number, line[start[:, None] + np.arange(self.window)], line[np.maximum(start - 1, 0)]

    def magnitudes(self, s: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.rfft(s * self.taper, axis=1))

    def loudest(self, chunk: int, t: np.ndarray, x: np.ndarray) -> float | None:
        """Largest mel value of the chunk's own frames in dB, None if it has no full frame."""
        number, s, _ = self.frames(chunk, t, x)
        own = number // self.chunk == chunk
        return float(decibels(self.magnitudes(s[own]) ** 2 @ self.mel).max()) if own.any() else None

    def rolloff(self, m: np.ndarray, share: float) -> np.ndarray:
        reached = np.cumsum(m, axis=1)
        return self.hz[(reached < reached[:, -1:] * share).sum(1).clip(max=len(self.hz) - 1)]

    def contrast(self, m: np.ndarray) -> np.ndarray:
        """Peak-to-valley distance in dB of each octave band; a band without bins has none."""
        out = np.zeros((len(m), 7))
        for b in range(7):
            part = np.sort(m[:, self.band == b], axis=1)
            if part.shape[1]:
                take = max(1, math.floor(part.shape[1] * 0.02 + 0.5))
                out[:, b] = decibels(part[:, -take:].mean(1)) - decibels(part[:, :take].mean(1))
        return out

    def series(self, chunk: int, t: np.ndarray, x: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunk's own frames, and per frame its values in the order of ``series_names``."""
        number, s, ahead = self.frames(chunk, t, x)
        m = self.magnitudes(s)
        power, whole = m * m, m.sum(1)
        floor = np.maximum(AMIN, power)
        centre = ratio(m @ self.hz, whole)
        spread = np.sqrt(np.maximum(ratio(m @ self.hz**2, whole) - centre**2, 0.0))
        rise = np.zeros(len(m))
        rise[1:] = np.maximum(0.0, np.diff(m, axis=0)).mean(1)
        fresh = np.concatenate([ahead[:, None], s[:, : self.hop]], axis=1) >= 0
        turns = (fresh[:, 1:] != fresh[:, :-1]).mean(1)
        log = np.maximum(decibels(power @ self.mel), top - 80.0)
        mfcc = log @ self.dct
        steps = range(-4, 5)
        slope, bend = across(mfcc, [k / 60 for k in steps], False), across(mfcc, [(3 * k * k - 20) / 462 for k in steps], False)
        stft, cq = power @ self.nearest, m @ self.constant_q
        share = ratio(cq, np.abs(cq).sum(1, keepdims=True))
        level = sum(0.25 * (share > step) for step in (0.4, 0.2, 0.1, 0.05))
        smoothed = across(level, self.soft, True)
        cens = ratio(smoothed, np.sqrt((smoothed**2).sum(1, keepdims=True)))
        by_top = lambda a: ratio(a, a.max(1, keepdims=True))
        flat = np.exp(np.log(floor).mean(1)) / floor.mean(1)
        single = [centre, spread, flat, self.rolloff(m, 0.85), self.rolloff(m, 0.99), rise, turns, np.sqrt((s**2).mean(1))]
        wide = [self.contrast(m), mfcc, slope, bend, by_top(stft), by_top(cq), cens, share @ self.tonnetz, log - top, log - top]
        own = number // self.chunk == chunk
        return number[own], np.concatenate([np.stack(single, axis=1), *wide], axis=1)[own]


def frame_values(sent: DataFrame, work: ChunkSeries, told: Callable[[np.ndarray, np.ndarray, bool], dict] | None = None, schema: str = "frame int, v array<double>") -> DataFrame:
    """``(clip, frame, v)``: the values of every full frame, or what ``told`` makes of a chunk's frames.

    The loudest cell of a clip is found first, chunk by chunk, and sent to each of its chunks; both passes read the
    same shuffled samples. ``told`` gets the numbers of the chunk's own frames, their values, and whether these are all
    frames of the clip; it returns the columns of ``schema``.
    """
    kind = dict(sent.dtypes)["clip"]
    told = told or (lambda number, values, alone: {"frame": number, "v": list(values)})
    columns = ["clip", *[f.split()[0] for f in schema.split(", ")]]

    def loud(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = work.loudest(int(key[1]), rows["t"].to_numpy(), rows["x"].to_numpy())
        return pd.DataFrame([] if top is None else [(*key, top)], columns=["clip", "_chunk", "top"], dtype=object)

    def series(key: tuple, rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(tops):
            return pd.DataFrame(columns=columns, dtype=object)
        number, values = work.series(int(key[1]), rows["t"].to_numpy(), rows["x"].to_numpy(), float(tops["top"].iloc[0]))
        made = told(number, values, bool(tops["alone"].iloc[0]))
        return pd.DataFrame({"clip": [key[0]] * len(made[columns[1]]), **made})

    keys = ["clip", "_chunk"]
    # a number of partitions of its own: by the few bytes of samples alone, many clips would be merged into one task
    sent = sent.repartition(shuffle_width(sent), *keys)
    tops = sent.groupBy(*keys).applyInPandas(loud, f"clip {kind}, _chunk bigint, top double")
    tops = tops.groupBy("clip").agg(F.max("top").alias("top"), F.max("_chunk").alias("_last"))
    tops = tops.select("clip", "top", (F.col("_last") == 0).alias("alone"), F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_chunk"))
    return sent.groupBy(*keys).cogroup(tops.groupBy(*keys)).applyInPandas(series, f"clip {kind}, {schema}")


def chunk_statistics(sent: DataFrame, work: ChunkSeries, names: Sequence[str], medians: Sequence[str]) -> DataFrame:
    """One row per clip and chunk with the statistics of its frames, so that frames are not unfolded into values.

    ``n, mean, dev, max, min, median`` are arrays over the distinct ``names``: number of values that are not NaN, their mean,
    sum of squared deviations, greatest, least and median. ``onset`` has the rises of the frames from number ``first`` on.
    If the chunk is not ``alone`` in its clip, medians cannot be told yet, and ``loose`` has the values of ``medians``, as
    ``(series, value)``.
    """
    ids = {n: i for i, n in enumerate(dict.fromkeys(names))}
    of = np.array([ids[n] for n in names])
    shared, width = np.flatnonzero(np.bincount(of) > 1), len(ids)
    single = np.flatnonzero(~np.isin(of, shared))
    middle, onset = [ids[n] for n in medians], names.index("onset")

    def told(number: np.ndarray, values: np.ndarray, alone: bool) -> dict:
        out = {"n": np.zeros(width, dtype=np.int64), **{k: np.full(width, np.nan) for k in ("mean", "dev", "max", "min", "median")}}

        def put(at: np.ndarray, block: np.ndarray) -> None:
            some = ~np.isnan(block)
            n = some.sum(0)
            mean = np.where(some, block, 0.0).sum(0) / np.maximum(n, 1)
            out["n"][at], out["mean"][at] = n, mean
            out["dev"][at] = (np.where(some, block - mean, 0.0) ** 2).sum(0)
            out["max"][at] = np.where(some, block, -np.inf).max(0)
            out["min"][at] = np.where(some, block, np.inf).min(0)

        if not len(number):
            return {k: [] for k in (*out, "alone", "first", "onset", "loose")}
        with np.errstate(invalid="ignore"):
            put(of[single], values[:, single])
            for s in shared:
                put(np.array([s]), values[:, of == s].reshape(-1, 1))
        kept = [v[~np.isnan(v)] for v in (values[:, of == s].ravel() for s in middle)]
        if alone:
            for s, v in zip(middle, kept):
                out["median"][s] = np.median(v) if len(v) else np.nan
        loose = None if alone else [{"series": s, "value": x} for s, v in zip(middle, kept) for x in v.tolist()]
        return {**{k: [v] for k, v in out.items()}, "alone": [alone], "first": [int(number[0])], "onset": [values[:, onset]], "loose": [loose]}

    arrays = "n array<bigint>, mean array<double>, dev array<double>, max array<double>, min array<double>, median array<double>"
    return frame_values(sent, work, told, f"{arrays}, alone boolean, first int, onset array<double>, loose array<struct<series:int,value:double>>")


def merged_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(clip, series, mean, std, max, min)`` of whole clips and ``(clip, series, median)`` from the rows of ``chunk_statistics``."""
    zipped = F.arrays_zip("n", "mean", "dev", "max", "min", "median")
    parts = chunks.select("clip", "alone", F.posexplode(zipped).alias("series", "s")).select("clip", "alone", "series", "s.*").where("n > 0")
    # what is told of infinite values may not be a number, which Arrow hands over as null
    parts = parts.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("mean", "dev", "max", "min", "median")})
    alone, cut, keys = parts.where("alone"), parts.where("not alone"), ["clip", "series"]
    stats = alone.select(*keys, "mean", F.sqrt(F.col("dev") / F.col("n")).alias("std"), "max", "min")
    # of a clip in several chunks the means are merged first, then the deviations from the merged mean
    whole = cut.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    spread = F.sqrt(F.sum(F.col("dev") + F.col("n") * apart * apart) / F.first("_n"))
    joined = cut.join(whole, keys).groupBy(*keys).agg(F.first("_mean").alias("mean"), spread.alias("std"), F.max("max").alias("max"), F.min("min").alias("min"))
    loose = chunks.where("not alone").select("clip", F.inline("loose"))
    return stats.unionByName(joined), alone.select(*keys, "median").unionByName(exact_quantiles(loose, keys, "value", {"median": 0.5}))


def series_names(n_coefs: int, n_mels: int, bands: Sequence[int]) -> list[str]:
    """Names of the values of a frame in the order ``frame_values`` lists them."""
    names = ["spectral_centroid", "spectral_bandwidth", "spectral_flatness", "spectral_rolloff", "spectral_rolloff_99", "onset", "zcr", "rms"]
    names += [f"spectral_contrast_{i}" for i in range(7)] + [f"{f}_{i}" for f in ("mfcc", "mfcc_delta", "mfcc_delta2") for i in range(n_coefs)]
    names += [f"{f}_{i}" for f in CHROMAS for i in range(12)] + [f"tonnetz_{i}" for i in range(6)]
    return names + ["mel_db"] * n_mels + ["mel_db_low" if i < bands[0] else "mel_db_mid" if i < bands[1] else "mel_db_high" for i in range(n_mels)]


def full_features(
    samples: DataFrame,
    *,
    window: int = 2048,
    hop: int = 512,
    sample_rate: int = 22050,
    n_mels: int = 128,
    n_coefs: int = 20,
    smooth: int = 41,
    lags: tuple[int, int] = (8, 86),
    tempogram_window: int = 384,
    bands: tuple[int, int] = (43, 86),
    chunk: int = 256,
) -> DataFrame:
    """``(clip, features)``: the wide vector in the order of ``audio.feature_layout("full")``.

    Clips with no full frame drop out, and so do those too short for a series (a delta needs nine frames).
    """
    halo = max(4, smooth // 2)
    work = ChunkSeries(window, hop, sample_rate, n_mels, n_coefs, smooth, chunk, halo)
    names = series_names(n_coefs, n_mels, bands)
    # statistics, medians and rhythm read the finished chunks, not the samples again
    rows = cut_lineage(chunk_statistics(chunked_samples(samples, window, hop, chunk=chunk, halo=halo), work, names, MEDIANS))

    ids = {n: i for i, n in enumerate(dict.fromkeys(names))}
    stats, middle = merged_statistics(rows)
    middle = middle.where(F.col("series").isin([ids[n] for n in MEDIANS]))
    label = small_table(samples.sparkSession, [(i, n) for n, i in ids.items()], "series int, _p string")
    parts = [audio.named_stats(t.join(label, "series").drop("series"), F.col("_p"), cols) for t, cols in ((stats, audio.STATS4), (middle, ["median"]))]
    envelope = rows.select("clip", "first", F.posexplode("onset").alias("at", "strength"))
    parts.append(rhythm_features(envelope.select("clip", (F.col("first") + F.col("at")).alias("t"), "strength"), lags, tempogram_window, hop / sample_rate))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return audio.vector_assemble(every.where(F.col("value").isNotNull()), audio.feature_layout("full"))


def rhythm_features(envelope: DataFrame, lags: tuple[int, int], window: int, step_seconds: float) -> DataFrame:
    """``(clip, name, value)``: tempo, and mean and deviation of the local autocorrelation."""
    lo, hi = lags
    tempo = rhythm.tempo_autocorr(rhythm.autocorrelation(rhythm.centred(envelope), hi), lo, hi, step_seconds)
    local = rhythm.tempogram(envelope, hi, window).groupBy("clip").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return tempo.select("clip", F.lit("tempo").alias("name"), F.col("bpm").alias("value")).unionByName(audio.named_stats(local, F.lit("tempogram"), ["mean", "std"]))
