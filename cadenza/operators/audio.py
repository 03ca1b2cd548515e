"""Audio features as relational jobs over sample and spectrum tables.

Tables are long: ``(clip, t, x)`` for samples and ``(clip, frame, bin, value)`` for magnitude spectra.
Work is keyed by clip and frame, and anything that looks along time cuts clips into chunks, so a clip
holding a third of the data is still many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cadenza.functions.hashing import hash_int
from cadenza.operators.ordered import exact_quantiles, own_rows, with_halo
from cadenza.session import small_table

AMIN = 1e-10
STATS4 = ["mean", "std", "max", "min"]


# ---- from samples ---------------------------------------------------------------------------


def frame_signal(samples: DataFrame, window: int = 2048, hop: int = 512) -> DataFrame:
    """``(clip, frame, n, x)``: every sample copied into the full frames that contain it."""
    t = F.col("t")
    last = samples.groupBy("clip").agg(F.floor((F.max("t") + 1 - window) / hop).alias("_last"))
    first = F.greatest(F.lit(0), F.ceil((t - window + 1) / hop)).cast("int")
    upto = F.least(F.floor(t / hop), F.col("_last")).cast("int")
    framed = samples.join(last, "clip").where(first <= upto).withColumn("frame", F.explode(F.sequence(first, upto)))
    return framed.select("clip", "frame", (t - F.col("frame") * hop).cast("int").alias("n"), "x")


def stft_magnitude(framed: DataFrame, window: int) -> DataFrame:
    """``(clip, frame, bin, value)``: Hann-windowed magnitude spectrum of each frame.

    A frame is at most ``window`` samples, so the list a task holds per frame is bounded.
    """
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    packed = framed.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    packed = packed.select("clip", "frame", F.transform("s", lambda v: v["x"]).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                mag = np.abs(np.fft.rfft(np.vstack(b["s"]) * taper, axis=1))
                yield pd.DataFrame({"clip": b["clip"], "frame": b["frame"], "m": list(mag)})

    kind = dict(framed.dtypes)
    spectra = packed.mapInPandas(run, f"clip {kind['clip']}, frame {kind['frame']}, m array<double>")
    return spectra.select("clip", "frame", F.posexplode("m").alias("bin", "value"))


def rms(framed: DataFrame) -> DataFrame:
    return framed.groupBy("clip", "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("value"))


def zero_crossing(samples: DataFrame, frame: int) -> DataFrame:
    """Share of sign changes among the samples of each block of ``frame`` samples."""
    rows, w = with_halo(samples, ["clip"], "t", 1, 0)
    flip = (F.lag("x").over(w) >= 0) != (F.col("x") >= 0)
    marked = own_rows(rows.withColumn("_f", F.coalesce(flip, F.lit(False)).cast("double")))
    return marked.groupBy("clip", F.floor(F.col("t") / frame).cast("int").alias("frame")).agg(F.avg("_f").alias("value"))


def pad_trim(values: Column, n: int, fill: float = 0.0) -> Column:
    """Fixed-length array: zero-padded on the right or cut."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)


# ---- fixed bases ----------------------------------------------------------------------------


def _hz_to_mel(f: float) -> float:
    return f * 3.0 / 200.0 if f < 1000.0 else 15.0 + math.log(f / 1000.0) * 27.0 / math.log(6.4)


def _mel_to_hz(m: float) -> float:
    return m * 200.0 / 3.0 if m < 15.0 else 1000.0 * math.exp((m - 15.0) * math.log(6.4) / 27.0)


def mel_basis(spark: SparkSession, bins: int, n_mels: int, sample_rate: int = 22050) -> DataFrame:
    """Area-normalised triangles on the mel scale, as non-zero ``(bin, coef, w)`` rows."""
    hz = [k * sample_rate / (2.0 * (bins - 1)) for k in range(bins)]
    top = _hz_to_mel(sample_rate / 2.0)
    edge = [_mel_to_hz(top * i / (n_mels + 1)) for i in range(n_mels + 2)]
    rows = []
    for m in range(n_mels):
        lo, mid, hi = edge[m : m + 3]
        rows.append((0, m, 0.0))  # a triangle narrower than the bin spacing is empty and yields 0
        for b, f in enumerate(hz):
            w = max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2.0 / (hi - lo)
            if w > 0:
                rows.append((b, m, w))
    return small_table(spark, rows, "bin int, coef int, w double")


def dct_basis(spark: SparkSession, n_in: int, n_out: int) -> DataFrame:
    """Orthonormal DCT-II."""
    rows = [
        (b, k, math.sqrt((1.0 if k == 0 else 2.0) / n_in) * math.cos(math.pi * k * (2 * b + 1) / (2.0 * n_in)))
        for k in range(n_out)
        for b in range(n_in)
    ]
    return small_table(spark, rows, "bin int, coef int, w double")


def tonnetz_basis(spark: SparkSession) -> DataFrame:
    """Projection of 12 pitch classes on fifths, minor thirds and major thirds (sine, cosine pairs)."""
    # Angular steps and radii of the three circles.
    steps = [7 / 6, 7 / 6, 3 / 2, 3 / 2, 2 / 3, 2 / 3]
    radii = [1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    rows = [
        (p, k, radii[k] * math.cos(math.pi * (steps[k] * p - (0.5 if k % 2 == 0 else 0.0)))) for k in range(6) for p in range(12)
    ]
    return small_table(spark, rows, "bin int, coef int, w double")


def coef_join(cells: DataFrame, basis: DataFrame) -> DataFrame:
    """Matrix product as a join: ``(clip, frame, bin, value)`` x ``(bin, coef, w)`` -> sum of products.

    The basis has at most bins x coefs rows and Spark sends it to every task by its size.
    """
    return cells.join(basis, "bin").groupBy("clip", "frame", F.col("coef").alias("bin")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


# ---- from spectra ---------------------------------------------------------------------------


def power(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.col("value") * F.col("value"))


def mel_bands(spectrum: DataFrame, bins: int, n_mels: int = 128, sample_rate: int = 22050) -> DataFrame:
    return coef_join(power(spectrum), mel_basis(spectrum.sparkSession, bins, n_mels, sample_rate))


def power_to_db(cells: DataFrame, reference: float | None = None, top_db: float = 80.0) -> DataFrame:
    """Decibels against each clip's maximum (or a fixed reference), floored ``top_db`` below the loudest."""
    peak = cells.groupBy("clip").agg(F.max("value").alias("_peak"))

    def db(c: Column) -> Column:
        return F.log10(F.greatest(F.lit(AMIN), c)) * 10

    ref = F.lit(10 * math.log10(max(AMIN, reference))) if reference else db(F.col("_peak"))
    out = cells.join(peak, "clip").withColumn("value", F.greatest(db(F.col("value")), db(F.col("_peak")) - top_db) - ref)
    return out.drop("_peak")


def mfcc(spectrum: DataFrame, bins: int, n_mels: int = 128, n_coefs: int = 20) -> DataFrame:
    logmel = power_to_db(mel_bands(spectrum, bins, n_mels), reference=1.0)
    return coef_join(logmel, dct_basis(spectrum.sparkSession, n_mels, n_coefs))


def hertz(bins: int, sample_rate: int = 22050) -> Column:
    return F.col("bin") * F.lit(sample_rate / (2.0 * (bins - 1)))


def chroma(spectrum: DataFrame, bins: int, sample_rate: int = 22050) -> DataFrame:
    """Power folded to pitch classes (C = 0), scaled by each frame's largest class."""
    pitch = F.pmod(F.round(F.log2(hertz(bins, sample_rate) / 440.0) * 12 + 69), F.lit(12)).cast("int")
    folded = power(spectrum.where("bin > 0")).groupBy("clip", "frame", pitch.alias("pc")).agg(F.sum("value").alias("value"))
    full = folded.groupBy("clip", "frame").agg(F.map_from_entries(F.collect_list(F.struct("pc", "value"))).alias("m"), F.max("value").alias("top"))
    pcs = full.select("clip", "frame", "m", "top", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("bin"))
    return pcs.select("clip", "frame", "bin", F.coalesce(F.try_divide(F.try_element_at("m", F.col("bin")), "top"), F.lit(0.0)).alias("value"))


def per_frame_share(cells: DataFrame) -> DataFrame:
    """L1-normalise each frame (a frame is at most a spectrum wide)."""
    total = F.sum(F.abs("value")).over(W.partitionBy("clip", "frame"))
    return cells.withColumn("value", F.coalesce(F.try_divide(F.col("value"), total), F.lit(0.0)))


def tonnetz(chroma_cells: DataFrame) -> DataFrame:
    return coef_join(per_frame_share(chroma_cells), tonnetz_basis(chroma_cells.sparkSession))


def centroid_bandwidth(spectrum: DataFrame, bins: int, sample_rate: int = 22050) -> DataFrame:
    """Centre of gravity of each spectrum and the spread around it, from three sums per frame."""
    f = hertz(bins, sample_rate)
    m = F.col("value")
    s = spectrum.groupBy("clip", "frame").agg(F.sum(m).alias("m0"), F.sum(m * f).alias("m1"), F.sum(m * f * f).alias("m2"))
    c = F.try_divide("m1", "m0")
    return s.select("clip", "frame", c.alias("centroid"), F.sqrt(F.greatest(F.try_divide("m2", "m0") - c * c, F.lit(0.0))).alias("bandwidth"))


def flatness(spectrum: DataFrame) -> DataFrame:
    p = F.greatest(F.lit(AMIN), F.col("value") * F.col("value"))
    return spectrum.groupBy("clip", "frame").agg((F.exp(F.avg(F.log(p))) / F.avg(p)).alias("value"))


def rolloff(spectrum: DataFrame, bins: int, share: float = 0.85, sample_rate: int = 22050) -> DataFrame:
    """Lowest frequency below which ``share`` of a frame's magnitude lies."""
    w = W.partitionBy("clip", "frame")
    cum = F.sum("value").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    marked = spectrum.withColumns({"_c": cum, "_t": F.sum("value").over(w)}).where(F.col("_c") >= F.col("_t") * share)
    return marked.groupBy("clip", "frame").agg(F.min(hertz(bins, sample_rate)).alias("value"))


def contrast(spectrum: DataFrame, bins: int, n_bands: int = 6, lowest: float = 200.0, share: float = 0.02, sample_rate: int = 22050) -> DataFrame:
    """Peak-to-valley distance in dB of each octave band: mean of the top against the bottom ``share``."""
    f = hertz(bins, sample_rate)
    band = F.when(f < lowest, 0).otherwise(F.least(F.floor(F.log2(f / lowest) + 1e-12) + 1, F.lit(n_bands))).cast("int")
    w = W.partitionBy("clip", "frame", "band")
    ranked = spectrum.withColumn("band", band).withColumns(
        {"_rn": F.row_number().over(w.orderBy("value", "bin")), "_n": F.count("*").over(w)}
    )
    take = F.greatest(F.lit(1), F.round(F.col("_n") * share))
    low = F.avg(F.when(F.col("_rn") <= take, F.col("value")))
    high = F.avg(F.when(F.col("_rn") > F.col("_n") - take, F.col("value")))

    def db(c: Column) -> Column:
        return F.log10(F.greatest(F.lit(AMIN), c)) * 10

    return ranked.groupBy("clip", "frame", F.col("band").alias("bin")).agg((db(high) - db(low)).alias("value"))


def spectral_flux(spectrum: DataFrame) -> DataFrame:
    """Onset strength: mean over bins of the rise since the previous frame."""
    rows, w = with_halo(spectrum, ["clip", "bin"], "frame", 1, 0)
    rise = F.greatest(F.lit(0.0), F.col("value") - F.lag("value").over(w))
    up = own_rows(rows.withColumn("_up", F.coalesce(rise, F.lit(0.0))))
    return up.groupBy("clip", "frame").agg(F.avg("_up").alias("value"))


def _weighted_neighbours(cells: DataFrame, weights: Sequence[float], keep_edges: bool) -> DataFrame:
    half = len(weights) // 2
    rows, w = with_halo(cells, ["clip", "bin"], "frame", half, half)
    total = F.lit(0.0)
    for k, wt in zip(range(-half, half + 1), weights):
        x = F.lead("value", k).over(w) if k > 0 else F.lag("value", -k).over(w) if k < 0 else F.col("value")
        total = total + F.lit(float(wt)) * (F.coalesce(x, F.lit(0.0)) if keep_edges else x)
    return own_rows(rows.withColumn("_s", total)).select("clip", "frame", "bin", F.col("_s").alias("value"))


def delta(cells: DataFrame, order: int = 1) -> DataFrame:
    """Slope (order 1) or curvature (order 2) of a least-squares parabola over nine frames, interior frames only."""
    ks = range(-4, 5)
    weights = [k / 60 for k in ks] if order == 1 else [(3 * k * k - 20) / 462 for k in ks]
    return _weighted_neighbours(cells, weights, keep_edges=False).where(F.col("value").isNotNull())


def cens(chroma_cells: DataFrame, smooth: int = 41) -> DataFrame:
    """Energy-normalised chroma: shares, quantised on a log scale, smoothed over time, unit length per frame."""
    q = F.lit(0.0)
    for step in (0.4, 0.2, 0.1, 0.05):
        q = q + F.when(F.col("value") > step, 0.25).otherwise(0.0)
    quantised = per_frame_share(chroma_cells).withColumn("value", q)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (smooth + 1)) for i in range(smooth)]
    soft = _weighted_neighbours(quantised, [h / sum(hann) for h in hann], keep_edges=True)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy("clip", "frame")))
    return soft.withColumn("value", F.coalesce(F.try_divide(F.col("value"), length), F.lit(0.0)))


def spec_mask(cells: DataFrame, bins: int, frames: int, epoch: int, seed: int = 42, freq: int = 16, time: int = 80, per: str = "clip") -> DataFrame:
    """Zero one random frequency band and one random time band per clip (or per batch)."""
    base = F.col("clip").cast("string") if per == "clip" else F.lit("batch")

    def draw(tag: str, modulus) -> Column:
        return hash_int(F.md5(F.concat(base, F.lit(f":{epoch}:{seed}:{tag}"))), modulus)

    fw, tw = draw("fw", freq + 1), draw("tw", time + 1)
    f0 = draw("f0", F.greatest(F.lit(1), F.lit(bins) - fw))
    t0 = draw("t0", F.greatest(F.lit(1), F.lit(frames) - tw))
    hidden = ((F.col("bin") >= f0) & (F.col("bin") < f0 + fw)) | ((F.col("frame") >= t0) & (F.col("frame") < t0 + tw))
    return cells.withColumn("value", F.when(hidden, 0.0).otherwise(F.col("value")))


# ---- statistics and feature vectors ---------------------------------------------------------


def frame_stats(series: DataFrame, keys: Sequence[str] = ("clip", "feature")) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"), F.min("value").alias("min")
    )


def frame_stats5(series: DataFrame, keys: Sequence[str] = ("clip", "feature")) -> DataFrame:
    keys = list(keys)
    return frame_stats(series, keys).join(exact_quantiles(series, keys, "value", {"median": 0.5}), keys)


def band_stats(cells: DataFrame, edges: Sequence[tuple[str, int]] = (("low", 43), ("mid", 86), ("high", 1 << 30))) -> DataFrame:
    """Mean, std and max of each range of mel bins (names with exclusive upper bin)."""
    band = None
    for name, upper in edges:
        test = F.col("bin") < upper
        band = F.when(test, name) if band is None else band.when(test, name)
    return cells.groupBy("clip", band.alias("band")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max")
    )


def feature_layout(kind: str = "basic") -> list[str]:
    """Feature names in vector order: 25 (``basic``) or 390 (``full``)."""
    if kind == "basic":
        names = [f"{f}_{s}" for f in ("spectral_centroid", "spectral_rolloff", "zcr", "mel_db", "mfcc", "chroma") for s in STATS4]
        return names + ["tempo"]
    stats5 = [*STATS4, "median"]
    names = [f"{f}_{s}" for f in ("spectral_centroid", "spectral_bandwidth", "spectral_flatness", "spectral_rolloff", "spectral_rolloff_99") for s in stats5]
    names += [f"spectral_contrast_{i}_{s}" for i in range(7) for s in STATS4[:2]]
    names += [f"{f}_{i}_{s}" for f in ("mfcc", "mfcc_delta", "mfcc_delta2") for i in range(20) for s in STATS4]
    names += [f"{f}_{i}_{s}" for f in ("chroma_stft", "chroma_cqt", "chroma_cens") for i in range(12) for s in STATS4[:2]]
    names += [f"mel_db_{s}" for s in stats5] + [f"mel_db_{b}_{s}" for b in ("low", "mid", "high") for s in STATS4[:3]]
    names += ["tempo", "onset_mean", "onset_std", "tempogram_mean", "tempogram_std"]
    names += [f"zcr_{s}" for s in STATS4]
    names += [f"tonnetz_{i}_{s}" for i in range(6) for s in STATS4[:2]]
    names += [f"rms_{s}" for s in STATS4]
    return names


def named_stats(stats: DataFrame, prefix: Column, columns: Sequence[str] = tuple(STATS4)) -> DataFrame:
    """Wide statistics -> ``(clip, name, value)``."""
    long = stats.withColumn("_p", prefix).unpivot(["clip", "_p"], list(columns), "_s", "value")
    return long.select("clip", F.concat_ws("_", "_p", "_s").alias("name"), "value")


def vector_assemble(named: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(clip, name, value)`` -> one fixed-width ordered array per clip; clips missing a feature drop out."""
    layout = small_table(named.sparkSession, [(n, i) for i, n in enumerate(names)], "name string, idx int")
    picked = named.join(layout, "name").groupBy("clip", "idx").agg(F.first("value", ignorenulls=True).alias("value"))
    rows = picked.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    return rows.where(F.size("s") == len(names)).select("clip", F.transform("s", lambda v: v["value"]).alias("features"))


def basic_features(samples: DataFrame, spectrum: DataFrame, bins: int, *, n_mels: int, n_coefs: int, frame: int, tempo: DataFrame) -> DataFrame:
    """The 25-wide vector: four statistics of six series, and the tempo."""

    def series(name: str, df: DataFrame, value: str = "value") -> DataFrame:
        return df.select("clip", F.lit(name).alias("feature"), F.col(value).alias("value"))

    parts = [
        series("spectral_centroid", centroid_bandwidth(spectrum, bins), "centroid"),
        series("spectral_rolloff", rolloff(spectrum, bins)),
        series("zcr", zero_crossing(samples, frame)),
        series("mel_db", power_to_db(mel_bands(spectrum, bins, n_mels))),
        series("mfcc", mfcc(spectrum, bins, n_mels, n_coefs)),
        series("chroma", chroma(spectrum, bins)),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    named = named_stats(frame_stats(every), F.col("feature")).unionByName(tempo.select("clip", F.lit("tempo").alias("name"), F.col("bpm").alias("value")))
    return vector_assemble(named, feature_layout("basic"))
