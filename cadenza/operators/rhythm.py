"""Tempo, beats, groove, sessions and conversation windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.musical import tempo_class
from cadenza.operators.ordered import chunk_scan, exact_quantiles, own_rows, range_chunks, with_halo
from cadenza.session import shuffle_width


CHUNK = 8192  # steps of a clip that one task works on together


def dense_envelope(onsets: DataFrame) -> DataFrame:
    """Fill the silent steps between a clip's first and last onset with zero strength."""
    span = onsets.groupBy("clip").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    # chunk by chunk, so that no row ever holds all steps of a long clip
    chunks = span.select("clip", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor(F.col("hi") / CHUNK))).alias("_c"))
    first, last = F.greatest("lo", (F.col("_c") * CHUNK).cast("int")), F.least("hi", ((F.col("_c") + 1) * CHUNK - 1).cast("int"))
    steps = chunks.select("clip", F.explode(F.sequence(first, last)).alias("t"))
    return steps.join(onsets, ["clip", "t"], "left").select("clip", "t", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def centred(envelope: DataFrame) -> DataFrame:
    mean = envelope.groupBy("clip").agg(F.avg("strength").alias("_m"))
    return envelope.join(mean, "clip").select("clip", "t", (F.col("strength") - F.col("_m")).alias("strength"))


def by_chunk(envelope: DataFrame, before: int, after: int, work: Callable[[np.ndarray, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """``work(line, start, stop)`` on every chunk of every clip: ``line[start:stop]`` are its own steps, beside them neighbours.

    ``line`` begins ``before`` steps ahead of the chunk and ends ``after`` steps behind it; steps that a clip does not
    have count as 0. ``work`` returns the columns of ``schema`` after the clip, with ``t`` counted from the chunk's start.
    """
    size = max(CHUNK, before + after)
    sent, _ = with_halo(envelope.select("clip", F.col("t").cast("bigint").alias("t"), "strength"), ["clip"], "t", before, after, size)
    kind = dict(envelope.dtypes)["clip"]
    timed = "t " in schema

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[1]) * size
        own = rows["_own"].to_numpy()
        if not own.any():
            return pd.DataFrame(columns=["clip", *[f.split()[0] for f in schema.split(", ")]], dtype=object)
        t = rows["t"].to_numpy()
        start, stop = int(t[own].min()) - base, int(t[own].max()) - base + 1
        line = np.zeros(before + size + after)
        inside = (t >= base - before) & (t < base + size + after)
        line[t[inside] - base + before] = rows["strength"].to_numpy(dtype=float)[inside]
        out = work(line, before + start, before + stop)
        if timed:
            out["t"] += base + start
        out.insert(0, "clip", [key[0]] * len(out))
        return out

    # a number of partitions of its own: by the few bytes of steps alone, many clips would be merged into one task
    return sent.repartition(shuffle_width(sent), "clip", "_chunk").groupBy("clip", "_chunk").applyInPandas(run, f"clip {kind}, {schema}")


def lag_products(line: np.ndarray, start: int, stop: int, max_lag: int, direct: int = 256) -> np.ndarray:
    """Sum over the own steps of the product with the step ``k`` earlier, for k = 0 to ``max_lag``.

    Few lags are summed one by one; for many an FFT of the chunk with the steps ahead of it (overlap-save) gives all at a
    cost that hardly depends on their number.
    """
    own = line[start:stop]
    if max_lag <= direct:
        return np.array([own @ line[start - k : stop - k] for k in range(max_lag + 1)])
    seen = line[start - max_lag : stop]
    n = 1 << (2 * len(seen)).bit_length()
    both = np.fft.irfft(np.fft.rfft(own[::-1], n) * np.fft.rfft(seen, n), n)
    # sums of whole numbers are whole; the FFT's rounding stays far below a half
    if np.linalg.norm(own) * np.linalg.norm(seen) < 1e9 and (seen == np.rint(seen)).all():
        both = np.rint(both)
    # the product at shift s pairs own[i] with seen[i + s]; lag k is shift max_lag - k
    return both[len(own) - 1 : len(own) + max_lag][::-1]


def autocorrelation(envelope: DataFrame, max_lag: int, direct: int = 256) -> DataFrame:
    """``(clip, lag, ac)`` for lags 0..max_lag: one row of sums per chunk and lag is all that leaves a chunk."""

    def work(line: np.ndarray, start: int, stop: int) -> pd.DataFrame:
        return pd.DataFrame({"lag": np.arange(max_lag + 1), "ac": lag_products(line, start, stop, max_lag, direct)})

    return by_chunk(envelope, max_lag, 0, work, "lag int, ac double").groupBy("clip", "lag").agg(F.sum("ac").alias("ac"))


def _best_lag(scores: DataFrame, lo: int, hi: int, score: str) -> DataFrame:
    ranged = scores.where(F.col("lag").between(lo, hi)).withColumn("_s", F.round(score, 9))
    return ranged.groupBy("clip").agg(F.max_by("lag", F.struct("_s", -F.col("lag"))).alias("lag"), F.max("_s").alias("score"))


def tempo_autocorr(ac: DataFrame, lo: int, hi: int, step_seconds: float) -> DataFrame:
    """Beats per minute of the lag with the largest autocorrelation; ties go to the shorter lag."""
    return _best_lag(ac, lo, hi, "ac").select("clip", "lag", (F.lit(60.0) / (F.col("lag") * step_seconds)).alias("bpm"), "score")


def tempo_comb(ac: DataFrame, lo: int, hi: int, step_seconds: float, teeth: int = 4) -> DataFrame:
    """Comb filter: the lag whose first ``teeth`` multiples carry the most autocorrelation."""
    base = ac.where(F.col("lag") >= lo).select("clip", F.col("lag").alias("at"), "ac")
    votes = base.select("clip", "at", "ac", F.explode(F.sequence(F.lit(1), F.lit(teeth))).alias("m")).where(F.col("at") % F.col("m") == 0)
    scores = votes.groupBy("clip", (F.col("at") / F.col("m")).cast("int").alias("lag")).agg(F.sum("ac").alias("comb"))
    return _best_lag(scores, lo, hi, "comb").select("clip", "lag", (F.lit(60.0) / (F.col("lag") * step_seconds)).alias("bpm"), "score")


def tempo_result(ac: DataFrame, lo: int, hi: int, step_seconds: float) -> DataFrame:
    """``{bpm, confidence, tempo_class}`` per clip; confidence is the share of the lag-0 energy."""
    zero = ac.where("lag = 0").select("clip", F.col("ac").alias("_e"))
    t = tempo_autocorr(ac, lo, hi, step_seconds).join(zero, "clip")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("score", "_e"), F.lit(0.0))))
    return t.select("clip", "bpm", conf.alias("confidence"), tempo_class(F.col("bpm")).alias("tempo_class"))


def tempogram(envelope: DataFrame, max_lag: int, window: int) -> DataFrame:
    """Local autocorrelation ``(clip, t, lag, value)`` over a centred window, scaled by each step's maximum.

    Running sums of the products give every window from two of them, however wide it is.
    """
    half = window // 2

    def work(line: np.ndarray, start: int, stop: int) -> pd.DataFrame:
        lo, hi = start - half, stop + half
        products = np.stack([line[lo:hi] * line[lo - k : hi - k] for k in range(max_lag + 1)], axis=1)
        sums = np.concatenate([np.zeros((1, max_lag + 1)), np.cumsum(products, axis=0)])
        local = sums[2 * half + 1 :] - sums[: -2 * half - 1]
        # what is left of a window without products is 0, not rounding
        local[np.abs(local) <= 1e-12 * np.abs(products).max(initial=0.0)] = 0.0
        top = np.abs(local).max(axis=1, keepdims=True)
        value = np.divide(local, top, out=np.zeros_like(local), where=top > 0)
        steps, lags = np.indices(value.shape)
        return pd.DataFrame({"t": steps.ravel(), "lag": lags.ravel(), "value": value.ravel()})

    return by_chunk(envelope, max_lag + half, half, work, "t int, lag int, value double")


def onset_density(envelope: DataFrame, unit: int) -> DataFrame:
    """Onsets (local maxima above mean + one deviation) per ``unit`` steps of every clip."""
    level = envelope.groupBy("clip").agg((F.avg("strength") + F.stddev_pop("strength")).alias("_min"))
    rows, w = with_halo(envelope, ["clip"], "t", 1, 1)
    s = F.col("strength")
    peak = (s > F.coalesce(F.lag("strength").over(w), F.lit(0.0))) & (s >= F.coalesce(F.lead("strength").over(w), F.lit(0.0)))
    marked = own_rows(rows.withColumn("_peak", peak)).join(level, "clip")
    return marked.groupBy("clip", F.floor(F.col("t") / unit).cast("int").alias("unit")).agg(F.count_if(F.col("_peak") & (s > F.col("_min"))).alias("onsets"))


# ---- beats ----------------------------------------------------------------------------------


def _micros(ts: str) -> Column:
    """Microseconds on the zone-less clock, so no session time zone can shift an interval."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


DAY = 86_400_000_000  # microseconds: the width of a chunk of time before full ones are cut


def number_beats(events: DataFrame, key: str = "clip", ts: str = "ts", tie: str = "event_id", target: int = 200_000) -> DataFrame:
    """Beats numbered from 1 per clip with the seconds since the previous beat."""
    cut = range_chunks(events, [key], _micros(ts), tie, DAY, target=target)
    out = chunk_scan(cut, [key], [F.col(ts), F.col(tie)], F.col("_range"), number="beat_no", previous={"_prev": _micros(ts)})
    return out.withColumn("interval", (_micros(ts) - F.col("_prev")) / F.lit(1e6)).drop("_prev", "_range")


def inter_beat_interval(beats: DataFrame) -> DataFrame:
    """Median interval and the tempo it implies."""
    med = exact_quantiles(beats, ["clip"], "interval", {"median_interval": 0.5})
    return med.withColumn("bpm", F.try_divide(F.lit(60.0), "median_interval"))


def tempo_confidence(beats: DataFrame) -> DataFrame:
    """One minus the coefficient of variation of the intervals, clipped to [0, 1]; below a half is ambiguous."""
    s = beats.groupBy("clip").agg(F.avg("interval").alias("m"), F.stddev_pop("interval").alias("s"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("s", "m")))
    return s.select("clip", conf.alias("confidence")).withColumn("ambiguous", F.coalesce(F.col("confidence") < 0.5, F.lit(True)))


def swing_ratio(beats: DataFrame, threshold: float = 1.3) -> DataFrame:
    """Mean odd over mean even interval between beats; at least ``threshold`` is swung."""
    odd = F.avg(F.when(F.col("beat_no") % 2 == 0, F.col("interval")))
    even = F.avg(F.when(F.col("beat_no") % 2 == 1, F.col("interval")))
    return beats.groupBy("clip").agg(F.try_divide(odd, even).alias("ratio")).withColumn("swung", F.coalesce(F.col("ratio") >= threshold, F.lit(False)))


# Accent period -> meter.
METERS = {3: "3/4", 4: "4/4", 6: "6/8"}


def meter_class(beats: DataFrame, accent: str = "value") -> DataFrame:
    """Meter whose period shows the largest autocorrelation of beat accents.

    Summed, not averaged, over the beats: a bar of three also repeats after six, and the sum prefers
    the period that more beats confirm.
    """
    mean = beats.groupBy("clip").agg(F.avg(accent).alias("_m"))
    c = beats.join(mean, "clip").select("clip", "beat_no", (F.col(accent) - F.col("_m")).alias("a"))
    rows, w = with_halo(c, ["clip"], "beat_no", max(METERS), 0)
    lagged = own_rows(rows.withColumns({f"_l{p}": F.lag("a", p).over(w) for p in METERS}))
    scores = lagged.groupBy("clip").agg(*[F.round(F.sum(F.col("a") * F.col(f"_l{p}")), 9).alias(str(p)) for p in METERS])
    entries = [F.struct(F.coalesce(F.col(str(p)), F.lit(-1e300)).alias("s"), F.lit(-p).alias("n"), F.lit(m).alias("meter")) for p, m in METERS.items()]
    return scores.select("clip", F.array_max(F.array(*entries))["meter"].alias("meter"))


# ---- sessions and conversations -------------------------------------------------------------


def session_split(log: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", gap_seconds: int = 1800, target: int = 200_000) -> DataFrame:
    """Session number per user: a new one starts after a silence longer than the gap."""
    order = [F.col(ts), F.col(tie)]
    cut = range_chunks(log, [user], _micros(ts), tie, DAY, target=target)
    with_prev = chunk_scan(cut, [user], order, F.col("_range"), previous={"_prev": _micros(ts)})
    starts = F.when(F.col("_prev").isNull() | (_micros(ts) - F.col("_prev") > gap_seconds * 1_000_000), 1).otherwise(0)
    flagged = with_prev.withColumn("_new", starts)
    return chunk_scan(flagged, [user], order, F.col("_range"), running={"session": F.col("_new")}).drop("_prev", "_new", "_range")


def context_window(turns: DataFrame, budget: int, last: int | None = None) -> DataFrame:
    """The latest turns of every conversation whose texts fit a character budget together."""
    back = turns.withColumn("_back", -F.col("turn"))
    out = chunk_scan(
        back, ["conv_id"], [F.col("_back")], F.floor(F.col("_back") / 256), number="age", running={"used": F.length("text").cast("bigint")}
    ).where(F.col("used") <= budget)
    if last:
        out = out.where(F.col("age") <= last)
    return out.drop("_back")


def mean_vectors(items: DataFrame, keys: Sequence[str], vector: str, width: int | None = None) -> DataFrame:
    """Component-wise mean vector per key, combined map-side, as wide as the key's widest vector.

    A row holds all sums of a key: unfolded into components, rows and keys would be shuffled once per component. ``width``
    spares a look at all items for their widest vector.
    """
    if width is None:
        width = items.select(F.max(F.size(vector))).first()[0] or 0
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(width)]
    every = items.groupBy(*keys).agg(F.max(F.size(vector)).alias("_n"), F.array(*means).cast("array<double>").alias("_m"))
    return every.where("_n > 0").select(*keys, F.slice("_m", F.lit(1), F.col("_n")).alias("v"))
