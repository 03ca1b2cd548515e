"""Audio tables, rhythm, sessions and conversation windows."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from cadenza.operators import audio, rhythm, soundvector
from cadenza.plans.analytics import rounded
from cadenza.plans.catalogue import r6
from cadenza.plans.registry import query
from cadenza.session import cut_lineage, scratch_path, small_table
from cadenza.sources import files

BINS, MELS, COEFS = 8, 6, 4  # size of the spectra in the given tables

# ---- DuckDB building blocks -----------------------------------------------------------------

_HZ = "(bin * 22050 / 14.0::double)"
_MEL_HZ = "(case when {m} < 15 then {m} * 200 / 3.0::double else 1000 * exp(({m} - 15) * ln(6.4::double) / 27) end)"
_EDGE = "((15 + ln(11.025::double) * 27 / ln(6.4::double)) * {i} / 7)"


def _edge(i: str) -> str:
    return _MEL_HZ.format(m=_EDGE.format(i=i))


_BASIS = (
    "melw as (select bin, coef, greatest(0, least((f-lo)/(mid-lo), (hi-f)/(hi-mid))) * 2 / (hi-lo) as w from (select b.range as bin, m.range as coef, b.range * 22050 / 14.0::double as f, "
    f"{_edge('m.range')} as lo, {_edge('(m.range + 1)')} as mid, {_edge('(m.range + 2)')} as hi from range(8) b, range(6) m))"
)
_MEL = f"{_BASIS}, mel as (select clip, frame, coef as bin, sum(value*value*w) as value from frames join melw using (bin) group by 1, 2, 3)"
_DB = "greatest(10*log10(greatest(1e-10, value)), 10*log10(greatest(1e-10, max(value) over (partition by clip))) - 80)"
_MELDB = f"{_MEL}, meldb as (select clip, frame, bin, {_DB} - 10*log10(greatest(1e-10, max(value) over (partition by clip))) as value from mel)"
_MFCC = (
    f"{_MEL}, mellog as (select clip, frame, bin, {_DB} as value from mel), dctw as (select b.range as bin, k.range as coef, "
    "sqrt((case when k.range = 0 then 1 else 2 end) / 6.0::double) * cos(pi() * k.range * (2*b.range+1) / 12.0::double) as w from range(6) b, range(4) k), "
    "mfcc as (select clip, frame, coef as bin, sum(value*w) as value from mellog join dctw using (bin) group by 1, 2, 3)"
)
_CHROMA = (
    f"pcs as (select clip, frame, cast(round(log2({_HZ} / 440) * 12 + 69) as int) % 12 as pc, sum(value*value) as value from frames where bin > 0 group by 1, 2, 3), "
    "chroma as (select f.clip, f.frame, p.range as bin, coalesce(pcs.value / nullif(f.top, 0), 0) as value from (select clip, frame, max(value) as top from pcs group by 1, 2) f cross join range(12) p "
    "left join pcs on pcs.clip = f.clip and pcs.frame = f.frame and pcs.pc = p.range)"
)
_SHARE = "coalesce(value / nullif(sum(abs(value)) over (partition by clip, frame), 0), 0)"
_CENT = f"cent as (select clip, frame, sum(value*{_HZ})/sum(value) as centroid, sum(value*{_HZ}*{_HZ})/sum(value) as m2 from frames group by 1, 2)"


def _roll(share: float, name: str = "roll") -> str:
    return (
        f"{name} as (select clip, frame, min({_HZ}) as value from (select *, sum(value) over (partition by clip, frame order by bin) as c, sum(value) over (partition by clip, frame) as t from frames) "
        f"where c >= t * {share}::double group by 1, 2)"
    )


_ZCR = (
    "zcr as (select clip, cast(t // 8 as int) as frame, avg(case when p is not null and (p >= 0) <> (x >= 0) then 1.0::double else 0 end) as value from "
    "(select clip, t, x, lag(x) over (partition by clip order by t) as p from samples) group by 1, 2)"
)
_FLUX = (
    "flux as (select clip, frame, avg(coalesce(greatest(0, value - p), 0)) as value from (select clip, frame, bin, value, lag(value) over (partition by clip, bin order by frame) as p from frames) group by 1, 2)"
)


def _ac(env: str, lags: int) -> str:
    return (
        f"lagged as (select e.clip, l.range as lag, coalesce(sum(e.strength * f.strength), 0) as ac from {env} e cross join range({lags + 1}) l "
        f"left join {env} f on f.clip = e.clip and f.t = e.t - l.range group by 1, 2)"
    )


_DENSE = (
    "dense as (select s.clip, cast(s.t as int) as t, coalesce(o.strength, 0) as strength from (select clip, unnest(range(lo, hi + 1)) as t from (select clip, min(t) as lo, max(t) as hi from onsets group by 1)) s "
    "left join onsets o on o.clip = s.clip and o.t = s.t), cen as (select clip, t, strength - avg(strength) over (partition by clip) as strength from dense)"
)
_STEP = 0.05
_LO, _HI, _LAGS = 5, 40, 80
_TEMPO = (
    f"{_DENSE}, {_ac('cen', _LAGS)}, best as (select clip, lag, s as score from (select clip, lag, round(ac,9) as s, row_number() over (partition by clip order by round(ac,9) desc, lag) as rn "
    f"from lagged where lag between {_LO} and {_HI}) where rn = 1)"
)
_CLASS = (
    "case when bpm < 60 then 'Largo' when bpm < 76 then 'Adagio' when bpm < 108 then 'Andante' when bpm < 120 then 'Moderato' when bpm < 156 then 'Allegro' when bpm < 176 then 'Vivace' else 'Presto' end"
)


def _coefs(c) -> DataFrame:
    """Sixteen frames of four coefficients per clip."""
    return c.samples.select(
        "clip", F.floor(F.col("t") / 4).cast("int").alias("frame"), (F.col("t") % 4).cast("int").alias("bin"), F.col("x").alias("value")
    )


_COEFS = "coefs as (select clip, cast(t // 4 as int) as frame, cast(t % 4 as int) as bin, x as value from samples)"

# ---- framing and spectra --------------------------------------------------------------------


@query(
    "frame_signal",
    "select clip, cast(f.range as int) as frame, cast(t - f.range * 8 as int) as n, round(x,6) as x from samples, range(7) f where t between f.range * 8 and f.range * 8 + 15",
)
def frame_signal(c):
    return rounded(audio.frame_signal(c.samples, 16, 8), "x")


@query(
    "stft_mag",
    "with fr as (select clip, f.range as frame, t - f.range * 8 as n, x * (0.5 - 0.5*cos(2*pi()*(t - f.range * 8)/16)) as x from samples, range(7) f where t between f.range * 8 and f.range * 8 + 15) "
    "select clip, cast(frame as int) as frame, cast(k.range as int) as bin, round(sqrt(sum(x*cos(2*pi()*k.range*n/16))**2 + sum(x*sin(2*pi()*k.range*n/16))**2),6) as value from fr, range(9) k group by 1, 2, 3",
)
def stft_mag(c):
    return rounded(audio.stft_magnitude(audio.frame_signal(c.samples, 16, 8), 16), "value")


@query("rms", "select clip, cast(f.range as int) as frame, round(sqrt(avg(x*x)),6) as value from samples, range(7) f where t between f.range * 8 and f.range * 8 + 15 group by 1, 2")
def rms(c):
    return rounded(audio.rms(audio.frame_signal(c.samples, 16, 8)), "value")


@query("zero_crossing", f"with {_ZCR} select clip, frame, round(value,6) as value from zcr")
def zero_crossing(c):
    return rounded(audio.zero_crossing(c.samples, 8), "value")


@query("mel_bands", f"with {_MEL} select clip, frame, cast(bin as int) as bin, round(value,6) as value from mel")
def mel_bands(c):
    return rounded(audio.mel_bands(c.frames, BINS, MELS), "value")


@query("power_to_db", f"with {_MELDB} select clip, frame, cast(bin as int) as bin, round(value,6) as value from meldb")
def power_to_db(c):
    return rounded(audio.power_to_db(audio.mel_bands(c.frames, BINS, MELS)), "value")


@query("mfcc", f"with {_MFCC} select clip, frame, cast(bin as int) as bin, round(value,6) as value from mfcc")
def mfcc(c):
    return rounded(audio.mfcc(c.frames, BINS, MELS, COEFS), "value")


@query(
    "coef_join",
    "with d as (select b.range as bin, k.range as coef, sqrt((case when k.range = 0 then 1 else 2 end) / 8.0::double) * cos(pi() * k.range * (2*b.range+1) / 16.0::double) as w from range(8) b, range(8) k) "
    "select clip, frame, cast(coef as int) as bin, round(sum(value*w),6) as value from frames join d using (bin) group by 1, 2, 3",
)
def coef_join(c):
    return rounded(audio.coef_join(c.frames, audio.dct_basis(c.spark, 8, 8)), "value")


@query("chroma", f"with {_CHROMA} select clip, frame, cast(bin as int) as bin, round(value,6) as value from chroma")
def chroma(c):
    return rounded(audio.chroma(c.frames, BINS), "value")


@query(
    "tonnetz",
    f"with {_CHROMA}, sh as (select clip, frame, bin, {_SHARE} as value from chroma), tw as (select p.range as bin, k.range as coef, (case when k.range < 4 then 1.0::double else 0.5 end) * "
    "cos(pi() * ((case when k.range < 2 then 7/6.0::double when k.range < 4 then 1.5::double else 2/3.0::double end) * p.range - case when k.range % 2 = 0 then 0.5::double else 0 end)) as w from range(12) p, range(6) k) "
    "select clip, frame, cast(coef as int) as bin, round(sum(value*w),6) as value from sh join tw using (bin) group by 1, 2, 3",
)
def tonnetz(c):
    return rounded(audio.tonnetz(audio.chroma(c.frames, BINS)), "value")


@query("centroid", f"with {_CENT} select clip, frame, round(centroid,4) as centroid from cent")
def centroid(c):
    return audio.centroid_bandwidth(c.frames, BINS).select("clip", "frame", F.round("centroid", 4).alias("centroid"))


@query(
    "bandwidth",
    f"with {_CENT} select f.clip, f.frame, round(sqrt(sum(value*({_HZ}-centroid)**2)/sum(value)),4) as bandwidth from frames f join cent using (clip, frame) group by 1, 2",
)
def bandwidth(c):
    return audio.centroid_bandwidth(c.frames, BINS).select("clip", "frame", F.round("bandwidth", 4).alias("bandwidth"))


@query("flatness", "select clip, frame, round(exp(avg(ln(greatest(1e-10, value*value)))) / avg(greatest(1e-10, value*value)),6) as value from frames group by 1, 2")
def flatness(c):
    return rounded(audio.flatness(c.frames), "value")


@query("rolloff", f"with {_roll(0.85)} select clip, frame, value from roll")
def rolloff(c):
    return audio.rolloff(c.frames, BINS)


@query(
    "contrast",
    f"with b as (select clip, frame, value, bin, case when {_HZ} < 200 then 0 else cast(least(floor(log2({_HZ} / 200) + 1e-12) + 1, 6) as int) end as band from frames), "
    "r as (select *, row_number() over (partition by clip, frame, band order by value, bin) as rn, count(*) over (partition by clip, frame, band) as n from b) "
    "select clip, frame, band as bin, round(10*log10(greatest(1e-10, avg(value) filter (rn > n - greatest(1, round(n*0.02))))) - 10*log10(greatest(1e-10, avg(value) filter (rn <= greatest(1, round(n*0.02))))),6) as value from r group by 1, 2, 3",
)
def contrast(c):
    return rounded(audio.contrast(c.frames, BINS), "value")


@query("spectral_flux", f"with {_FLUX} select clip, frame, round(value,6) as value from flux")
def spectral_flux(c):
    return rounded(audio.spectral_flux(c.frames), "value")


def _delta_sql(weight: str) -> str:
    return (
        f"with {_COEFS} select a.clip, a.frame, a.bin, round(sum(b.value * {weight}),6) as value from coefs a join coefs b on a.clip = b.clip and a.bin = b.bin and b.frame between a.frame - 4 and a.frame + 4 "
        "group by 1, 2, 3 having count(*) = 9"
    )


@query("delta1", _delta_sql("(b.frame - a.frame) / 60.0::double"))
def delta1(c):
    return rounded(audio.delta(_coefs(c), 1), "value")


@query("delta2", _delta_sql("(3*(b.frame - a.frame)**2 - 20) / 462.0::double"))
def delta2(c):
    return rounded(audio.delta(_coefs(c), 2), "value")


@query(
    "cens_smooth",
    f"with {_CHROMA}, q as (select clip, frame, bin, case when s > 0.4 then 1.0::double when s > 0.2 then 0.75 when s > 0.1 then 0.5 when s > 0.05 then 0.25 else 0 end as value from (select clip, frame, bin, {_SHARE} as s from chroma)), "
    "sm as (select a.clip, a.frame, a.bin, sum(b.value * (0.5 - 0.5*cos(2*pi()*(b.frame - a.frame + 3)/6.0::double)) / 3) as value from q a join q b on a.clip = b.clip and a.bin = b.bin and b.frame between a.frame - 2 and a.frame + 2 group by 1, 2, 3) "
    "select clip, frame, cast(bin as int) as bin, round(coalesce(value / nullif(sqrt(sum(value*value) over (partition by clip, frame)), 0), 0),6) as value from sm",
)
def cens_smooth(c):
    return rounded(audio.cens(audio.chroma(c.frames, BINS), 5), "value")


def _draw(tag: str, modulus: str) -> str:
    return f"cast(('0x' || substr(md5(clip || ':1:42:{tag}'),1,7)) as bigint) % ({modulus})"


@query(
    "spec_mask",
    f"with d as (select *, {_draw('fw', '4')} as fw, {_draw('tw', '5')} as tw from frames), e as (select *, {_draw('f0', 'greatest(1, 8 - fw)')} as f0, {_draw('t0', 'greatest(1, 8 - tw)')} as t0 from d) "
    "select clip, frame, bin, case when (bin >= f0 and bin < f0 + fw) or (frame >= t0 and frame < t0 + tw) then 0 else value end as value from e",
)
def spec_mask(c):
    return audio.spec_mask(c.frames, 8, 8, epoch=1, freq=3, time=4)


@query(
    "pad_trim",
    "select vec_id, cast(n as int) as n, round(list_sum(list_transform(p, lambda x: cast(x as double))),6) as total, p[n] as last from (select vec_id, n, list_resize(embedding, n, 0::float) as p from embeddings, (values (40),(80)) v(n))",
)
def pad_trim(c):
    parts = []
    for n in (40, 80):
        p = audio.pad_trim(F.col("embedding"), n)
        p = F.transform(p, lambda x: x.cast("float"))
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double"))
        parts.append(c.vectors.select("vec_id", F.lit(n).alias("n"), r6(total).alias("total"), F.element_at(p, n).alias("last")))
    return parts[0].unionByName(parts[1])


# ---- statistics and vectors -----------------------------------------------------------------


def _series(c):
    return c.frames.select("clip", F.lit("spectrum").alias("feature"), F.col("bin").alias("coef"), "frame", "value")


_S4 = "round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(max(value),6) as max, round(min(value),6) as min"


@query("frame_stats", f"select clip, 'spectrum' as feature, {_S4} from frames group by 1")
def frame_stats(c):
    return rounded(audio.frame_stats(_series(c)), *audio.STATS4)


@query("frame_stats5", f"select clip, 'spectrum' as feature, {_S4}, round(median(value),6) as median from frames group by 1")
def frame_stats5(c):
    return rounded(audio.frame_stats5(_series(c)), *audio.STATS4, "median")


@query("coef_stats2", "select clip, 'spectrum' as feature, bin as coef, round(avg(value),6) as mean, round(stddev_pop(value),6) as std from frames group by 1, 3")
def coef_stats2(c):
    out = audio.frame_stats(_series(c), ["clip", "feature", "coef"])
    return rounded(out, "mean", "std").select("clip", "feature", "coef", "mean", "std")


@query("coef_stats4", f"select clip, 'spectrum' as feature, bin as coef, {_S4} from frames group by 1, 3")
def coef_stats4(c):
    return rounded(audio.frame_stats(_series(c), ["clip", "feature", "coef"]), *audio.STATS4)


@query(
    "band_stats",
    "select clip, case when bin < 3 then 'low' when bin < 6 then 'mid' else 'high' end as band, round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(max(value),6) as max from frames group by 1, 2",
)
def band_stats(c):
    return rounded(audio.band_stats(c.frames, (("low", 3), ("mid", 6), ("high", 8))), "mean", "std", "max")


def _flux_tempo(c):
    env = audio.spectral_flux(c.frames).select("clip", F.col("frame").alias("t"), F.col("value").alias("strength"))
    return rhythm.tempo_autocorr(rhythm.autocorrelation(rhythm.centred(env), 4), 1, 4, 0.5)


def _basic(c):
    return audio.basic_features(c.samples, c.frames, BINS, n_mels=MELS, n_coefs=COEFS, frame=8, tempo=_flux_tempo(c))


_FLUX_TEMPO = (
    f"{_FLUX}, fe as (select clip, frame as t, value - avg(value) over (partition by clip) as strength from flux), {_ac('fe', 4)}, "
    "ft as (select clip, 60 / (lag * 0.5::double) as bpm from (select clip, lag, row_number() over (partition by clip order by round(ac,9) desc, lag) as rn from lagged where lag between 1 and 4) where rn = 1)"
)
_SERIES = ["spectral_centroid", "spectral_rolloff", "zcr", "mel_db", "mfcc", "chroma"]
_VECTOR = (
    f"{_MFCC}, meldb as (select clip, frame, bin, {_DB} - 10*log10(greatest(1e-10, max(value) over (partition by clip))) as value from mel), {_CHROMA}, {_CENT}, {_roll(0.85)}, {_ZCR}, {_FLUX_TEMPO}, "
    "allv as (select clip, 0 as f, centroid as value from cent union all select clip, 1, value from roll union all select clip, 2, value from zcr union all select clip, 3, value from meldb union all "
    "select clip, 4, value from mfcc union all select clip, 5, value from chroma), st as (select clip, f, avg(value) as m, stddev_pop(value) as s, max(value) as hi, min(value) as lo from allv group by 1, 2), "
    "vec as (select clip, f*4 as idx, m as value from st union all select clip, f*4+1, s from st union all select clip, f*4+2, hi from st union all select clip, f*4+3, lo from st union all select clip, 24, bpm from ft)"
)


@query("vector_assemble", f"with {_VECTOR} select clip, cast(idx as int) as idx, round(value,4) as value from vec")
def vector_assemble(c):
    return _basic(c).select("clip", F.posexplode("features").alias("idx", "value")).withColumn("value", F.round("value", 4))


_NAMES = " ".join(f"when {i} then '{n}'" for i, n in enumerate(audio.feature_layout("basic")))


@query(
    "feature_names",
    f"with {_VECTOR} select cast(idx as int) as idx, case idx {_NAMES} end as name, count(*) as clips, round(avg(value),4) as mean from vec group by 1, 2",
)
def feature_names(c):
    names = small_table(c.spark, list(enumerate(audio.feature_layout("basic"))), "idx int, name string")
    long = _basic(c).select("clip", F.posexplode("features").alias("idx", "value"))
    return long.join(names, "idx").groupBy("idx", "name").agg(F.count("*").alias("clips"), F.round(F.avg("value"), 4).alias("mean"))


# ---- the wide vector ------------------------------------------------------------------------

# frames of 16 samples every 4: 13 frames a clip, five of them with all nine frames of a delta
_WIDE = {"window": 16, "hop": 4, "smooth": 5, "lags": (1, 4), "tempogram_window": 4}
_WIDE_HZ = "(bin * 22050 / 16.0::double)"
_WIDE_EDGE = "((15 + ln(11.025::double) * 27 / ln(6.4::double)) * {i} / 129)"


def _wide_edge(i: str) -> str:
    return _MEL_HZ.format(m=_WIDE_EDGE.format(i=i))


def _wide_delta(name: str, weight: str) -> str:
    return (
        f"select a.clip, '{name}_' || a.coef as p, 'four' as kind, sum(b.value * {weight}) as value from mfcc a join mfcc b on a.clip = b.clip and a.coef = b.coef and b.frame between a.frame - 4 and a.frame + 4 "
        "group by a.clip, a.coef, a.frame having count(*) = 9"
    )


_WIDE_SQL = (
    "with fr as (select clip, f.range as frame, t - f.range * 4 as n, x, x * (0.5 - 0.5*cos(2*pi()*(t - f.range * 4)/16)) as xw from samples, range(13) f where t between f.range * 4 and f.range * 4 + 15), "
    "sp as (select clip, frame, cast(k.range as int) as bin, sqrt(sum(xw*cos(2*pi()*k.range*n/16))**2 + sum(xw*sin(2*pi()*k.range*n/16))**2) as m from fr, range(9) k group by 1, 2, 3), "
    f"ce as (select clip, frame, sum(m*{_WIDE_HZ})/sum(m) as c, sum(m*{_WIDE_HZ}*{_WIDE_HZ})/sum(m) as m2 from sp group by 1, 2), "
    f"ro as (select clip, frame, share, min({_WIDE_HZ}) as value from (select *, sum(m) over (partition by clip, frame order by bin) as c, sum(m) over (partition by clip, frame) as t from sp), (values (0.85::double), (0.99::double)) h(share) where c >= t * share group by 1, 2, 3), "
    f"bd as (select clip, frame, m, bin, case when {_WIDE_HZ} < 200 then 0 else cast(least(floor(log2({_WIDE_HZ} / 200) + 1e-12) + 1, 6) as int) end as band from sp), "
    "rk as (select *, row_number() over (partition by clip, frame, band order by m) as rn, count(*) over (partition by clip, frame, band) as n from bd), "
    "co as (select clip, frame, band, 10*log10(greatest(1e-10, avg(m) filter (rn > n - greatest(1, round(n*0.02))))) - 10*log10(greatest(1e-10, avg(m) filter (rn <= greatest(1, round(n*0.02))))) as value from rk group by 1, 2, 3), "
    "mw as (select bin, coef, greatest(0, least((f-lo)/(mid-lo), (hi-f)/(hi-mid))) * 2 / (hi-lo) as w from (select b.range as bin, m.range as coef, b.range * 22050 / 16.0::double as f, "
    f"{_wide_edge('m.range')} as lo, {_wide_edge('(m.range + 1)')} as mid, {_wide_edge('(m.range + 2)')} as hi from range(9) b, range(128) m)), "
    "ml as (select clip, frame, coef, 10*log10(greatest(1e-10, sum(m*m*w))) as v from sp join mw using (bin) group by 1, 2, 3), "
    "lg as (select clip, frame, coef, greatest(v, max(v) over (partition by clip) - 80) as v, max(v) over (partition by clip) as top from ml), "
    "dw as (select b.range as b, k.range as k, sqrt((case when k.range = 0 then 1 else 2 end) / 128.0::double) * cos(pi() * k.range * (2*b.range+1) / 256.0::double) as w from range(128) b, range(20) k), "
    "mfcc as (select clip, frame, k as coef, sum(v*w) as value from lg join dw on lg.coef = dw.b group by 1, 2, 3), "
    "tu as (select clip, t, case when p is not null and (p >= 0) <> (x >= 0) then 1.0::double else 0 end as v from (select clip, t, x, lag(x) over (partition by clip order by t) as p from samples)), "
    "rs as (select clip, frame, bin, greatest(0, m - lag(m) over (partition by clip, bin order by frame)) as up from sp), "
    "ser as (select clip, 'spectral_centroid' as p, 'five' as kind, c as value from ce union all select clip, 'spectral_bandwidth', 'five', sqrt(greatest(m2 - c*c, 0)) from ce union all "
    "select clip, 'spectral_flatness', 'five', exp(avg(ln(greatest(1e-10, m*m)))) / avg(greatest(1e-10, m*m)) from sp group by clip, frame union all "
    "select clip, case when share < 0.9 then 'spectral_rolloff' else 'spectral_rolloff_99' end, 'five', value from ro union all "
    "select clip, 'spectral_contrast_' || band, 'two', value from co union all select clip, 'spectral_contrast_' || e.b, 'two', 0.0::double from ce, (values (1), (2)) e(b) union all "
    "select clip, 'mfcc_' || coef, 'four', value from mfcc union all "
    + _wide_delta("mfcc_delta", "(b.frame - a.frame) / 60.0::double") + " union all " + _wide_delta("mfcc_delta2", "(3*(b.frame - a.frame)**2 - 20) / 462.0::double") + " union all "
    "select clip, 'mel_db', 'five', v - top from lg union all select clip, case when coef < 43 then 'mel_db_low' when coef < 86 then 'mel_db_mid' else 'mel_db_high' end, 'three', v - top from lg union all "
    "select clip, 'onset', 'two', avg(coalesce(up, 0)) from rs group by clip, frame union all select clip, 'zcr', 'four', avg(v) from tu where t < 52 group by clip, t // 4 union all "
    "select clip, 'rms', 'four', sqrt(avg(x*x)) from fr group by clip, frame), "
    "st as (select clip, p, kind, avg(value) as mean, stddev_pop(value) as std, max(value) as max, min(value) as min, median(value) as median from ser group by 1, 2, 3) "
    "select clip, p || '_' || s.name as name, round(case s.name when 'mean' then mean when 'std' then std when 'max' then max when 'min' then min else median end, 4) as value "
    "from st join (values ('mean', 1), ('std', 2), ('max', 3), ('min', 4), ('median', 5)) s(name, pos) on s.pos <= case kind when 'five' then 5 when 'four' then 4 when 'three' then 3 else 2 end"
)


def _wide(c):
    return soundvector.full_features(c.samples, **_WIDE)


@query("vector_full")
def vector_full(c):
    """All 390 values; ``vector_full_told`` has those that SQL can say."""
    return _wide(c).select("clip", F.posexplode("features").alias("idx", "value")).withColumn("value", F.round("value", 4))


@query("vector_full_told", _WIDE_SQL)
def vector_full_told(c):
    told = [(i, n) for i, n in enumerate(audio.feature_layout("full")) if not n.startswith(("chroma", "tonnetz", "tempo"))]
    names = small_table(c.spark, told, "idx int, name string")
    return vector_full(c).join(names, "idx").select("clip", "name", "value")


# ---- tempo ----------------------------------------------------------------------------------


def _envelope(c):
    return rhythm.centred(rhythm.dense_envelope(c.onsets))


def _autocorr(c):
    return rhythm.autocorrelation(_envelope(c), _LAGS)


@query("tempo_autocorr", f"with {_TEMPO} select clip, cast(lag as int) as lag, round(60/(lag*{_STEP}::double),6) as bpm, round(score,6) as score from best")
def tempo_autocorr(c):
    return rounded(rhythm.tempo_autocorr(_autocorr(c), _LO, _HI, _STEP), "bpm", "score")


@query(
    "tempo_comb",
    f"with {_DENSE}, {_ac('cen', _LAGS)}, comb as (select a.clip, a.lag, round(sum(b.ac),9) as s from lagged a join lagged b on a.clip = b.clip and b.lag in (a.lag, 2*a.lag, 3*a.lag, 4*a.lag) "
    f"where a.lag between {_LO} and {_HI} group by 1, 2), best as (select *, row_number() over (partition by clip order by s desc, lag) as rn from comb) "
    f"select clip, cast(lag as int) as lag, round(60/(lag*{_STEP}::double),6) as bpm, round(s,6) as score from best where rn = 1",
)
def tempo_comb(c):
    return rounded(rhythm.tempo_comb(_autocorr(c), _LO, _HI, _STEP), "bpm", "score")


_RESULT = (
    f"with {_TEMPO}, t as (select b.clip, 60/(b.lag*{_STEP}::double) as bpm, greatest(0, least(1, coalesce(score / nullif(z.ac, 0), 0))) as confidence from best b join lagged z on z.clip = b.clip and z.lag = 0) "
    f"select clip, round(bpm,6) as bpm, round(confidence,6) as confidence, {_CLASS} as tempo_class from t"
)


@query("tempo_result", _RESULT)
def tempo_result(c):
    return rounded(rhythm.tempo_result(_autocorr(c), _LO, _HI, _STEP), "bpm", "confidence")


@query("tempo_batch", _RESULT)
def tempo_batch(c):
    env = cut_lineage(_envelope(c))

    def compute(clips: DataFrame) -> DataFrame:
        todo = env.join(clips.select("clip"), "clip", "left_semi")
        return rhythm.tempo_result(rhythm.autocorrelation(todo, _LAGS), _LO, _HI, _STEP)

    path = scratch_path(c.spark, "tempo")
    clips = env.select("clip").distinct()
    compute(clips.where("clip < 'm'")).write.parquet(path)
    return rounded(files.cached_features(clips, "clip", path, compute), "bpm", "confidence")


@query(
    "tempogram",
    f"with {_DENSE}, p as (select a.clip, a.t, l.range as lag, coalesce(a.strength * b.strength, 0) as p from dense a cross join range(9) l left join dense b on b.clip = a.clip and b.t = a.t - l.range), "
    "s as (select clip, t, lag, sum(p) over (partition by clip, lag order by t rows between 12 preceding and 12 following) as v from p) "
    "select clip, t, cast(lag as int) as lag, round(coalesce(v / nullif(max(abs(v)) over (partition by clip, t), 0), 0),6) as value from s",
)
def tempogram(c):
    return rounded(rhythm.tempogram(rhythm.dense_envelope(c.onsets), 8, 24), "value")


@query(
    "onset_density",
    f"with {_DENSE}, p as (select *, coalesce(lag(strength) over (partition by clip order by t), 0) as b, coalesce(lead(strength) over (partition by clip order by t), 0) as a, "
    "avg(strength) over (partition by clip) + stddev_pop(strength) over (partition by clip) as lv from dense) select clip, cast(t // 24 as int) as unit, count(*) filter (strength > b and strength >= a and strength > lv) as onsets from p group by 1, 2",
)
def onset_density(c):
    return rhythm.onset_density(rhythm.dense_envelope(c.onsets), 24)


# ---- beats ----------------------------------------------------------------------------------

_IBI = "ibi as (select clip, beat_no, value, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by clip order by beat_no)) / 1e6 as interval from beats)"


def _beats(c):
    return rhythm.number_beats(c.beat_events)


@query(
    "inter_beat_interval",
    f"with {_IBI} select clip, round(median(interval),6) as median_interval, round(60 / median(interval),9) as bpm from ibi where interval is not null group by 1",
)
def inter_beat_interval(c):
    return rounded(rhythm.inter_beat_interval(_beats(c)), "median_interval").withColumn("bpm", F.round("bpm", 9))


@query("beat_numbers", f"with {_IBI} select clip, beat_no, round(interval,6) as interval from ibi")
def beat_numbers(c):
    return rounded(_beats(c), "interval").select("clip", "beat_no", "interval")


@query(
    "tempo_confidence",
    f"with {_IBI}, x as (select clip, greatest(0, least(1, 1 - stddev_pop(interval) / avg(interval))) as confidence from ibi group by 1) select clip, round(confidence,6) as confidence, coalesce(confidence < 0.5, true) as ambiguous from x",
)
def tempo_confidence(c):
    return rounded(rhythm.tempo_confidence(_beats(c)), "confidence")


@query(
    "swing_ratio",
    f"with {_IBI}, x as (select clip, avg(interval) filter (beat_no % 2 = 0) / avg(interval) filter (beat_no % 2 = 1) as ratio from ibi group by 1) select clip, round(ratio,6) as ratio, coalesce(ratio >= 1.3, false) as swung from x",
)
def swing_ratio(c):
    return rounded(rhythm.swing_ratio(_beats(c)), "ratio")


@query(
    "meter_class",
    "with a as (select clip, beat_no, value - avg(value) over (partition by clip) as v from beats), s as (select a.clip, p.p, round(sum(a.v * b.v),9) as s from a join a b on a.clip = b.clip join (values (3),(4),(6)) p(p) on b.beat_no = a.beat_no - p.p group by 1, 2), "
    "r as (select clip, p, row_number() over (partition by clip order by s desc, p) as rn from s) select clip, case p when 3 then '3/4' when 4 then '4/4' else '6/8' end as meter from r where rn = 1",
)
def meter_class(c):
    return rhythm.meter_class(_beats(c))


# ---- sessions and conversations -------------------------------------------------------------


def _session_sql(gap: int) -> str:
    return (
        f"sess as (select event_id, user_id, ts, sum(n) over (partition by user_id order by ts, event_id) as session from (select *, case when p is null or epoch_us(ts) - p > {gap} * 1000000::bigint then 1 else 0 end as n from "
        "(select event_id, user_id, ts, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from requests)))"
    )


@query("session_split", f"with {_session_sql(1800)} select event_id, user_id, cast(session as bigint) as session from sess")
def session_split(c):
    return rhythm.session_split(c.requests).select("event_id", "user_id", "session")


@query(
    "context_window",
    "select conv_id, turn, used, age from (select conv_id, turn, cast(sum(length(text)) over (partition by conv_id order by turn desc) as bigint) as used, row_number() over (partition by conv_id order by turn desc) as age from turns) where used <= 1500 and age <= 6",
)
def context_window(c):
    return rhythm.context_window(c.turns, 1500, 6).select("conv_id", "turn", "used", "age")


@query(
    "followup_similar",
    f"with {_session_sql(172800)}, it as (select user_id, session, cast(e.embedding as double[]) as v from sess join embeddings e on e.vec_id = event_id % (select count(*) from embeddings)), "
    "m as (select user_id, session, list(a order by i) as v from (select user_id, session, i, avg(x) as a from (select user_id, session, generate_subscripts(v,1) as i, unnest(v) as x from it) group by 1, 2, 3) group by 1, 2), "
    "r as (select user_id, cast(session as bigint) as session, vec_id, row_number() over (partition by user_id, session order by round(1 - list_cosine_similarity(v, cast(embedding as double[])),9), vec_id) as rank from m, embeddings) "
    "select user_id, session, vec_id, rank from r where rank <= 3",
)
def followup_similar(c):
    from cadenza.operators.knn import knn

    sess = rhythm.session_split(c.requests, gap_seconds=172800)
    many = c.vectors.agg(F.count("*")).scalar()
    items = sess.select("user_id", "session", (F.col("event_id") % many).alias("vec_id")).join(c.vectors, "vec_id")
    width = c.vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    means = rhythm.mean_vectors(items, ["user_id", "session"], "embedding", width)
    q = means.select(F.concat_ws(":", "user_id", "session").alias("q"), "v")
    near = knn(q, c.vectors.select(F.col("vec_id"), F.col("embedding").alias("v")), 3, candidate_id="vec_id", metric="cosine")
    parts = F.split("q", ":")
    return near.select(parts[0].cast("bigint").alias("user_id"), parts[1].cast("bigint").alias("session"), "vec_id", "rank")



