"""Constraint predicates over the catalogue. All are narrow and reach the scan where the source allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def by_artist(songs: DataFrame, artist: str) -> DataFrame:
    return songs.where(F.col("artist") == artist)


def tempo_above(songs: DataFrame, bpm: float = 120.0) -> DataFrame:
    return songs.where(F.col("tempo") > bpm)


def high_energy_dance(songs: DataFrame, energy: float = 0.7, danceability: float = 0.7) -> DataFrame:
    return songs.where((F.col("energy") >= energy) & (F.col("danceability") >= danceability))


def between_years(songs: DataFrame, lo: int, hi: int) -> DataFrame:
    return songs.where(F.col("release_year").between(lo, hi))


def outside_year_ranges(songs: DataFrame, ranges: Sequence[tuple[int, int]], year: str = "release_year") -> DataFrame:
    """Drop years inside any inclusive range; an unknown year is kept."""
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | F.col(year).between(lo, hi)
    return songs.where(~F.coalesce(hit, F.lit(False)))


def has_tag(songs: DataFrame, tag: str) -> DataFrame:
    return songs.where(F.array_contains(F.transform("tags", F.lower), tag.lower()))


def _overlaps(column: str, values: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(v.lower()) for v in values])
    return F.coalesce(F.arrays_overlap(F.transform(column, F.lower), wanted), F.lit(False))


def genre_include(songs: DataFrame, genres: Sequence[str]) -> DataFrame:
    return songs.where(_overlaps("genres", genres))


def genre_exclude(songs: DataFrame, genres: Sequence[str]) -> DataFrame:
    return songs.where(~_overlaps("genres", genres))


def word_search(lyrics: DataFrame, words: Sequence[str], tokens: Column, mode: str = "all") -> DataFrame:
    """Lyrics containing whole words (not substrings)."""
    tests = [F.array_contains(tokens, w.lower()) for w in words]
    hit = tests[0]
    for t in tests[1:]:
        hit = (hit & t) if mode == "all" else (hit | t)
    return lyrics.where(hit)


def include_exclude_terms(lyrics: DataFrame, include: Sequence[str], exclude: Sequence[str], tokens: Column) -> DataFrame:
    """All ``include`` words, none of the ``exclude`` words; ``explicit`` excludes flagged songs."""
    words = [w for w in exclude if w != "explicit"]
    if "explicit" in exclude:
        lyrics = lyrics.where(F.coalesce(F.col("explicit") != 1, F.lit(True)))
    if include:
        lyrics = word_search(lyrics, include, tokens)
    for w in words:
        lyrics = lyrics.where(~F.array_contains(tokens, w.lower()))
    return lyrics


def minor_upbeat(songs: DataFrame, energy: float = 0.6, valence: float = 0.6) -> DataFrame:
    return songs.where((F.col("song_mode") == 0) & (F.col("energy") >= energy) & (F.col("valence") >= valence))


def fuzzy_tempo(songs: DataFrame, bpm: float, tolerance: float = 2.0, octaves: bool = True) -> DataFrame:
    """Tempo within an inclusive tolerance, optionally also at half and double speed."""
    targets = [bpm, bpm / 2, bpm * 2] if octaves else [bpm]
    hit = F.lit(False)
    for b in targets:
        hit = hit | F.col("tempo").between(b - tolerance, b + tolerance)
    return songs.where(hit)


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Reject a vector holding NULL, NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad)


def long_enough(clips: DataFrame, n_samples: Column, sample_rate: int) -> DataFrame:
    """Keep clips of at least one second."""
    return clips.where(n_samples >= sample_rate)


def relative_to_seed(songs: DataFrame, seed_id: int, feature: str, direction: str) -> DataFrame:
    """Candidates strictly below (``less``) or above (``more``) the seed in one feature."""
    seed = songs.where(F.col("song_id") == seed_id).select(feature).scalar()
    test = F.col(feature) < seed if direction == "less" else F.col(feature) > seed
    return songs.where(test & (F.col("song_id") != seed_id))


def split_corrupt(df: DataFrame, ok: Column, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readable rows, quarantined rows, and how many of each there are per split."""
    flagged = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    counts = flagged.groupBy(by).agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"))
    return flagged.where("ok").drop("ok"), flagged.where(~F.col("ok")).drop("ok"), counts
