"""Similarity against one seed: everything stays in JVM columns and one top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cadenza.functions.distance import weighted_euclid
from cadenza.operators.filters import genre_exclude, outside_year_ranges
from cadenza.operators.prep import standard_scale


def rank_against_seed(scaled: DataFrame, candidates: DataFrame, seed_id, weights: Mapping[str, float], k: int, id_col: str = "song_id") -> DataFrame:
    """``k`` nearest candidates by weighted distance to the seed; ties go to the smaller id.

    Distances are ranked at nine decimals so that the order does not hang on summation order.
    """
    names = list(weights)
    seed = scaled.where(F.col(id_col) == seed_id).select(F.struct(*names)).scalar()
    d = weighted_euclid({f: (F.col(f), seed[f]) for f in names}, weights)
    ranked = candidates.where(F.col(id_col) != seed_id).withColumn("_d", F.round(d, 9)).where(F.col("_d").isNotNull())
    top = ranked.orderBy("_d", id_col).limit(k)
    return top.withColumn("distance", F.round("_d", 6)).drop("_d")


def playlist(
    songs: DataFrame,
    seed_id: int,
    weights: Mapping[str, float],
    k: int = 10,
    exclude_genres: Sequence[str] = (),
    exclude_years: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """Constraint filter -> whole-catalogue z-scores -> weighted distance to the seed -> top k."""
    scaled = standard_scale(songs, list(weights))
    cands = scaled
    if exclude_genres:
        cands = genre_exclude(cands, exclude_genres)
    if exclude_years:
        cands = outside_year_ranges(cands, exclude_years)
    return rank_against_seed(scaled, cands, seed_id, weights, k)
