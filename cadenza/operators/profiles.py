"""Artist profiles and what is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.knn import knn, self_knn
from cadenza.operators.ordered import exact_quantiles
from cadenza.operators.prep import standard_scale
from cadenza.operators.ranking import top_k


def artist_profile(songs: DataFrame, features: Sequence[str], by: str = "artist") -> DataFrame:
    """Mean features, song count, year range and genre set per artist; key and mode by majority."""
    base = songs.groupBy(by).agg(
        *[F.avg(f).alias(f) for f in features],
        F.count("*").alias("n_songs"),
        F.min("release_year").alias("first_year"),
        F.max("release_year").alias("last_year"),
        F.array_sort(F.collect_set("genre")).alias("genres"),
    )
    for cat in ("song_key", "song_mode"):
        counts = songs.groupBy(by, cat).agg(F.count("*").alias("_n"))
        base = base.join(counts.groupBy(by).agg(F.max_by(cat, F.struct("_n", -F.col(cat))).alias(cat)), by)
    return base


def artist_medians(songs: DataFrame, features: Sequence[str], by: str = "artist") -> DataFrame:
    long = songs.unpivot([by], list(features), "feature", "value")
    med = exact_quantiles(long, [by, "feature"], "value", {"median": 0.5})
    return med.groupBy(by).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f) for f in features])


def artist_variances(songs: DataFrame, features: Sequence[str], by: str = "artist") -> DataFrame:
    return songs.groupBy(by).agg(*[F.var_pop(f).alias(f) for f in features])


def shrunk_profile(songs: DataFrame, features: Sequence[str], by: str = "artist", m: float = 5.0) -> DataFrame:
    """Means pulled towards the catalogue mean in proportion to how few songs an artist has."""
    overall = songs.agg(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    per = songs.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    return per.withColumns({f: (F.col("n") * F.col(f) + overall[f] * m) / (F.col("n") + m) for f in features})


def artist_histogram(songs: DataFrame, feature: str, by: str = "artist", bins: int = 10) -> DataFrame:
    """Counts in equal-width bins over the catalogue's range of a feature."""
    r = songs.agg(F.struct(F.min(feature).alias("lo"), F.max(feature).alias("hi"))).scalar()
    width = (r["hi"] - r["lo"]) / bins
    b = F.least(F.floor((F.col(feature) - r["lo"]) / width), F.lit(bins - 1)).cast("int")
    return songs.where(F.col(feature).isNotNull()).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))


def packed(df: DataFrame, id_col: str, features: Sequence[str], name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), F.array(*features).alias("v"))


def nearest_profiles(songs: DataFrame, profiles: DataFrame, features: Sequence[str], k: int, by: str = "artist") -> DataFrame:
    """The k nearest artist profiles of every song."""
    return knn(
        packed(songs, "song_id", features, "song_id"), packed(profiles, by, features, by), k, query_id="song_id", candidate_id=by
    )


def similar_artists(profiles: DataFrame, features: Sequence[str], k: int, metric: str = "euclidean", by: str = "artist") -> DataFrame:
    """The k most similar artists of every artist over z-scored profiles."""
    z = packed(standard_scale(profiles, features), by, features, by)
    other = z.withColumnRenamed(by, "neighbour")
    return knn(z, other, k, query_id=by, candidate_id="neighbour", metric=metric, exclude_self=True)


def method_accuracy(songs: DataFrame, features: Sequence[str], by: str = "artist") -> DataFrame:
    """Share of songs whose nearest profile is their own artist, per way of summarising an artist.

    ``variance`` measures from the mean in units of each artist's own spread.
    """
    z = standard_scale(songs, features)
    q = packed(z, "song_id", features, "song_id")
    mean = z.groupBy(by).agg(*[F.avg(f).alias(f) for f in features])
    var = artist_variances(z, features, by).select(by, F.array(*[1.0 / (F.col(f) + 1e-9) for f in features]).alias("w"))
    layouts = {
        "mean": (packed(mean, by, features, by), None),
        "median": (packed(artist_medians(z, features, by), by, features, by), None),
        "variance": (packed(mean, by, features, by).join(var, by), "w"),
    }
    truth = songs.select("song_id", F.col(by).alias("truth"))
    out = None
    for name, (prof, weight) in layouts.items():
        near = knn(q, prof, 1, query_id="song_id", candidate_id=by, weight=weight).join(truth, "song_id")
        row = near.agg(F.lit(name).alias("method"), F.avg((F.col(by) == F.col("truth")).cast("double")).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def vote_artist(neighbours: DataFrame, query: str, artist: str = "artist") -> DataFrame:
    """Most common artist among neighbours; ties by smaller mean distance, then by name."""
    per = neighbours.groupBy(query, artist).agg(F.count("*").alias("n"), F.round(F.avg("distance"), 9).alias("_d"))
    return per.groupBy(query).agg(F.min_by(artist, F.struct(-F.col("n"), F.col("_d"), F.col(artist))).alias(artist))


def song_to_artist(songs: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Artist of every song by vote of its k nearest other songs."""
    z = standard_scale(songs, features)
    near = self_knn(packed(z, "song_id", features, "song_id"), k, id_col="song_id")
    named = near.join(songs.select(F.col("song_id").alias("neighbour"), "artist"), "neighbour")
    return vote_artist(named, "song_id")


def knn_cross_validation(vectors: DataFrame, id_col: str, label: str, ks: Sequence[int], folds: int = 5, seed: int = 42) -> DataFrame:
    """Accuracy of every k over hashed folds. One kNN pass per fold at the largest k serves all k."""
    from cadenza.functions.hashing import hash_int, seeded_hash

    rows = vectors.withColumn("fold", hash_int(seeded_hash(id_col, seed), folds))
    out = None
    for f in range(folds):
        near = knn(
            rows.where(F.col("fold") == f).select(F.col(id_col).alias("q"), "v"),
            rows.where(F.col("fold") != f).select(F.col(id_col).alias("c"), "v"), max(ks),
        ).select("q", "c", "distance", "rank")
        out = near if out is None else out.unionByName(near)
    lab = rows.select(F.col(id_col).alias("c"), F.col(label).alias("vote"))
    truth = rows.select(F.col(id_col).alias("q"), F.col(label).alias("truth"))
    votes = out.join(lab, "c").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    per = votes.groupBy("k", "q", "vote").agg(F.count("*").alias("n"))
    won = per.groupBy("k", "q").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("pred"))
    return won.join(truth, "q").groupBy("k").agg(F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * n_c)`` per class."""
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    t = per.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("c"))).scalar()
    return per.withColumn("weight", t["n"] / (t["c"] * F.col("n")))


def same_genre_lists(songs: DataFrame, k: int) -> DataFrame:
    """For every artist and genre the k most popular songs of that genre by other artists.

    Of one artist at most k songs can stand before the wanted ones, so the 2k best songs of a genre
    with at most k per artist always contain the answer: no song is paired with a whole genre.
    """
    order = [F.col("popularity").desc(), F.col("song_id")]
    capped = top_k(songs, ["genre", "artist"], order, k, "_r")
    pool = top_k(capped, ["genre"], order, 2 * k, "_p").select("genre", F.col("artist").alias("other"), "song_id", "popularity")
    seeds = songs.select("genre", "artist").distinct()
    pairs = seeds.join(pool, "genre").where(F.col("artist") != F.col("other"))
    return top_k(pairs, ["genre", "artist"], order, k)
