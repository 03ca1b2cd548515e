"""Scaling, splitting, imputing and normalising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.hashing import hash_fraction, seeded_hash
from cadenza.functions.text import normal_name
from cadenza.operators.ordered import hash_ranked
from cadenza.session import sized


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Z-scores from the population deviation of the fitting rows; a constant column is only centred.

    The fitted parameters are a one-row aggregate read as a scalar subquery, so the data itself is
    never shuffled.
    """
    fit = df if fit_on is None else df.where(fit_on)
    params = fit.agg(
        F.struct(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    ).scalar()
    out = {}
    for c in columns:
        s = params[f"s_{c}"]
        out[c] = (F.col(c) - params[f"m_{c}"]) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return df.withColumns(out)


def minmax_scale(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Scale by the range of the fitting rows, unclipped; a constant column becomes 0."""
    fit = df if fit_on is None else df.where(fit_on)
    params = fit.agg(
        F.struct(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    out = {}
    for c in columns:
        lo, span = params[f"lo_{c}"], params[f"hi_{c}"] - params[f"lo_{c}"]
        out[c] = (F.col(c) - lo) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return df.withColumns(out)


def global_norm(cells: DataFrame, value: str, fit_on: Column | None = None) -> DataFrame:
    """One mean and variance over all cells of all fitting rows."""
    fit = cells if fit_on is None else cells.where(fit_on)
    p = fit.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))).scalar()
    return cells.withColumn(value, (F.col(value) - p["m"]) / F.greatest(p["s"], F.lit(1e-12)))


def in_share(id_col: str, share: float, seed: int = 42) -> Column:
    """True for a hashed ``share`` of the ids: a train mask that needs no ranking."""
    return hash_fraction(seeded_hash(id_col, seed)) < share


def stratified_split(df: DataFrame, id_col: str, label: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Exact train/val/test shares within every class, by seeded hash order."""
    ranked = hash_ranked(df, [label], seeded_hash(id_col, seed), id_col, number="_rn", total="_cnt")
    a = F.floor(F.col("_cnt") * train)
    b = a + F.floor(F.col("_cnt") * val)
    split = F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rn", "_cnt")


def random_split(df: DataFrame, id_col: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """A random permutation cut at ``int(train N)`` and ``int(val N)``."""
    ranked = hash_ranked(df, [], seeded_hash(id_col, seed), id_col, number="_rn", total="_cnt")
    a = F.floor(F.col("_cnt") * train)
    b = a + F.floor(F.col("_cnt") * val)
    split = F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rn", "_cnt")


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows with their position in a seeded shuffle."""
    return hash_ranked(df, [], seeded_hash(id_col, seed), id_col, number="position")


def batch_assemble(df: DataFrame, id_col: str, size: int = 16, seed: int = 42, drop_remainder: bool = False) -> DataFrame:
    """Shuffled rows with a batch number and a slot inside the batch."""
    ranked = hash_ranked(df, [], seeded_hash(id_col, seed), id_col, number="_rn", total="_cnt")
    out = ranked.withColumns(
        {
            "batch": F.floor((F.col("_rn") - 1) / size).cast("bigint"),
            "slot": ((F.col("_rn") - 1) % size).cast("bigint"),
        }
    )
    if drop_remainder:
        out = out.where(F.col("batch") < F.floor(F.col("_cnt") / size))
    return out.drop("_rn", "_cnt")


def steps_per_epoch(df: DataFrame, by: str, size: int = 16) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.ceil(F.count("*") / size).cast("bigint").alias("steps"))


def label_encode(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Alphabetical class numbers from 0; only the distinct labels are ordered."""
    from cadenza.operators.ordered import chunk_scan

    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = chunk_scan(names, [], [F.col(label)], F.substring(label, 1, 2), number=code)
    return df.join(sized(ranked.select(label, (F.col(code) - 1).cast("int").alias(code))), label, "left")


def impute_missing(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Fill NULL and NaN by the group mean, then by the overall mean."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
    overall = clean.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    means = clean.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = clean.join(sized(means), group, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}"), overall[c]) for c in columns}
    return out.withColumns(filled).drop(*[f"_m_{c}" for c in columns])


def entity_keys(names: DataFrame, name: str) -> DataFrame:
    """Surrogate keys for distinct normalised names: the rank in md5 order, from 0."""
    distinct = names.select(normal_name(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    return hash_ranked(distinct, [], F.md5("name"), "name", number="key").withColumn("key", F.col("key") - 1)


def normalize_entities(songs: DataFrame) -> dict[str, DataFrame]:
    """Artists, genres and tags with surrogate keys, and the bridge tables to songs."""
    artists = entity_keys(songs.select("artist"), "artist")
    genres = entity_keys(songs.select(F.explode("genres").alias("g")), "g")
    tags = entity_keys(songs.select(F.explode("tags").alias("t")), "t")

    def bridge(column: str, entity: DataFrame) -> DataFrame:
        pairs = songs.select("song_id", F.explode(column).alias("_v")).select("song_id", normal_name("_v").alias("name")).distinct()
        return pairs.join(entity, "name").select("song_id", "key")

    return {
        "artist": artists,
        "genre": genres,
        "tag": tags,
        "song_genre": bridge("genres", genres),
        "song_tag": bridge("tags", tags),
        "song": songs.withColumn("name", normal_name("artist"))
        .join(artists.withColumnRenamed("key", "artist_key"), "name")
        .select("song_id", "title", "artist_key", "release_year", "popularity"),
    }


def gold_subset(df: DataFrame, id_col: str, group: str, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` rows spread evenly over the groups, round-robin in hash order."""
    from pyspark.sql import Window as W

    digest = seeded_hash(id_col, seed)
    ranked = df.withColumn("_d", digest).withColumn("round", F.row_number().over(W.partitionBy(group).orderBy("_d", id_col)))
    return ranked.where(F.col("round") <= n).orderBy("round", group).limit(n).drop("_d")
