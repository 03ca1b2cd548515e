"""Joins that answer catalogue questions, written so that no group is paired with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.text import normal_name
from cadenza.session import shuffle_width


def deletion_variants(name: Column, depth: int = 2) -> Column:
    """The name with up to ``depth`` characters deleted.

    Two strings within that edit distance always share a variant, which turns fuzzy matching into an
    equality join with no blocking key that could miss a pair.
    """

    def shorter(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        )

    level = F.array(name)
    out = level
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def masked_names(names: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """``(name, t, at, v, ch)``: every way to take ``t <= depth`` characters ``ch`` off their places ``at``, leaving ``v``.

    Two names of one length differ in t places exactly if they share one row's ``at`` and ``v`` while every character of
    ``ch`` differs, so pairs by substitution are met once each and none in vain.
    """
    s = F.col(name)
    level = F.array(F.struct(F.lit(0).alias("t"), F.lit(1).alias("last"), F.lit("").alias("at"), s.alias("v"), F.lit("").alias("ch")))
    out = level
    for t in range(1, depth + 1):

        def shorter(e: Column) -> Column:
            v, last = e["v"], e["last"]
            places = F.when(F.length(v) >= last, F.sequence(last, F.length(v))).otherwise(F.array().cast("array<int>"))
            return F.transform(
                places,
                lambda i: F.struct(
                    F.lit(t).alias("t"),
                    i.alias("last"),
                    F.concat(e["at"], i.cast("string"), F.lit(",")).alias("at"),
                    F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))).alias("v"),
                    F.concat(e["ch"], F.substring(v, i, F.lit(1))).alias("ch"),
                ),
            )

        level = F.flatten(F.transform(level, shorter))
        out = F.concat(out, level)
    # few bytes but much work per name: spread them over all tasks
    spread = names.where(s.isNotNull()).repartition(shuffle_width(names), name)
    return spread.select(name, F.inline(out)).drop("last")


def substituted(left: DataFrame, right: DataFrame, depth: int = 2) -> DataFrame:
    """``(a, b, edits)`` for names ``left.a`` and ``right.b`` of one length that differ in at most ``depth`` places, once each."""
    # many pairs from few bytes: as many tasks as a shuffle has
    lm, rm = (masked_names(df, n, depth).repartition(shuffle_width(df), "at", "v") for df, n in ((left, "a"), (right, "b")))
    met = lm.withColumnRenamed("ch", "_ca").drop("t").join(rm.withColumnRenamed("ch", "_cb"), ["at", "v"])
    for p in range(1, depth + 1):
        met = met.where((F.col("t") < p) | (F.substring("_ca", p, 1) != F.substring("_cb", p, 1)))
    # from three places on, shifting may take fewer edits
    return met.select("a", "b", (F.when(F.col("t") <= 2, F.col("t")).otherwise(F.levenshtein("a", "b")) if depth > 2 else F.col("t")).alias("edits"))


def _variants(names: DataFrame, name: str, drops: int) -> DataFrame:
    """``(name, _v)``: the distinct strings left when ``drops`` characters, or all of a shorter name, are deleted."""
    rows = masked_names(names, name, drops).where(F.col("t") == F.least(F.lit(drops), F.length(name)))
    # dealt by the string that is left, which serves the distinct rows and the join
    return rows.select(name, F.col("v").alias("_v")).repartition(shuffle_width(names), "_v").distinct()


def shifted(left: DataFrame, right: DataFrame, depth: int = 2) -> DataFrame:
    """``(a, b, edits)`` for names within ``depth`` edits that ``substituted`` does not meet, once each.

    An edit script of s substitutions, i insertions and d deletions leaves the same string when s + d characters are
    deleted from one name and s + i from the other. Further characters may go from both. Names of one length need an
    insertion and a deletion here, so ``depth - 1`` deletions each are enough; of lengths n and n + x the shorter needs
    ``depth - x`` and the longer ``depth``.
    """
    found = None
    if depth > 1:
        same = _variants(left, "a", depth - 1).join(_variants(right, "b", depth - 1), "_v").where(F.length("a") == F.length("b"))
        found = same.select("a", "b")
    for short, long, n, m in ((left, right, "a", "b"), (right, left, "b", "a")):
        lengths = short.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda x: F.length(n) + x)).alias("_n")).distinct()
        longer = long.withColumn("_n", F.length(m)).join(lengths, "_n", "left_semi").drop("_n")
        less = None
        for x in range(1, depth + 1):
            part = _variants(short, n, depth - x)
            less = part if less is None else less.unionByName(part)
        cross = less.repartition(shuffle_width(short), "_v").distinct().join(_variants(longer, m, depth), "_v").where(F.length(n) < F.length(m)).select("a", "b")
        found = cross if found is None else found.unionByName(cross)
    # names that differ in few places are not met again
    differ = lambda i: (F.substring(F.col("a"), i, F.lit(1)) != F.substring(F.col("b"), i, F.lit(1))).cast("int")
    apart = F.aggregate(F.sequence(F.lit(1), F.length("a")), F.lit(0), lambda s, i: s + differ(i))
    found = found.where((F.length("a") != F.length("b")) | (apart > depth)).distinct()
    return found.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= depth)


def close_names(left: DataFrame, right: DataFrame, depth: int = 2) -> DataFrame:
    """``(a, b, edits)`` for distinct names ``left.a`` and ``right.b`` within ``depth`` edits."""
    return substituted(left, right, depth).unionByName(shifted(left, right, depth))


def seed_lookup(wanted: DataFrame, request: str, typed: str, names: DataFrame, id_col: str, name: str, popularity: str) -> DataFrame:
    """Resolve typed names: equal normal forms first, then the closest within two edits.

    Ties go to the more popular entity, then to the smaller id.
    """
    w = wanted.select(request, normal_name(typed).alias("a"))
    n = names.select(id_col, normal_name(name).alias("b"), popularity)
    best = F.min_by(id_col, F.struct(-F.col(popularity), F.col(id_col)))
    by_name = n.groupBy("b").agg(best.alias(id_col), F.max(popularity).alias(popularity))
    exact = w.join(by_name.withColumnRenamed("b", "a"), "a", "left")
    found = exact.where(F.col(id_col).isNotNull()).select(request, id_col, F.lit(0).alias("edits"))
    rest = exact.where(F.col(id_col).isNull()).select(request, "a")
    near = close_names(rest.select("a").distinct(), by_name.select("b")).join(by_name, "b")
    pick = near.groupBy("a").agg(F.min_by(F.struct(id_col, "edits"), F.struct("edits", -F.col(popularity), id_col)).alias("_p"))
    fuzzy = rest.join(pick, "a", "left").select(request, F.col(f"_p.{id_col}").alias(id_col), F.col("_p.edits").alias("edits"))
    return found.unionByName(fuzzy)


def same_album(albums: DataFrame, seed: int) -> DataFrame:
    """Songs that share an album with the seed, with the number of shared albums."""
    mine = albums.where(F.col("song_id") == seed).select("album_id").distinct()
    return (
        albums.where(F.col("song_id") != seed)
        .join(mine, "album_id", "left_semi")
        .select("album_id", "song_id")
        .distinct()
        .groupBy("song_id")
        .agg(F.count("*").alias("shared_albums"))
    )


def collaborators(albums: DataFrame, artist: int) -> DataFrame:
    """Artists credited on the seed artist's albums, with the number of shared albums."""
    mine = albums.where(F.col("credited_artist") == artist).select("album_id").distinct()
    return (
        albums.where(F.col("credited_artist") != artist)
        .join(mine, "album_id", "left_semi")
        .select("album_id", "credited_artist")
        .distinct()
        .groupBy("credited_artist")
        .agg(F.count("*").alias("shared_albums"))
    )


def band_join(queries: DataFrame, songs: DataFrame, *, bpm: str, tempo: str, tolerance: float) -> DataFrame:
    """Songs within an inclusive tolerance of each query's bpm.

    A range join as an equality join: songs fall into buckets one tolerance wide and each query looks
    into its own bucket and the two beside it.
    """
    b = F.floor(F.col(bpm) / tolerance)
    q = queries.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    s = songs.withColumn("_b", F.floor(F.col(tempo) / tolerance))
    return q.join(s, "_b").where(F.abs(F.col(tempo) - F.col(bpm)) <= tolerance).drop("_b")
