"""Structured requests: JSON documents and constraint lists as rows of parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.knn import knn
from cadenza.session import cut_lineage, small_table

REQUEST_SCHEMA = (
    "type string, artist string, seed bigint, query string, k int, match array<string>, include array<string>, "
    "exclude struct<genre: array<string>, year_range: array<array<int>>>"
)
# The request types and comparable features a request may name.
REQUEST_TYPES = ["playlist", "similarity", "lyrics_search", "classify"]
REQUEST_FEATURES = ["tempo", "energy", "valence", "danceability", "key", "mode"]


def weight_entries(match: Column) -> Column:
    """``["energy: 0.6"]`` -> ``[{energy, 0.6}]``; a bare feature name weighs 1, an unreadable weight is null."""
    return F.transform(
        F.filter(F.coalesce(match, F.array().cast("array<string>")), lambda m: m.isNotNull()),
        lambda m: F.struct(
            F.lower(F.trim(F.split(m, ":")[0])).alias("key"),
            F.when(~F.contains(m, F.lit(":")), F.lit(1.0)).otherwise(F.trim(F.try_element_at(F.split(m, ":", 2), F.lit(2))).try_cast("double")).alias("value"),
        ),
    )


def weight_map(match: Column) -> Column:
    """The readable weights by feature; of a feature named twice the first weight counts."""
    entries = F.filter(weight_entries(match), lambda e: e["value"].isNotNull())
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def weight_faults(match: Column) -> Column:
    """What is wrong with a list of weights: null entries, features named twice, weights that are no numbers."""
    names = F.transform(weight_entries(match), lambda e: e["key"])
    return F.array_compact(
        F.array(
            F.when(F.exists(match, lambda m: m.isNull()), "empty feature"),
            F.when(F.size(F.array_distinct(names)) < F.size(names), "duplicate feature"),
            F.when(F.exists(weight_entries(match), lambda e: e["value"].isNull()), "bad weight"),
        )
    )


def parse_requests(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Typed parameters per JSON document; a malformed document has ``valid_json`` false."""
    p = F.from_json(doc, REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    return docs.withColumn("_p", p).select(
        *[c for c in docs.columns if c != doc],
        (F.col("_p").isNotNull() & F.col("_p.type").isNotNull()).alias("valid_json"),
        F.col("_p.type").alias("type"),
        F.col("_p.artist").alias("artist"),
        F.col("_p.seed").alias("seed"),
        F.col("_p.query").alias("query"),
        F.col("_p.k").alias("k"),
        weight_map(F.col("_p.match")).alias("weights"),
        weight_faults(F.col("_p.match")).alias("weight_faults"),
        F.col("_p.include").alias("include"),
        F.col("_p.exclude.genre").alias("exclude_genre"),
        F.col("_p.exclude.year_range").alias("exclude_years"),
    )


def validate_requests(parsed: DataFrame, types: Sequence[str] = REQUEST_TYPES, features: Sequence[str] = REQUEST_FEATURES) -> DataFrame:
    """Adds an ``errors`` array; invalid requests are kept for the caller to report."""
    known = F.array(*[F.lit(f) for f in features])
    names, values = F.map_keys("weights"), F.map_values("weights")
    ranges = F.coalesce(F.col("exclude_years"), F.array().cast("array<array<int>>"))
    return parsed.withColumn(
        "errors",
        F.array_compact(
            F.array(
                F.when(~F.col("valid_json"), "malformed"),
                F.when(F.col("valid_json") & ~F.col("type").isin(list(types)), "unknown type"),
                F.when(F.col("valid_json") & (F.coalesce(F.col("k"), F.lit(0)) <= 0), "k must be positive"),
                *[F.when(F.array_contains("weight_faults", e), e) for e in ("empty feature", "duplicate feature", "bad weight")],
                F.when(F.size(F.array_except(names, known)) > 0, "unknown feature"),
                F.when(F.exists(values, lambda v: v < 0), "negative weight"),
                F.when(
                    F.col("valid_json") & (F.size(names) > 0) & (F.aggregate(values, F.lit(0.0), lambda s, v: s + v) == 0),
                    "weights sum to zero",
                ),
                F.when(F.exists(ranges, lambda r: (F.size(r) != 2) | (F.try_element_at(r, F.lit(1)) > F.try_element_at(r, F.lit(2)))), "bad year range"),
            )
        ),
    )


def run_similarity(requests: DataFrame, profiles: DataFrame, features: Sequence[str], request: str, by: str = "artist") -> DataFrame:
    """``(request, neighbour, distance, rank)``: the k most similar artists of every valid request, all requests in one plan.

    ``requests`` come from ``validate_requests``, ``profiles`` hold one scaled row per artist. Each request has its own
    artist, k and weights; features that it does not name weigh nothing, and without any weight all weigh 1.
    """
    weights = F.array(*[F.when(F.size("weights") == 0, 1.0).otherwise(F.coalesce(F.try_element_at("weights", F.lit(f)), F.lit(0.0))) for f in features])
    asked = requests.where(F.size("errors") == 0).select(request, by, "k", weights.alias("qw"))
    packed = profiles.select(by, F.array(*features).alias("v"))
    queries = cut_lineage(asked.join(packed, by))
    most = queries.agg(F.max("k")).first()[0] or 0
    near = knn(queries, packed.withColumnRenamed(by, "neighbour"), most + 1, query_id=request, candidate_id="neighbour", query_weight="qw").drop("rank")
    # requests grow with the log: their rows are sorted beside their lists, never collected and sent to every task
    others = near.join(queries.select(request, by, "k").hint("merge"), request).where(F.col("neighbour") != F.col(by))
    ranked = others.withColumn("rank", F.row_number().over(W.partitionBy(request).orderBy("distance", "neighbour")).cast("bigint"))
    return ranked.where(F.col("rank") <= F.col("k")).select(request, "neighbour", "distance", "rank")


def parse_constraint_list(docs: DataFrame, text: str) -> DataFrame:
    """``key = value`` lines -> typed parameters."""
    parts = F.transform(F.split(F.col(text), "\n"), lambda line: F.split(line, "=", 2))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(p[0])).alias("key"), F.trim(F.try_element_at(p, F.lit(2))).alias("value")))
    names = F.transform(pairs, lambda e: e["key"])
    # of a key written twice the first line counts
    m = F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(names, e["key"]) == i + 1))
    years = F.split(F.try_element_at(F.col("_m"), F.lit("exclude_year")), "-")

    def listed(name: str) -> Column:
        raw = F.coalesce(F.try_element_at(F.col("_m"), F.lit(name)), F.lit(""))
        return F.filter(F.transform(F.split(raw, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")

    return docs.withColumn("_m", m).select(
        *[c for c in docs.columns if c != text],
        F.try_element_at(F.col("_m"), F.lit("type")).alias("type"),
        F.try_element_at(F.col("_m"), F.lit("artist")).alias("artist"),
        F.try_element_at(F.col("_m"), F.lit("k")).try_cast("int").alias("k"),
        listed("match").alias("features"),
        listed("exclude_genre").alias("exclude_genre"),
        F.get(years, 0).try_cast("int").alias("year_from"),
        F.get(years, 1).try_cast("int").alias("year_to"),
    )


def results_to_json(results: DataFrame, request: str, rank: str, item: str) -> DataFrame:
    """One JSON document per request from its ``k`` ranked results (already limited to k rows)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(item).alias("id"))))
    return (
        results.groupBy(request)
        .agg(entries.alias("results"))
        .select(request, F.to_json(F.struct(F.col(request).alias("request"), "results")).alias("doc"))
    )


# Word -> (feature, weight, direction) of everyday wishes.
VIBE_WORDS = [
    ("vibe", "valence", 0.5, 0), ("vibe", "energy", 0.5, 0),
    ("upbeat", "valence", 1.0, 1), ("upbeat", "tempo", 0.5, 1),
    ("faster", "tempo", 1.0, 1), ("slower", "tempo", 1.0, -1),
    ("calmer", "energy", 1.0, -1), ("energetic", "energy", 1.0, 1),
    ("danceable", "danceability", 1.0, 1), ("sadder", "valence", 1.0, -1),
    ("happier", "valence", 1.0, 1), ("groove", "danceability", 0.7, 0),
]
# Word -> retrieval route of a question.
ROUTE_WORDS = [
    ("top", "sql"), ("count", "sql"), ("above", "sql"), ("released", "sql"), ("popular", "sql"),
    ("like", "vector"), ("similar", "vector"), ("sounds", "vector"), ("lyrics", "vector"),
    ("collaborated", "graph"), ("influenced", "graph"), ("related", "graph"), ("album", "graph"),
]


def _lexicon(df: DataFrame, words: list[tuple], schema: str) -> DataFrame:
    return small_table(df.sparkSession, words, schema)


def vibe_weights(prompts: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """Feature weights (summing to 1 per prompt) and wished directions from everyday words."""
    lex = _lexicon(prompts, VIBE_WORDS, "word string, feature string, weight double, direction int")
    hits = prompts.select(id_col, F.explode(tokens).alias("word")).join(lex, "word")
    per = hits.groupBy(id_col, "feature").agg(F.sum("weight").alias("w"), F.signum(F.sum("direction")).cast("int").alias("direction"))
    totals = per.groupBy(id_col).agg(F.sum("w").alias("_t"))
    return per.join(totals, id_col).select(id_col, "feature", (F.col("w") / F.col("_t")).alias("weight"), "direction")


def route_questions(prompts: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """The retrieval route with the most rule words; two routes in a tie make it ``hybrid``."""
    lex = _lexicon(prompts, ROUTE_WORDS, "word string, route string")
    hits = prompts.select(id_col, F.explode(tokens).alias("word")).join(lex, "word")
    per = hits.groupBy(id_col, "route").agg(F.count("*").alias("n"))
    best = per.groupBy(id_col).agg(
        F.sum("n").alias("total"),
        F.max("n").alias("top"),
        F.max_by("route", F.struct("n", "route")).alias("route"),
        F.collect_list("n").alias("ns"),
    )
    tied = F.size(F.filter("ns", lambda n: n == F.col("top"))) > 1
    routed = best.select(
        id_col,
        F.when(tied, "hybrid").otherwise(F.col("route")).alias("route"),
        (F.col("top") / F.col("total")).alias("confidence"),
    )
    return prompts.select(id_col).join(routed, id_col, "left").select(
        id_col, F.coalesce("route", F.lit("hybrid")).alias("route"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )
