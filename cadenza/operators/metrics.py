"""Evaluation reports and catalogue statistics as aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.operators.ordered import exact_quantiles


def accuracy(preds: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    return preds.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_matrix(preds: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Zero-filled ``(truth, pred, n)`` over every label seen on either side.

    The grid is labels x labels: the label list is one aggregate value exploded per label.
    """
    counts = preds.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    seen = counts.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()
    every = seen.agg(F.array_sort(F.collect_list("label"))).scalar()
    grid = seen.select(F.col("label").alias("truth"), every.alias("_all")).select("truth", F.explode("_all").alias("pred"))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_shares(matrix: DataFrame) -> DataFrame:
    """Each row of a confusion matrix as shares of its sum; an empty row is NULL."""
    rows = matrix.groupBy("truth").agg(F.sum("n").alias("_t"))
    return matrix.join(rows, "truth").select("truth", "pred", F.try_divide("n", "_t").alias("share"))


def per_class_accuracy(matrix: DataFrame) -> DataFrame:
    """Correct, total and accuracy per class, and an ``OVERALL`` row."""
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    out = matrix.rollup("truth").agg(hit.alias("correct"), F.sum("n").alias("total"))
    return out.select(
        F.coalesce(F.col("truth").cast("string"), F.lit("OVERALL")).alias("label"), "correct", "total", F.try_divide("correct", "total").alias("accuracy")
    )


def most_confused_pairs(matrix: DataFrame, n: int = 10) -> DataFrame:
    """The largest off-diagonal cells; ties run backwards through the labels, empty cells drop out last."""
    top = matrix.where(F.col("truth") != F.col("pred")).orderBy(F.desc("n"), F.desc("truth"), F.desc("pred")).limit(n)
    return top.where(F.col("n") > 0)


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy, macro and weighted averages."""
    cells = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("c")
    ).select("c.*")
    per = cells.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero = F.lit(0.0)
    per = per.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    scores = ["precision", "recall", "f1"]
    classes = per.select(F.col("label").cast("string").alias("label"), *scores, "support")
    hit = F.sum("tp") / F.sum("support")
    acc = per.agg(F.lit("accuracy").alias("label"), *[hit.alias(s) for s in scores], F.sum("support").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("label"), *[F.try_divide(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores], F.sum("support").alias("support")
    )
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def top_k_accuracy(ranked: DataFrame, query: str, truth: Column, candidate: Column, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of queries whose truth is among their k best candidates."""
    best = ranked.groupBy(query).agg(F.min(F.when(truth == candidate, F.col("rank"))).alias("hit"))
    flat = best.agg(*[F.avg(F.coalesce((F.col("hit") <= k).cast("double"), F.lit(0.0))).alias(str(k)) for k in ks])
    return flat.unpivot([], [str(k) for k in ks], "k", "accuracy").withColumn("k", F.col("k").cast("int"))


def precision_recall_at_k(ranked: DataFrame, query: str, relevant: Column, totals: DataFrame, k: int) -> DataFrame:
    """Per query: relevant results among the first k over k, and over all relevant items."""
    hits = ranked.where(F.col("rank") <= k).groupBy(query).agg(F.sum(relevant.cast("int")).alias("hits"))
    return hits.join(totals, query).select(
        query, (F.col("hits") / F.lit(float(k))).alias("precision"), F.try_divide(F.col("hits").cast("double"), F.col("relevant")).alias("recall")
    )


def known_pair_rank(pairs: DataFrame, ranked: DataFrame, query: str, item: str) -> DataFrame:
    """Rank at which the known partner of each pair appears in the query's result list."""
    return pairs.join(ranked, [query, item], "left").groupBy(query, item).agg(F.min("rank").alias("rank"))


def best_model(scores: DataFrame, by: Sequence[str] = (), score: str = "accuracy") -> DataFrame:
    """Highest score; among equals the first in priority order."""
    return scores.groupBy(*by).agg(F.max_by(F.struct("model", score), F.struct(F.col(score), -F.col("priority"))).alias("_b")).select(*by, "_b.*")


def hard_vote(ballots: DataFrame, id_col: str, pred: str = "pred") -> DataFrame:
    """Majority class per item; ties go to the smallest class."""
    per = ballots.groupBy(id_col, pred).agg(F.count("*").alias("n"))
    return per.groupBy(id_col).agg(F.min_by(pred, F.struct(-F.col("n"), F.col(pred))).alias(pred))


def importance_by_category(importances: DataFrame, categories: Mapping[str, Sequence[int]]) -> DataFrame:
    """Summed importance per feature category and its percentage of all, largest first; positions in no category are ``Other``."""
    pairs = [x for name, idx in categories.items() for i in idx for x in (F.lit(i), F.lit(name))]
    named = importances.withColumn("category", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("idx")), F.lit("Other")))
    per = named.groupBy("category").agg(F.sum("importance").alias("importance"))
    total = named.agg(F.sum("importance").alias("t")).scalar()
    return per.withColumn("percentage", F.col("importance") / total * 100).orderBy(F.desc("importance"), "category")


def tempo_genre_correlation(songs: DataFrame, genres: str = "genres", tempo: str = "tempo") -> DataFrame:
    """Point-biserial correlation of tempo with membership of each genre.

    Follows from three sums per genre and three overall, so songs never meet genres they lack.
    """
    t = F.col(tempo)
    known = songs.where(t.isNotNull())
    o = known.agg(F.struct(F.count("*").alias("n"), F.avg(t).alias("m"), F.stddev_pop(t).alias("s"))).scalar()
    per = known.select(F.explode(F.array_distinct(genres)).alias("genre"), t.alias("t")).groupBy("genre").agg(F.count("*").alias("n"), F.avg("t").alias("mean_tempo"))
    p = F.col("n") / o["n"]
    corr = F.try_divide((F.col("mean_tempo") - o["m"]) * F.sqrt(F.try_divide(p, 1 - p)), o["s"])
    return per.select("genre", "n", "mean_tempo", corr.alias("correlation"))


def feature_f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature: variance between classes over variance inside them."""
    long = df.unpivot([label], list(features), "feature", "x")
    per = long.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    allx = per.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum(F.col("n") * F.col("v")).alias("ssw")
    )
    ssb = per.join(allx.select("feature", "g"), "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"))
    return allx.join(ssb, "feature").select(
        "feature", F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("f_score")
    )


def octave_class(estimate: Column, truth: Column, tolerance: float = 0.04) -> Column:
    """Which multiple of the true tempo an estimate hits."""
    r = estimate / truth
    out = None
    # The tempo-octave classes and their ratios.
    for name, ratio in [("exact", 1.0), ("half", 0.5), ("double", 2.0), ("third", 1.0 / 3.0), ("triple", 3.0)]:
        test = F.abs(r / F.lit(ratio) - 1) <= tolerance
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def tempo_accuracy(estimates: DataFrame, by: str, estimate: str, truth: str) -> DataFrame:
    """``acc1``: within 4 % of the truth; ``acc2``: also of its simple multiples."""
    c = octave_class(F.col(estimate), F.col(truth))
    return estimates.groupBy(by).agg(F.avg((c == "exact").cast("double")).alias("acc1"), F.avg((c != "other").cast("double")).alias("acc2"))


def service_metrics(log: DataFrame) -> DataFrame:
    """Volume, error rate and exact latency percentiles per endpoint."""
    base = log.groupBy("endpoint").agg(
        F.count("*").alias("n"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg("latency_ms").alias("mean_latency"),
    )
    q = exact_quantiles(log, ["endpoint"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(q, "endpoint", "left")


def throughput(log: DataFrame) -> DataFrame:
    """Requests and mean latency per hour, counted from the start of 2024."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hour = F.timestamp_diff("HOUR", start, F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")).alias("hour_no")
    return log.groupBy(hour).agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency"))


def model_comparison(preds: DataFrame) -> DataFrame:
    """Models by accuracy, best first, per split."""
    acc = accuracy(preds, ["split", "model"])
    return acc.withColumn("place", F.rank().over(W.partitionBy("split").orderBy(F.desc(F.round("accuracy", 9)), "model")))
