"""Naive Bayes as aggregations: the model is one row per class and scoring never shuffles the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.retrieval import dimension_stats


def _class_moments(train: DataFrame, label: str, x: str) -> DataFrame:
    """``(label, n, mean[], var[], total[])`` per class, summed map-side per dimension."""
    long = train.select(label, F.posexplode(x).alias("i", "x"))
    per = long.groupBy(label, "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.sum("x").alias("total"))
    rows = per.groupBy(label).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean", "var", "total"))).alias("s"))
    return rows.select(F.col(label).alias("label"), "n", F.col("s.mean").alias("mean"), F.col("s.var").alias("var"), F.col("s.total").alias("total"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _as_value(model: DataFrame) -> Column:
    """The whole model (classes x dimensions numbers) as one array value."""
    return model.agg(F.array_sort(F.collect_list(F.struct("label", "base", "a", "b")))).scalar()


def _argmax(df: DataFrame, scores: Column) -> DataFrame:
    """Class with the best score, the smaller label on ties."""
    best = F.array_max(F.transform(scores, lambda s: F.struct(F.round(s["score"], 9).alias("score"), (-s["label"]).alias("l"))))
    return df.withColumn("_best", best).withColumn("pred", (-F.col("_best.l")).cast("int")).drop("_best", "_model")


def gaussian_nb(train: DataFrame, test: DataFrame, label: str = "label", x: str = "x", smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes; variances are widened by a billionth of the largest feature variance."""
    eps = dimension_stats(train, x).select(F.array_max("std").alias("s")).select(F.col("s") * F.col("s") * smoothing).scalar()
    n = train.agg(F.count("*")).scalar()
    m = _class_moments(train, label, x).withColumn("_eps", eps)
    m = m.withColumn("b", F.transform("var", lambda v: v + F.col("_eps")))
    base = F.log(F.col("n") / n) - _sum(F.transform("b", lambda v: F.log(v * 6.283185307179586))) / 2
    model = m.select("label", base.alias("base"), F.col("mean").alias("a"), "b")
    scored = test.withColumn("_model", _as_value(model))

    def score(c: Column) -> Column:
        d = F.zip_with(F.col(x), c["a"], lambda v, mu: (v - mu) * (v - mu))
        return F.struct(c["label"].alias("label"), (c["base"] - _sum(F.zip_with(d, c["b"], lambda q, v: q / v)) / 2).alias("score"))

    return _argmax(scored, F.transform("_model", score))


def minmax_arrays(train: DataFrame, df: DataFrame, x: str = "x") -> DataFrame:
    """Scale each dimension by the training range, unclipped; a constant dimension becomes 0."""
    r = dimension_stats(train, x).select(F.struct("min", "max")).scalar()
    d = df.withColumns({"_lo": r["min"], "_hi": r["max"]})
    span = F.zip_with("_lo", "_hi", lambda a, b: F.when(b == a, 1.0).otherwise(b - a))
    off = F.zip_with(F.col(x), F.col("_lo"), lambda v, a: v - a)
    return d.withColumn("_s", span).withColumn(x, F.zip_with(off, F.col("_s"), lambda v, s: v / s)).drop("_lo", "_hi", "_s")


def standard_arrays(train: DataFrame, df: DataFrame, x: str = "x") -> DataFrame:
    """Z-scores per dimension from the training rows' population deviation."""
    r = dimension_stats(train, x).select(F.struct("mean", "std")).scalar()
    d = df.withColumns({"_m": r["mean"], "_d": r["std"]})
    off = F.zip_with(F.col(x), F.col("_m"), lambda v, a: v - a)
    return d.withColumn(x, F.zip_with(off, F.col("_d"), lambda v, s: v / F.when(s == 0, 1.0).otherwise(s))).drop("_m", "_d")


def multinomial_nb(train: DataFrame, test: DataFrame, label: str = "label", x: str = "x", alpha: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes with Laplace smoothing over features scaled to the training range."""
    fit, use = minmax_arrays(train, train, x), minmax_arrays(train, test, x)
    n = train.agg(F.count("*")).scalar()
    m = _class_moments(fit, label, x)
    total = F.aggregate("total", F.lit(0.0), lambda s, v: s + v + alpha)
    m = m.withColumn("_t", total).withColumn("a", F.transform("total", lambda v: F.log((v + alpha) / F.col("_t"))))
    model = m.select("label", F.log(F.col("n") / n).alias("base"), "a", F.col("a").alias("b"))
    scored = use.withColumn("_model", _as_value(model))

    def score(c: Column) -> Column:
        return F.struct(c["label"].alias("label"), (c["base"] + _sum(F.zip_with(F.col(x), c["a"], lambda v, w: v * w))).alias("score"))

    return _argmax(scored, F.transform("_model", score))
