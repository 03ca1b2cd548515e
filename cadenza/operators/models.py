"""Classifier training with Spark ML, from split to predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.functions.text import tokens
from cadenza.operators.knn import knn
from cadenza.operators.metrics import hard_vote
from cadenza.session import small_table


def as_features(df: DataFrame, x: str = "x") -> DataFrame:
    """MLlib's ``(features, label)`` spelling; vectors exist only at this boundary."""
    return df.withColumn("features", array_to_vector(F.col(x).cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def classifier(name: str, n: int | None = None, **params):
    """An estimator by short name. ``C`` of a library SVM or regression becomes ``regParam = 1 / (C n)``."""
    c = params.pop("C", 1.0)
    reg = 1.0 / (c * n) if n else 1.0 / c
    if name in ("svm_linear", "svm_rbf", "svm_poly"):
        return OneVsRest(classifier=LinearSVC(regParam=reg, standardization=False, maxIter=params.pop("maxIter", 50), **params), parallelism=4)
    if name == "logreg":
        return LogisticRegression(family="multinomial", regParam=reg, standardization=False, maxIter=params.pop("maxIter", 100), **params)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=params.pop("numTrees", 500), maxDepth=params.pop("maxDepth", 20), seed=42, **params)
    if name == "gradient_boost":
        gbt = GBTClassifier(maxIter=params.pop("maxIter", 200), maxDepth=params.pop("maxDepth", 5), stepSize=0.1, seed=42, **params)
        return OneVsRest(classifier=gbt, parallelism=4)
    if name == "naive_bayes":
        return NaiveBayes(**params)
    raise ValueError(f"unknown classifier {name}")


def random_fourier(train: DataFrame, df: DataFrame, x: str = "x", size: int = 256, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """Random Fourier features of the RBF kernel (Rahimi & Recht, NIPS 2007); gamma defaults to 1 / (d var)."""
    d = train.select(F.size(x)).first()[0]
    if gamma is None:
        v = train.select(F.explode(x).alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (d * v)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2 * gamma), (d, size))
    b = rng.uniform(0, 2 * np.pi, size)
    return _map_vectors(df, x, lambda m: np.sqrt(2.0 / size) * np.cos(m @ w + b))


def random_monomials(df: DataFrame, x: str = "x", degree: int = 3, size: int = 512, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """Random degree-p monomials whose inner product estimates ``(gamma x.y)^p`` (Kar & Karnick, AISTATS 2012)."""
    d = df.select(F.size(x)).first()[0]
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (degree, d, size))

    def lift(m: np.ndarray) -> np.ndarray:
        out = np.full((len(m), size), gamma ** (degree / 2) / np.sqrt(size))
        for s in signs:
            out *= m @ s
        return out

    return _map_vectors(df, x, lift)


def vector_statistics(x: str) -> Column:
    """Mean, deviation, least, greatest and quartiles over all positions of a vector."""
    n, ordered = F.size(x), F.array_sort(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    deviation = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    quartiles = [F.element_at(ordered, F.ceil(n * q).cast("int")) for q in (0.25, 0.5, 0.75)]
    return F.array(mean, deviation, F.array_min(x), F.array_max(x), *quartiles)


LIFTED = 512  # vectors that are widened at once: a batch holds thousands


def _map_vectors(df: DataFrame, x: str, fn) -> DataFrame:
    @F.pandas_udf("array<double>")
    def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for at in range(0, len(s), LIFTED):
                yield pd.Series(list(fn(np.vstack(s.iloc[at : at + LIFTED]))))

    return df.withColumn(x, lift(F.col(x).cast("array<double>")))


def fit_predict(estimator, train: DataFrame, test: DataFrame, id_col: str = "vec_id", x: str = "x", tasks: int | None = None):
    """``(model, predictions)`` with integer truth and prediction.

    ``tasks``: training rows are dealt by id into so many partitions. A table of few bytes is read by one task, and every
    level of every tree is then grown in it.
    """
    if tasks:
        train = train.repartition(tasks, id_col).sortWithinPartitions(id_col)
    fit = as_features(train, x).select("features", "label").cache()
    model = estimator.fit(fit)
    fit.unpersist()
    out = model.transform(as_features(test, x))
    return model, out.select(id_col, F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))


def importances(model, spark) -> DataFrame:
    """``(idx, importance)`` of a tree ensemble."""
    v = model.featureImportances.toArray()
    return small_table(spark, [(i, float(s)) for i, s in enumerate(v)], "idx int, importance double")


def cluster(df: DataFrame, id_col: str, x: str = "x", k: int = 4, seed: int = 42) -> tuple[DataFrame, float]:
    """k-means groups and their silhouette."""
    data = df.withColumn("features", array_to_vector(F.col(x).cast("array<double>")))
    out = KMeans(k=k, seed=seed).fit(data).transform(data)
    return out.select(id_col, F.col("prediction").alias("cluster"), "features"), ClusteringEvaluator().evaluate(out)


def tune(train: DataFrame, grid: Sequence[float], folds: int = 3, x: str = "x") -> DataFrame:
    """Mean cross-validated accuracy of logistic regression per regularisation strength."""
    est = LogisticRegression(family="multinomial", standardization=False, maxIter=50)
    maps = ParamGridBuilder().addGrid(est.regParam, list(grid)).build()
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, parallelism=4, seed=42
    )
    fit = as_features(train, x).select("features", "label").cache()
    model = cv.fit(fit)
    fit.unpersist()
    return small_table(train.sparkSession, [(float(g), float(a)) for g, a in zip(grid, model.avgMetrics)], "reg_param double, accuracy double")


def lyrics_stages(label: str, buckets: int = 1 << 14) -> list:
    """Words -> hashed TF-IDF, and the string label as a number."""
    return [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets),
        IDF(inputCol="tf", outputCol="features"),
    ]


def lyrics_pipeline(estimator, label: str, buckets: int = 1 << 14) -> Pipeline:
    """Words -> hashed TF-IDF -> classifier; the label column is a string."""
    return Pipeline(stages=[*lyrics_stages(label, buckets), estimator])


def lyrics_knn(train: DataFrame, test: DataFrame, label: str, id_col: str, k: int = 5, buckets: int = 512) -> DataFrame:
    """``(id, truth, pred)`` by vote of the k nearest training texts, on TF-IDF of unit length (order by cosine)."""
    fit = Pipeline(stages=[*lyrics_stages(label, buckets), Normalizer(inputCol="features", outputCol="unit")]).fit(train)
    lifted = lambda df: fit.transform(df).select(F.col(id_col), F.col("label").cast("int").alias("label"), vector_to_array("unit").alias("v"))
    known, asked = lifted(train), lifted(test)
    near = knn(asked.withColumnRenamed(id_col, "q"), known.withColumnRenamed(id_col, "c"), k)
    votes = near.join(known.select(F.col(id_col).alias("c"), F.col("label").alias("pred")), "c").select(F.col("q").alias(id_col), "pred")
    return asked.select(id_col, F.col("label").alias("truth")).join(hard_vote(votes, id_col), id_col)


def with_words(lyrics: DataFrame, text: str = "text") -> DataFrame:
    return lyrics.withColumn("words", tokens(text))


def multilabel(train: DataFrame, test: DataFrame, labels: Sequence[str], id_col: str, x: str = "x") -> DataFrame:
    """One binary classifier per label: ``(id, label, truth, pred)``."""
    out = None
    for name in labels:
        _, p = fit_predict(
            LogisticRegression(maxIter=50, regParam=0.01), train.withColumn("label", F.col(name)), test.withColumn("label", F.col(name)), id_col, x
        )
        part = p.select(id_col, F.lit(name).alias("label"), "truth", "pred")
        out = part if out is None else out.unionByName(part)
    return out


def hamming_loss(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label").agg(F.avg((F.col("truth") != F.col("pred")).cast("double")).alias("hamming_loss"))
