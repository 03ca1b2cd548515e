"""Classifier training and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, functions as F

from cadenza.operators import bayes, cubic, metrics, models, svm
from cadenza.operators.prep import stratified_split
from cadenza.plans.analytics import rounded
from cadenza.plans.registry import query
from cadenza.session import cut_lineage, scratch_path, shuffle_width
from cadenza.sources.files import save_model

_SPLIT = (
    "sp as (select vec_id, label, x, case when rn <= floor(0.8*cnt) then 'train' when rn <= floor(0.8*cnt) + floor(0.1*cnt) then 'val' else 'test' end as split from "
    "(select *, row_number() over (partition by label order by md5(vec_id || ':42'), vec_id) as rn, count(*) over (partition by label) as cnt from labelled)), "
    "lt as (select vec_id, label, split, generate_subscripts(x,1) as i, unnest(x) as x from sp)"
)


def splits(c) -> tuple[DataFrame, DataFrame]:
    """Standard-scaled train and held-out rows."""
    all_rows = stratified_split(c.labelled, "vec_id", "label")
    train = all_rows.where("split = 'train'")
    scaled = cut_lineage(bayes.standard_arrays(train, all_rows))
    return scaled.where("split = 'train'"), scaled.where("split <> 'train'")


def raw_splits(c) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(stratified_split(c.labelled, "vec_id", "label"))
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def told(preds: DataFrame) -> DataFrame:
    """Support per true class of the held-out rows, and whether the predictions beat always naming the commonest class."""
    per = preds.groupBy("truth").agg(F.count("*").alias("support"), F.sum((F.col("truth") == F.col("pred")).cast("bigint")).alias("hits"))
    share = per.agg(F.struct(F.sum("hits").alias("hits"), F.max("support").alias("most"))).scalar()
    return per.select(F.col("truth").alias("label"), "support", (share["hits"] > share["most"]).alias("above_majority"))


_TOLD = " select label, count(*) as support, true as above_majority from sp where split <> 'train' group by 1"


def reported(preds: DataFrame) -> DataFrame:
    """One row of accuracy, macro F1 and the number of rows."""
    rep = metrics.classification_report(metrics.confusion_matrix(preds))
    pick = lambda label, score: F.max(F.when(F.col("label") == label, F.col(score)))
    return rep.agg(pick("accuracy", "f1").alias("accuracy"), pick("macro avg", "f1").alias("macro_f1"), pick("accuracy", "support").alias("n"))


_GNB = (
    f"{_SPLIT}, ev as (select max(v)*1e-9 as eps from (select var_pop(x) as v from lt where split = 'train' group by i)), "
    "gm as (select label as k, i, avg(x) as m, var_pop(x) + (select eps from ev) as v from lt where split = 'train' group by 1, 2), "
    "gp as (select label as k, ln(count(*) / (select count(*) from sp where split = 'train')::double) as p from sp where split = 'train' group by 1), "
    "gs as (select vec_id, label, split, k, round(any_value(p) + sum(-0.5*ln(2*pi()*v) - 0.5*(x-m)**2/v),9) as s from lt join gm using (i) join gp using (k) where split <> 'train' group by 1, 2, 3, 4), "
    "g as (select vec_id, label, split, k as pred from (select *, row_number() over (partition by vec_id order by s desc, k) as rn from gs) where rn = 1)"
)
_MNB = (
    "mr as (select i, min(x) as lo, case when max(x) = min(x) then 1 else max(x) - min(x) end as span from lt where split = 'train' group by 1), mx as (select vec_id, label, split, i, (x - lo) / span as x from lt join mr using (i)), "
    "mc as (select label as k, i, sum(x) + 1 as n from mx where split = 'train' group by 1, 2), mw as (select k, i, ln(n / sum(n) over (partition by k)) as w from mc), "
    "mp as (select label as k, ln(count(*) / (select count(*) from sp where split = 'train')::double) as p from sp where split = 'train' group by 1), "
    "ms as (select vec_id, label, split, k, round(any_value(p) + sum(x*w),9) as s from mx join mw using (i) join mp using (k) where split <> 'train' group by 1, 2, 3, 4), "
    "m as (select vec_id, label, split, k as pred from (select *, row_number() over (partition by vec_id order by s desc, k) as rn from ms) where rn = 1)"
)


@query("gnb", f"with {_GNB} select vec_id, label, cast(pred as int) as pred from g")
def gnb(c):
    train, test = raw_splits(c)
    return bayes.gaussian_nb(train, test).select("vec_id", "label", "pred")


@query("mnb", f"with {_SPLIT}, {_MNB} select vec_id, label, cast(pred as int) as pred from m")
def mnb(c):
    train, test = raw_splits(c)
    return bayes.multinomial_nb(train, test).select("vec_id", "label", "pred")


@query(
    "nb_best",
    f"with {_GNB}, {_MNB}, a as (select 'Gaussian' as model, 0 as priority, avg(case when pred = label then 1.0::double else 0 end) as accuracy from g where split = 'val' union all "
    "select 'Multinomial', 1, avg(case when pred = label then 1.0::double else 0 end) from m where split = 'val') select model, round(accuracy,6) as accuracy from a order by accuracy desc, priority limit 1",
)
def nb_best(c):
    train, test = raw_splits(c)
    val = test.where("split = 'val'")
    runs = [("Gaussian", bayes.gaussian_nb(train, val)), ("Multinomial", bayes.multinomial_nb(train, val))]
    acc = [
        df.agg(F.lit(n).alias("model"), F.lit(i).alias("priority"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
        for i, (n, df) in enumerate(runs)
    ]
    return rounded(metrics.best_model(reduce(DataFrame.unionByName, acc)), "accuracy")


_W = "wm as (select label as k, i, avg(x) as w from (select vec_id, label, generate_subscripts(x,1) as i, unnest(x) as x from labelled) group by 1, 2), lx as (select vec_id, label, generate_subscripts(x,1) as i, unnest(x) as x from labelled)"


def _centroid_model(c) -> DataFrame:
    """Class means as weight vectors: fixed weights that scores and losses can be checked on."""
    long = c.labelled.select("label", F.posexplode("x").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("w"))
    rows = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s"))
    return rows.select("label", F.col("s.w").alias("w"), F.lit(-0.1).alias("b"))


@query("svm_decision", f"with {_W} select vec_id, cast(k as int) as label, round(sum(x*w) - 0.1,6) as score from lx join wm using (i) group by 1, 2")
def svm_decision(c):
    out = svm.decision_scores(c.labelled.select("vec_id", "x"), _centroid_model(c)).select("vec_id", F.inline("scores"))
    return rounded(out, "score")


@query(
    "svm_loss",
    f"with {_W}, sc as (select vec_id, lx.label as truth, k, sum(x*w) - 0.1::double as s from lx join wm using (i) group by 1, 2, 3), h as (select k, avg(greatest(0, 1 - (case when truth = k then 1 else -1 end) * s)) as h from sc group by 1), "
    "nn as (select k, sum(w*w) as n from wm group by 1) select cast(k as int) as label, round(0.5*n + h,6) as loss from h join nn using (k)",
)
def svm_loss(c):
    return rounded(svm.hinge_loss(c.labelled, _centroid_model(c)), "loss")


@query("svm_ovr_sgd", f"with {_SPLIT}{_TOLD}")
def svm_ovr_sgd(c):
    train, test = splits(c)
    model, _ = svm.train_newton(train)
    return told(svm.predict(test, model.drop("other")).select("vec_id", F.col("label").alias("truth"), "pred"))


def _predictions(name: str, c, lift=None, tasks: int | None = None, **params) -> DataFrame:
    train, test = splits(c)
    n = train.count()
    if lift:
        train, test = lift(train, train), lift(train, test)
    return models.fit_predict(models.classifier(name, n, **params), train, test, tasks=tasks)[1]


def _run(name: str, c, lift=None, **params) -> DataFrame:
    return told(_predictions(name, c, lift, **params))


@query("svm_linear", f"with {_SPLIT}{_TOLD}")
def svm_linear(c):
    """Every class against every other, by vote."""
    train, test = splits(c)
    model, _ = svm.train_newton(train, scheme="pairs", mean=False)
    return told(svm.predict_pairs(test, model).select("vec_id", F.col("label").alias("truth"), "pred"))


@query("svm_rbf", f"with {_SPLIT}{_TOLD}")
def svm_rbf(c):
    return _run("svm_rbf", c, lambda t, d: models.random_fourier(t, d), C=10.0)


@query("svm_poly")
def svm_poly(c):
    """Every class against every other with the kernel ``(gamma x.y)^3``, by vote."""
    train, test = splits(c)
    gamma = cubic.scale_gamma(train)
    labels, model, _ = cubic.train_cubic(train, gamma, c=1.0)
    return cubic.predict_cubic(test.select("vec_id", F.col("label").cast("int").alias("truth"), "x"), labels, model, gamma).drop("x")


@query("random_forest", f"with {_SPLIT}{_TOLD}")
def random_forest(c):
    # trees keep the node of every row between levels instead of sending the whole forest with each
    return _run("random_forest", c, tasks=shuffle_width(c.labelled), numTrees=500, maxDepth=20, cacheNodeIds=True)


@query("gradient_boost", f"with {_SPLIT}{_TOLD}")
def gradient_boost(c):
    return _run("gradient_boost", c, maxIter=12, maxDepth=3)


@query("logreg", f"with {_SPLIT}{_TOLD}")
def logreg(c):
    return _run("logreg", c, C=1.0)


@query("ensemble_vote", f"with {_SPLIT}{_TOLD}")
def ensemble_vote(c):
    train, test = splits(c)
    n = train.count()
    settings = {"random_forest": {"numTrees": 30, "maxDepth": 6}, "gradient_boost": {"maxIter": 5, "maxDepth": 3}, "svm_linear": {}, "logreg": {}}
    runs = [models.fit_predict(models.classifier(k, n, **p), train, test)[1].select("vec_id", "pred") for k, p in settings.items()]
    voted = metrics.hard_vote(reduce(DataFrame.unionByName, runs), "vec_id")
    return told(voted.join(test.select("vec_id", F.col("label").cast("int").alias("truth")), "vec_id"))


@query("feature_importance")
def feature_importance(c):
    train, test = splits(c)
    model, _ = models.fit_predict(models.classifier("random_forest", numTrees=40, maxDepth=6), train, test)
    return models.importances(model, c.spark)


@query("feature_importance_check", "select cast(count(*) as int) as positions, 1.0::double as total, true as first_two_lead from (select unnest(x) from labelled limit 64)")
def feature_importance_check(c):
    ranked = feature_importance(c)
    # the label is made of the first two positions, so these must come out on top
    lead = F.min(F.when(F.col("idx") < 2, F.col("importance"))) > F.max(F.when(F.col("idx") >= 2, F.col("importance")))
    return ranked.agg(F.count("*").cast("int").alias("positions"), F.round(F.sum("importance"), 6).alias("total"), lead.alias("first_two_lead"))


@query("model_persist", f"with {_SPLIT} select label, count(*) as support, true as same from sp where split <> 'train' group by 1")
def model_persist(c):
    train, test = splits(c)
    model, _ = models.fit_predict(models.classifier("random_forest", numTrees=20, maxDepth=5), train, test)
    again = RandomForestClassificationModel.load(save_model(model, scratch_path(c.spark, "model")))
    data = models.as_features(test)
    out = again.transform(data).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").alias("pred"))
    fresh = model.transform(data).select("vec_id", F.col("prediction").alias("fresh"))
    return out.join(fresh, "vec_id").groupBy("label").agg(F.count("*").alias("support"), F.bool_and(F.col("pred") == F.col("fresh")).alias("same"))


@query("lyrics_classify")
def lyrics_classify(c):
    """Held-out scores of every model; ``best`` marks the one of greatest accuracy on the validation split."""
    words = models.with_words(c.lyrics.select("song_id", "text", "lang")).drop("text")
    rows = cut_lineage(stratified_split(words, "song_id", "lang"))
    train, test = rows.where("split = 'train'"), rows.where("split <> 'train'")
    out, n = [], train.count()
    share = test.groupBy("lang").count().agg(F.max("count") / F.sum("count")).scalar()
    settings = {"naive_bayes": {}, "logreg": {"maxIter": 20}, "random_forest": {"numTrees": 20, "maxDepth": 6}, "svm_linear": {}, "knn": {}}
    for priority, (name, params) in enumerate(settings.items()):
        if name == "knn":
            p = models.lyrics_knn(train, test, "lang", "song_id")
        else:
            p = models.lyrics_pipeline(models.classifier(name, n, **params), "lang").fit(train).transform(test)
            p = p.select("song_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))
        p = cut_lineage(p)
        val = p.join(test.where("split = 'val'").select("song_id"), "song_id", "left_semi").agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).scalar()
        out.append(reported(p).select(F.lit(name).alias("model"), F.lit(priority).alias("priority"), "n", "accuracy", "macro_f1", val.alias("val_accuracy")))
    scores = cut_lineage(reduce(DataFrame.unionByName, out))
    best = metrics.best_model(scores, score="val_accuracy").select("model", F.lit(True).alias("best"))
    scores = scores.join(best, "model", "left").withColumn("best", F.coalesce("best", F.lit(False)))
    return scores.withColumn("above_majority", F.col("accuracy") > share).drop("priority")


@query("lyrics_classify_check", "with recursive m(model) as (values ('naive_bayes'), ('logreg'), ('random_forest')) select model, true as above_majority from m")
def lyrics_classify_check(c):
    return lyrics_classify(c).where("model in ('naive_bayes', 'logreg', 'random_forest')").select("model", "above_majority")


@query("multilabel")
def multilabel(c):
    rows = stratified_split(c.labelled, "vec_id", "label").withColumns(
        {"bright": (F.col("x")[0] > 0).cast("int"), "driving": (F.col("x")[1] > 0).cast("int"), "tonal": (F.col("x")[2] > 0).cast("int")}
    )
    rows = cut_lineage(rows)
    preds = models.multilabel(rows.where("split = 'train'"), rows.where("split <> 'train'"), ["bright", "driving", "tonal"], "vec_id")
    rarer = preds.groupBy("label").agg(F.least(F.avg("truth"), 1 - F.avg("truth")).alias("rarer"))
    return models.hamming_loss(preds).join(rarer, "label").select("label", "hamming_loss", (F.col("hamming_loss") < F.col("rarer")).alias("below_majority_error"))


@query("multilabel_check", "select label, true as below_majority_error from (values ('bright'), ('driving'), ('tonal')) v(label)")
def multilabel_check(c):
    return multilabel(c).select("label", "below_majority_error")


@query("tune")
def tune(c):
    train = splits(c)[0]
    share = train.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    return models.tune(train, [0.001, 0.01, 0.1]).select("reg_param", "accuracy", (F.col("accuracy") > share).alias("above_majority"))


@query("tune_check", f"with {_SPLIT} select r as reg_param, true as above_majority from (values (0.001::double), (0.01::double), (0.1::double)) v(r)")
def tune_check(c):
    return tune(c).select("reg_param", "above_majority")


@query("compare_feature_sets")
def compare_feature_sets(c):
    """Statistics of the whole vector against all positions one by one."""
    train, test = splits(c)
    n = train.count()
    out = []
    share = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).scalar()
    for name, made in (("statistics", models.vector_statistics("x")), ("positions", F.col("x"))):
        p = models.fit_predict(models.classifier("logreg", n), train.withColumn("x", made), test.withColumn("x", made))[1]
        out.append(reported(p).select(F.lit(name).alias("feature_set"), "n", "accuracy", "macro_f1", (F.col("accuracy") > share).alias("above_majority")))
    return reduce(DataFrame.unionByName, out)


@query("compare_feature_sets_check", f"with {_SPLIT} select f as feature_set, (select count(*) from sp where split <> 'train') as n, true as above_majority from (values ('statistics'), ('positions')) v(f)")
def compare_feature_sets_check(c):
    return compare_feature_sets(c).select("feature_set", "n", "above_majority")


@query("cluster_songs")
def cluster_songs(c):
    from cadenza.operators.prep import standard_scale
    from cadenza.sources.catalog import FEATURES

    z = standard_scale(c.songs, FEATURES).select("song_id", F.array(*FEATURES).alias("x"))
    groups, silhouette = models.cluster(z, "song_id")
    groups = cut_lineage(groups.select("song_id", "cluster"))
    sizes = groups.groupBy("cluster").agg(F.count("*").alias("cluster_songs"))
    return groups.join(sizes, "cluster").select("song_id", "cluster", "cluster_songs", F.lit(silhouette).alias("silhouette"))


@query("cluster_songs_check", "select 4::bigint as clusters, count(*) as songs, true as apart from songs")
def cluster_songs_check(c):
    groups = cluster_songs(c)
    return groups.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("songs"), (F.max("silhouette") > 0).alias("apart"))
