"""Learned queries return their whole results, not only flags."""

import inspect
from pathlib import Path

import numpy as np
import pytest
from conftest import rows

from __spark_entry__ import queries
from cadenza.operators import models, svm
from cadenza.sources.catalog import Catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables absent")


def test_statistics_cover_every_position(spark):
    x = np.random.default_rng(1).normal(size=64)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(models.vector_statistics("x").alias("s")).first()["s"]
    s = np.sort(x)
    assert np.allclose(got, [x.mean(), x.std(), s[0], s[-1], s[15], s[31], s[47]])


def test_feature_sets_have_scores(spark):
    got = {r["feature_set"]: r for r in queries()["compare_feature_sets"](spark, DATA).collect()}
    assert set(got) == {"statistics", "positions"}
    assert all(0 < r["macro_f1"] < 1 and 0 < r["accuracy"] < 1 and r["n"] > 0 for r in got.values())
    assert got["positions"]["accuracy"] > got["statistics"]["accuracy"]  # the label is made of two positions


def test_the_own_svm_takes_the_published_number_of_steps():
    assert inspect.signature(svm.train_ovr).parameters["steps"].default == 500


def test_every_importance_is_returned(spark):
    got = rows(queries()["feature_importance"](spark, DATA), "idx")
    assert [i for i, _ in got] == list(range(64)) and abs(sum(v for _, v in got) - 1) < 1e-9
    assert min(v for _, v in got[:2]) > max(v for _, v in got[2:])


def test_every_song_has_its_cluster(spark):
    got = queries()["cluster_songs"](spark, DATA).collect()
    songs = {r["song_id"] for r in Catalog(spark, DATA).songs.select("song_id").collect()}
    assert {r["song_id"] for r in got} == songs and len(got) == len(songs)
    counts = {k: sum(r["cluster"] == k for r in got) for k in range(4)}
    assert all(r["cluster_songs"] == counts[r["cluster"]] and 0 < r["silhouette"] <= 1 for r in got)


def test_tune_and_multilabel_return_scores(spark):
    assert all(0 < r["accuracy"] <= 1 for r in queries()["tune"](spark, DATA).collect())
    assert all(0 <= r["hamming_loss"] < 0.5 for r in queries()["multilabel"](spark, DATA).collect())


def test_lyrics_models_have_scores_and_one_is_best(spark):
    got = {r["model"]: r for r in queries()["lyrics_classify"](spark, DATA).collect()}
    assert set(got) == {"naive_bayes", "logreg", "random_forest", "svm_linear", "knn"}
    assert all(0 < r["accuracy"] <= 1 and 0 < r["macro_f1"] <= 1 for r in got.values()) and len({r["n"] for r in got.values()}) == 1
    best = [r for r in got.values() if r["best"]]
    assert len(best) == 1 and best[0]["val_accuracy"] == max(r["val_accuracy"] for r in got.values())


def test_lyrics_neighbours_against_brute_force(spark):
    texts = {1: ("a a b", "x"), 2: ("a b b", "x"), 3: ("c d d", "y"), 4: ("c c d", "y"), 5: ("a b c d", "x")}
    df = models.with_words(spark.createDataFrame([(i, t, l) for i, (t, l) in texts.items()], "song_id bigint, text string, lang string"))
    test = models.with_words(spark.createDataFrame([(10, "a b", "x"), (11, "d c", "x")], "song_id bigint, text string, lang string"))
    assert rows(models.lyrics_knn(df, test, "lang", "song_id", k=3).select("song_id", "truth", "pred"), "song_id") == [(10, 0, 0), (11, 0, 1)]
