"""The physical plans are the ones wanted: pruned scans, pushed filters, local top-k, no pairing of tables."""

from pathlib import Path

import pytest

from __spark_entry__ import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables absent")


def plan(spark, name):
    return queries()[name](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


LAZY = ["playlist_topk", "knn_join", "tempo_band_join", "same_genre_recommend", "artist_similar", "confusion_matrix", "explain_distance", "keyword_search", "graph_context", "standard_scale"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["topk_per_query", "same_genre_recommend", "keywords_per_song", "gold_subset"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_flagship_reads_only_what_it_uses_and_keeps_k_rows(spark):
    p = plan(spark, "playlist_topk")
    assert "TakeOrderedAndProject" in p and "p_retailprice" not in p


def test_filter_reaches_the_scan(spark):
    p = plan(spark, "songs_by_artist")
    assert "EqualTo(p_brand,Brand#5)" in p and "p_size" not in p


@pytest.mark.parametrize("name", ["mel_bands", "mfcc", "coef_join", "vibe_weights", "impute_missing", "label_encode"])
def test_parameter_tables_are_broadcast_by_size(spark, name):
    p = plan(spark, name)
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning(bin" not in p
