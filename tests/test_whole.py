"""Nothing is cut off: long windows, long chains, oversized passages, odd requests, ragged vectors, workers without the package."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cadenza.operators import graph, metrics, requests as rq, retrieval, rhythm
from cadenza.operators.knn import knn
from cadenza.sources.files import cached_features


def test_autocorrelation_beyond_a_chunk(spark):
    env = spark.range(9000).select(F.lit("c").alias("clip"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("strength"))
    got = dict(rows(rhythm.autocorrelation(env, 5000).where("lag % 2500 = 0").select("lag", "ac"), "lag"))
    assert got == {0: 9000.0, 2500: 6500.0, 5000: 4000.0}


def test_chains_are_followed_to_their_end(spark):
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "r") for i in range(20)], "src string, dst string, rel string")
    assert graph.shortest_paths(e, "n10").count() == 21
    assert graph.reach(e, ["n00"]).agg(F.max("hops")).first()[0] == 20
    assert graph.hierarchy_closure(e.select(F.col("src").alias("parent"), F.col("dst").alias("child"))).count() == 210
    assert {r["label"] for r in graph.connected_components(e, "src", "dst").collect()} == {"n00"}


def test_a_query_with_an_oversized_passage_stays(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1)], "q int, d int, rank int")
    docs = spark.createDataFrame([(10, "x" * 50), (11, "short")], "d int, text string")
    assert rows(retrieval.rag_context(hits, docs, "q", "d", 20), "q") == [(1, 0, 0, ""), (2, 1, 5, "[11] short")]


def test_odd_requests_are_reported_one_by_one(spark):
    ask = lambda match: json.dumps({"type": "playlist", "seed": 1, "k": 3, "match": match})
    docs = spark.createDataFrame([(0, ask(["energy: 0.6", "valence"])), (1, ask(["energy: 0.6", "energy: 0.3"])), (2, ask([None])), (3, ask(["energy: abc"])), (4, "{")], "id int, doc string")
    got = {r["id"]: r for r in rq.validate_requests(rq.parse_requests(docs)).collect()}
    assert got[0]["errors"] == [] and got[0]["weights"] == {"energy": 0.6, "valence": 1.0}
    assert [got[i]["errors"] for i in range(1, 5)] == [["duplicate feature"], ["empty feature"], ["bad weight"], ["malformed"]]
    lists = spark.createDataFrame([("k = 3\nk = 4\nmatch = energy",)], "doc string")
    assert rq.parse_constraint_list(lists, "doc").first()["k"] == 3


def test_vectors_of_unequal_length_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [9.0])], "q int, v array<double>")
    with pytest.raises((PythonException, ValueError), match="unequal length"):
        knn(df, df.withColumnRenamed("q", "c"), 1).collect()


def test_hours_before_and_after_an_epoch_stay_apart(spark):
    log = spark.sql("select timestamp_ntz'2023-12-31 23:30:00' as ts, 1.0D as latency_ms union all select timestamp_ntz'2024-01-01 00:30:00', 2.0D")
    assert rows(metrics.throughput(log), "hour_no") == [(-1, 1, 1.0), (0, 1, 2.0)]


def test_a_cache_of_another_kind_is_not_taken_for_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.range(3).select(F.col("id").alias("other")).write.parquet(path)
    with pytest.raises(Exception):
        cached_features(spark.range(3), "id", path, lambda df: df)
    assert spark.read.parquet(path).columns == ["other"]


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from cadenza.session import local_session\nfrom cadenza.operators.knn import knn\n"
        "s = local_session(2, memory='1g')\n"
        "q = s.createDataFrame([(1, [0.0, 1.0])], 'q int, v array<double>')\n"
        "c = s.createDataFrame([(5, [0.0, 2.0]), (6, [9.0, 9.0])], 'c int, v array<double>')\n"
        "print([tuple(r) for r in knn(q, c, 1).collect()])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "[(1, 5, 1.0, 1)]" in done.stdout, done.stderr[-500:]
