"""The pipeline against a plain version of itself, and the SQL twins of the corpus queries."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_corpus import DOCS, brute_components, library_ids

import corpus_pipeline
from cadenza.llm import language, queries, toxicity

DATA = Path("/root/testdata/sf0.001")


def fixture(spark, folder):
    en, fr = "the house and the garden with the children of the town ", "la maison et le jardin avec les enfants de la ville "
    texts = [(en if i % 2 else fr) * 2 + f"number{i} word{i * 7} thing{i * 3} " * (1 + i % 5) for i in range(60)]
    for i in range(0, 60, 3):
        texts[i] += "nastyx vilewordy " * 4
    texts += [texts[1] + "again", texts[1], texts[2], None, "", "12345 !!", "long " * 3000]
    rows = [(i, t, ("en" if i % 2 else "fr") if i < 60 else None, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[4]], DOCS).withColumn("extra", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    texts = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    graded = toxicity.grade_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = sorted({r["doc_id"] for r in graded.collect() if not r["toxic"]})
    assert not {i for i in left if i < 60 and i % 3 == 0}
    clean = docs.where(F.col("doc_id").isin(left))
    judged = language.identify(clean, language.training_samples(clean, F.lit(True))).collect()
    left = sorted({r["doc_id"] for r in judged if r["lang_pred"] != "und" and r["score"] >= 0.5})
    assert not {63, 64, 65} & set(left)
    kept = [left[i] for i, _, component in brute_components([texts[i] for i in left], 5, 80) if component == i]
    assert not {61, 62} & set(kept)
    tokens = {i: len(x) + 1 for i, x in zip(kept, library_ids([texts[i] for i in kept]))}
    total = dict.fromkeys(kept, 0)
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == tokens


def test_stages_keep_the_columns_of_their_input(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want.select(", ".join(cols)).fetchall(), key=key)
