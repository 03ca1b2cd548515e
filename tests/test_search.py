"""Search that skips work: equal rows to brute force where it is exact, measured recall where it is not."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import inverted_file, knn as knn_module, lyrics
from cadenza.operators.knn import knn
from conftest import rows

# ---- pivot kNN ------------------------------------------------------------------------------


def clustered(rng, n, dims, centres=12):
    c = rng.normal(size=(centres, dims)) * 20
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims))


def frame(spark, x, name, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, v array<double>")


def brute(q, c, k, metric="euclidean", same=False):
    out = []
    for i, a in enumerate(q):
        with np.errstate(invalid="ignore"):
            d = 1 - c @ a / (np.linalg.norm(c, axis=1) * np.linalg.norm(a)) if metric == "cosine" else np.sqrt(((c - a) ** 2).sum(1))
        near = sorted((round(float(v), 9), j) for j, v in enumerate(d) if math.isfinite(v) and not (same and i == j))[:k]
        out += [(i, j, v, r + 1) for r, (v, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pivots_equal_brute_force_and_meet_few_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    c, q = clustered(rng, 900, 3), clustered(np.random.default_rng(1), 400, 3)
    q[7] = c[3] = 5.0
    monkeypatch.setattr(knn_module, "_grid", lambda *a: pytest.fail("the bounds should do"))
    got = knn(frame(spark, q, "q"), frame(spark, c, "c"), 4, metric=metric, bound=0, block=64)
    want = brute(q, c, 4, metric)
    assert [(a, b, r) for a, b, _, r in rows(got, "q", "rank")] == [(a, b, r) for a, b, _, r in want]
    assert all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(rows(got, "q", "rank"), want))


def test_pivots_with_copies_odd_rows_and_few_candidates(spark):
    rng = np.random.default_rng(2)
    c = clustered(rng, 300, 4)
    c[:120] = c[0]  # one vector holds more than a third of the rows
    data = frame(spark, c, "q")
    odd = spark.createDataFrame([(900, None), (901, [float("nan")] * 4), (902, [float("inf")] * 4), (903, [1.0, None, 1.0, 1.0])], "q bigint, v array<double>")
    got = knn(data.unionByName(odd), data.unionByName(odd).withColumnRenamed("q", "c"), 6, exclude_self=True, bound=0, block=32)
    assert [r[:2] for r in rows(got, "q", "rank")] == [r[:2] for r in brute(c, c, 6, same=True)]
    few = knn(data, frame(spark, c[118:124], "c", 118), 9, bound=0)
    assert few.count() == 300 * 6


def test_pairs_met_stay_well_below_all(spark):
    rng = np.random.default_rng(3)
    c = clustered(rng, 1200, 3)
    schema = "q bigint, c bigint, distance double, rank bigint"
    qs, cs = frame(spark, c, "q"), frame(spark, c, "c")
    partial = knn_module._pivots(qs, cs, 5, "euclidean", False, schema, 4096)
    # at most k rows leave each meeting of a query with a group
    meetings = partial.count() / 5
    groups = round((1200 / 20) ** 0.5)
    assert meetings < 0.5 * groups * 1200
    # without structure the bounds rule out too little, and say so
    noise = rng.normal(size=(600, 40))
    assert knn_module._pivots(frame(spark, noise, "q"), frame(spark, noise, "c"), 5, "euclidean", False, schema, 4096) is None


# ---- inverted file --------------------------------------------------------------------------


def recall(got, want):
    a = {(r[0], r[1]) for r in got}
    b = {(r[0], r[1]) for r in want}
    return len(a & b) / len(b)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_inverted_file_on_clusters_scores_few_and_finds_nearly_all(spark, metric):
    rng = np.random.default_rng(4)
    x = clustered(rng, 3000, 24, 60)
    items = frame(spark, x, "item")
    queries = items.where("item % 30 = 0").withColumnRenamed("item", "q")
    index = inverted_file.build_index(items, item_id="item", metric=metric, block=64)
    got = rows(inverted_file.search(index, queries, items, 10, query_id="q", item_id="item"))
    want = [(i, j) for i in range(0, 3000, 30) for _, j, _, _ in brute(x[i : i + 1], np.where((np.arange(3000) == i)[:, None], np.nan, x), 10, metric)]
    assert recall(got, want) >= 0.9
    work = inverted_file.effort(index, queries, query_id="q", deep=100).first()
    assert work["scored_at_most"] < 0.25 and work["compared"] < 0.1
    assert all(r[0] != r[1] for r in got) and max(r[3] for r in got) == 10


def test_inverted_file_without_structure_visits_more_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    items = frame(spark, x, "item")
    queries = items.where("item % 20 = 0").withColumnRenamed("item", "q")
    index = inverted_file.build_index(items, item_id="item")
    got = rows(inverted_file.search(index, queries, items, 10, query_id="q", item_id="item"))
    want = [(i, j) for i in range(0, 2000, 20) for _, j, _, _ in brute(x[i : i + 1], np.where((np.arange(2000) == i)[:, None], np.nan, x), 10)]
    assert recall(got, want) >= 0.9
    assert inverted_file.effort(index, queries, query_id="q", deep=100).first()["compared"] < 0.1


def test_inverted_file_keeps_copies_and_odd_tables(spark):
    items = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)] + [(200 + i, [float(i), 0.0]) for i in range(60)] + [(900, None), (901, [float("nan"), 0.0])], "item bigint, v array<double>")
    index = inverted_file.build_index(items, item_id="item", block=16)
    assert index.rows.count() == 260
    near = inverted_file.search(index, items.where("item = 7").withColumnRenamed("item", "q"), items, 5, query_id="q", item_id="item")
    assert rows(near, "rank") == [(7, i, 0.0, i + 1) for i in range(5)]
    assert inverted_file.build_index(items.limit(0), item_id="item") is None
    assert inverted_file.search(None, items.limit(0).withColumnRenamed("item", "q"), items, 5, query_id="q", item_id="item").collect() == []


# ---- MaxScore -------------------------------------------------------------------------------


def songs(spark, n=600, seed=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    zipf = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, zipf, k=rng.randint(1, 40))) for _ in range(n)] + [None, "", "w250 w250 w250 w251"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "song_id bigint, text string")


def plain_search(texts, queries, k):
    n, tf, df = len(texts), [], {}
    for t in texts:
        counts = {}
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
        tf.append(counts)
        for w in counts:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in df.items()}
    out = []
    for q, text in queries:
        terms = [w for w in dict.fromkeys(text.split()) if w in idf]
        found = sorted((-round(sum(c.get(w, 0) * idf[w] for w in terms), 6), i) for i, c in enumerate(tf))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate([f for f in found if f[0] < 0][:k])]
    return out


def test_keyword_search_equals_brute_force_and_scores_under_a_fifth(spark):
    texts, docs = songs(spark, 2500)
    queries = [(1, "w0 w1 w250"), (2, "w2 w90 w91 w3"), (3, "w0 w1 w2 w120"), (4, "nowhere"), (5, "w200"), (6, "w0 w150 w160 w170"), (7, " ".join(f"w{i}" for i in range(20)))]
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    got = rows(lyrics.keyword_search(docs, "song_id", asked, "item_id", 5).select("item_id", "song_id", "score", "rank"), "item_id", "rank")
    assert [(a, b, round(c, 6), d) for a, b, c, d in got] == plain_search(texts, queries, 5)
    wanted = asked.where("item_id < 7").select("item_id", F.explode(F.array_distinct(lyrics.tokens("text"))).alias("term"))
    index = lyrics.docs_with_any(docs, "song_id", wanted)
    before = index.join(wanted, "term").select("item_id", "song_id").distinct().count()
    now = lyrics.promising(index, wanted.withColumn("_qw", F.lit(1.0)), "song_id", "item_id", 5).count()
    assert now < before / 5, (now, before)


def test_similar_lyrics_equals_brute_force(spark):
    texts, docs = songs(spark, 300, 7)
    queries = [(1, "w0 w1 w250 w250"), (2, "w2 w90 w91 w3 w90"), (3, ""), (4, "nowhere"), (5, texts[17])]
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    got = rows(lyrics.similar_lyrics(docs, "song_id", asked, "item_id", 4).select("item_id", "song_id", "cosine"), "item_id", "cosine", "song_id")
    n, df = len(texts), {}
    counts = [{w: (t or "").split().count(w) for w in set((t or "").split())} for t in texts]
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    weigh = lambda c: {w: f * math.log((n + 1) / (df[w] + 1)) for w, f in c.items() if w in df}
    want = []
    for q, t in queries:
        v = weigh({w: t.split().count(w) for w in set(t.split())})
        found = []
        for i, c in enumerate(map(weigh, counts)):
            dot, length = sum(c.get(w, 0) * x for w, x in v.items()), math.sqrt(sum(x * x for x in c.values()) * sum(x * x for x in v.values()))
            if length and dot / length > 5e-7:
                found.append((-round(dot / length, 6), i))
        want += [(q, i, -s) for s, i in sorted(found)[:4]]
    assert [(a, b, round(c, 5)) for a, b, c in sorted(got, key=lambda r: (r[0], -r[2], r[1]))] == [(a, b, round(c, 5)) for a, b, c in want]


def test_blocks_hold_every_posting_once_under_their_largest_weight(spark):
    _, docs = songs(spark, 400, 8)
    index = lyrics.tfidf(docs, "song_id")
    blocks = lyrics.posting_blocks(index, "song_id", most=16).collect()
    held = sorted((b["term"], d["doc"]) for b in blocks for d in b["docs"])
    assert held == sorted(tuple(r) for r in index.where("weight > 0").select("term", "song_id").collect())
    assert all(b["top"] == max(d["w"] for d in b["docs"]) for b in blocks) and max(len(b["docs"]) for b in blocks) < 64
