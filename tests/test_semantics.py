"""Hand-computed fixtures for ties, NULL, zero variance, empty results and broken requests."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.functions import distance, musical, text
from cadenza.operators import audio, bayes, filters, graph, joins, metrics, models, prep, ranking, requests as rq, retrieval, rhythm, similarity, svm
from conftest import rows


@pytest.fixture(scope="module")
def songs(spark):
    data = [
        (1, "a", ["rock"], 100.0, 0.5, 1990), (2, "a", ["pop"], 110.0, 0.5, 2000), (3, "b", ["rock"], 110.0, 0.5, 2010),
        (4, "b", ["jazz"], 90.0, 0.5, None), (5, "c", None, 150.0, 0.5, 1999),
    ]
    return spark.createDataFrame(data, "song_id int, artist string, genres array<string>, tempo double, valence double, release_year int")


def test_ranges_are_inclusive_and_unknown_years_stay(songs):
    kept = filters.outside_year_ranges(songs, [(1990, 1999), (2010, 2019)])
    assert rows(kept.select("song_id"), "song_id") == [(2,), (4,)]
    assert rows(filters.genre_exclude(songs, ["ROCK"]).select("song_id"), "song_id") == [(2,), (4,), (5,)]


def test_constant_column_scales_to_zero(songs):
    out = prep.minmax_scale(prep.standard_scale(songs, ["valence"]), ["valence"])
    assert {r[0] for r in out.select("valence").collect()} == {0.0}


def test_playlist_ties_break_on_id_and_seed_is_out(songs):
    out = similarity.playlist(songs, 1, {"tempo": 1.0, "valence": 1.0}, 3)
    assert [r.song_id for r in out.collect()] == [2, 3, 4]
    assert similarity.playlist(songs, 1, {"tempo": 1.0}, 3, exclude_years=[(0, 3000)]).select("song_id").collect()[0][0] == 4


def test_missing_seed_gives_no_rows(songs):
    assert similarity.playlist(songs, 99, {"tempo": 1.0}, 3).isEmpty()


def test_distance_is_zero_on_self_and_symmetric(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(0.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(distance.cosine(a, b).alias("x"), distance.cosine(b, a).alias("y"), distance.cosine(a, zero).alias("z")).first()
    assert r.x == r.y and r.z is None


def test_weights_sum_to_one_or_stay_zero(spark):
    df = spark.sql("select map('a', 1D, 'b', 3D) m union all select map('a', 0D)")
    assert sorted(str(r[0]) for r in df.select(distance.normalized_weights(F.col("m"))).collect()) == ["{'a': 0.0}", "{'a': 0.25, 'b': 0.75}"]


def test_requests_report_every_error(spark):
    docs = [
        ("ok", '{"type":"playlist","seed":7,"k":10,"match":["tempo: 0.7","valence"],"exclude":{"genre":["X"]}}'),
        ("broken", '{"type":"playlist"'),
        ("feature", '{"type":"playlist","k":1,"match":["loudness: 1"]}'),
        ("k", '{"type":"similarity","k":0}'),
        ("range", '{"type":"similarity","k":1,"exclude":{"year_range":[[2010,2000]]}}'),
        ("type", '{"type":"dance","k":1,"match":["energy: -1"]}'),
    ]
    out = rq.validate_requests(rq.parse_requests(spark.createDataFrame(docs, "id string, doc string")))
    errors = {r.id: list(r.errors) for r in out.collect()}
    assert errors["ok"] == [] and "malformed" in errors["broken"] and errors["feature"] == ["unknown feature"]
    assert errors["k"] == ["k must be positive"] and errors["range"] == ["bad year range"] and errors["type"] == ["unknown type", "negative weight"]
    assert out.where("id = 'ok'").first().weights == {"tempo": 0.7, "valence": 1.0}


def test_text_forms(spark):
    r = spark.range(1).select(
        text.tokens(F.lit("Don't STOP, été\n7!")).alias("t"), text.split_multivalue(F.lit("Rock, pop,ROCK,,")).alias("m"), text.normal_name(F.lit("  The   Beat les ")).alias("n")
    ).first()
    assert r.t == ["don't", "stop", "été", "7"] and r.m == ["rock", "pop"] and r.n == "beat les"


def test_tempo_words(spark):
    df = spark.createDataFrame([(59.9,), (60.0,), (176.0,), (None,)], "b double")
    assert [r[0] for r in df.select(musical.tempo_class(F.col("b"))).collect()] == ["Largo", "Adagio", "Presto", None]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0), (1, 2), (2, 2)], "truth int, pred int")


def test_confusion_is_zero_filled_and_sums_to_rows(preds):
    cm = metrics.confusion_matrix(preds)
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 6


def test_label_never_predicted_scores_zero(preds):
    report = {r.label: r for r in metrics.classification_report(metrics.confusion_matrix(preds)).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0.0, 0.0, 0.0, 3)
    assert report["accuracy"].f1 == pytest.approx(2 / 6) and report["2"].recall == 1.0


def test_confused_pairs_order_backwards_on_ties(preds):
    top = metrics.most_confused_pairs(metrics.confusion_matrix(preds), 10)
    assert [(r.truth, r.pred, r.n) for r in top.collect()] == [(1, 0, 2), (1, 2, 1), (0, 1, 1)]


def test_vote_and_best_model_ties(spark):
    votes = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (1, 1), (2, 3)], "id int, pred int")
    assert rows(metrics.hard_vote(votes, "id"), "id") == [(1, 1), (2, 3)]
    s = spark.createDataFrame([("gb", 0.7, 1), ("rf", 0.7, 0), ("lr", 0.6, 2)], "model string, accuracy double, priority int")
    assert metrics.best_model(s).first().model == "rf"


def test_fusion_ignores_order(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 1, 3)], "query string, item int, rank int")
    a = rows(ranking.reciprocal_rank_fusion(hits, ["query"], "item"), "item")
    b = rows(ranking.reciprocal_rank_fusion(hits.orderBy(F.desc("rank")), ["query"], "item"), "item")
    assert a == b and a[0][2] == pytest.approx(1 / 61 + 1 / 63)


def test_split_is_a_partition_with_class_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 333, "hot").otherwise((F.col("id") % 7).cast("string")).alias("label"))
    out = prep.stratified_split(df, "id", "label")
    assert out.select("id").distinct().count() == 1000
    hot = {r.split: r["count"] for r in out.where("label = 'hot'").groupBy("split").count().collect()}
    assert hot == {"train": 266, "val": 33, "test": 34}


def test_close_names_equal_brute_force(spark):
    names = ["abba", "abb", "baba", "queen", "quen", "qen", "xyz", "a", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b) for r in retrieval.near_duplicate_names(df, "name").collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string").where(F.levenshtein("a", "b") <= 2)
    assert got == {(r.a, r.b) for r in pairs.collect()}


def test_seed_lookup_prefers_closeness_then_popularity(spark):
    names = spark.createDataFrame([(1, "Creep", 5.0), (2, "Crepe", 9.0), (3, "The Creep", 7.0)], "id int, name string, pop double")
    wanted = spark.createDataFrame([(1, "the  CREEP"), (2, "crepp"), (3, "zzzzzzz")], "request int, typed string")
    assert rows(joins.seed_lookup(wanted, "request", "typed", names, "id", "name", "pop"), "request") == [(1, 3, 0), (2, 2, 1), (3, None, None)]


def test_jaccard_join_equals_brute_force(spark):
    sets = {1: "abcd", 2: "abcd", 3: "abce", 4: "xyz", 5: "xy", 6: "a", 7: "abcdefgh"}
    df = spark.createDataFrame([(i, ch) for i, s in sets.items() for ch in s], "id int, i string")
    got = {(r.a, r.b, r.holders_a, r.holders_b): round(r.jaccard, 6) for r in graph.set_similarity(df, "id", "i", 0.5).collect()}
    assert got == {(1, 1, 2, 2): 1.0, (1, 3, 2, 1): 0.6, (4, 5, 1, 1): 0.666667, (1, 7, 2, 1): 0.5, (3, 7, 1, 1): 0.5}


def test_graph_is_safe_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "src string, dst string, rel string")
    assert rows(graph.reach(e, ["a"], 10), "node") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    closed = graph.hierarchy_closure(e.select(F.col("src").alias("parent"), F.col("dst").alias("child")))
    assert closed.where("ancestor = descendant").isEmpty() and closed.count() == 9
    ranks = graph.pagerank(e, 30)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_components(spark):
    p = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(50, 51)], "a int, b int")
    labels = dict(rows(graph.connected_components(p, "a", "b")))
    assert {labels[i] for i in range(1, 21)} == {1} and labels[51] == 50


def test_basis_shapes_and_feature_layouts(spark):
    assert len(audio.feature_layout("basic")) == 25 and audio.feature_layout("basic")[24] == "tempo"
    full = audio.feature_layout("full")
    assert len(full) == len(set(full)) == 390
    d = audio.dct_basis(spark, 8, 8)
    same = d.join(d.withColumnRenamed("coef", "c2").withColumnRenamed("w", "w2"), "bin").groupBy("coef", "c2").agg(F.sum(F.col("w") * F.col("w2")).alias("s"))
    assert same.where(F.abs(F.col("s") - F.when(F.col("coef") == F.col("c2"), 1).otherwise(0)) > 1e-9).isEmpty()


def test_clip_of_one_frame(spark):
    cells = spark.createDataFrame([(1, 0, b, float(b)) for b in range(8)], "clip int, frame int, bin int, value double")
    assert rows(audio.spectral_flux(cells)) == [(1, 0, 0.0)]
    assert audio.delta(cells).isEmpty()
    s = audio.frame_stats(cells, ["clip"]).first()
    assert (s.mean, s.max, s.min) == (3.5, 7.0, 0.0)


def test_silent_frame_has_no_nan(spark):
    cells = spark.createDataFrame([(1, 0, b, 0.0) for b in range(8)], "clip int, frame int, bin int, value double")
    assert {r.value for r in audio.chroma(cells, 8).collect()} == {0.0}
    assert {r.value for r in audio.power_to_db(cells).collect()} == {0.0}
    c = audio.centroid_bandwidth(cells, 8).first()
    assert c.centroid is None


def test_stft_of_a_pure_tone(spark):
    data = [(1, t, math.cos(2 * math.pi * 4 * t / 32)) for t in range(64)]
    mag = audio.stft_magnitude(audio.frame_signal(spark.createDataFrame(data, "clip int, t int, x double"), 32, 16), 32)
    peak = mag.groupBy("frame").agg(F.max_by("bin", "value").alias("bin"))
    assert rows(peak, "frame") == [(0, 4), (1, 4), (2, 4)]


def test_metronome(spark):
    data = [(1, t, 1.0 if t % 10 == 0 else 0.0) for t in range(200)]
    env = rhythm.centred(rhythm.dense_envelope(spark.createDataFrame([d for d in data if d[2]], "clip int, t int, strength double")))
    ac = rhythm.autocorrelation(env, 40)
    assert rhythm.tempo_autocorr(ac, 5, 40, 0.05).first().lag == 10
    assert rhythm.tempo_comb(ac, 5, 20, 0.05).first().bpm == pytest.approx(120.0)
    r = rhythm.tempo_result(ac, 5, 40, 0.05).first()
    assert r.tempo_class == "Allegro" and 0.5 < r.confidence <= 1


def test_swing_meter_and_odd_beat_counts(spark):
    secs, t = [], 0.0
    for i in range(13):
        secs.append(t)
        t += 0.4 if i % 2 == 0 else 0.2
    data = [(1, i, f"2024-01-01 00:00:{s:06.3f}", 3.0 if i % 3 == 0 else 1.0) for i, s in enumerate(secs)]
    ev = spark.createDataFrame(data, "clip int, event_id int, s string, value double").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    beats = rhythm.number_beats(ev)
    r = rhythm.swing_ratio(beats).first()
    assert r.ratio == pytest.approx(2.0) and r.swung
    assert rhythm.meter_class(beats).first().meter == "3/4"
    assert rhythm.inter_beat_interval(beats).first().median_interval == pytest.approx(0.3, abs=0.11)


def test_sessions_cross_midnight(spark):
    ts = ["2024-01-01 23:50:00", "2024-01-02 00:10:00", "2024-01-02 00:40:00", "2024-01-02 01:10:01"]
    log = spark.createDataFrame([(i, 1, t) for i, t in enumerate(ts)], "event_id int, user_id int, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    assert [r[0] for r in rows(rhythm.session_split(log).select("session", "event_id"), "event_id")] == [1, 1, 1, 2]


def separable(spark):
    rows_ = [(i, i % 3, [5.0 * (i % 3 == 0) + (i % 7) / 10, 5.0 * (i % 3 == 1) + (i % 5) / 10, 5.0 * (i % 3 == 2)]) for i in range(150)]
    return spark.createDataFrame(rows_, "vec_id int, label int, x array<double>")


@pytest.mark.parametrize("name", ["gnb", "mnb", "svm", "rbf", "poly"])
def test_classifiers_learn_separable_data(spark, name):
    d = separable(spark)
    train, test = d.where("vec_id < 100"), d.where("vec_id >= 100")
    if name == "gnb":
        out = bayes.gaussian_nb(train, test)
    elif name == "mnb":
        out = bayes.multinomial_nb(train, test)
    elif name == "svm":
        out = svm.predict(bayes.standard_arrays(train, test), svm.train_ovr(bayes.standard_arrays(train, train), steps=30))
    else:
        lift = models.random_fourier if name == "rbf" else (lambda _, df: models.random_monomials(df, size=64, gamma=0.1))
        _, p = models.fit_predict(models.classifier("svm_linear", 100), lift(train, train), lift(train, test))
        out = p.withColumnRenamed("truth", "label")
    assert out.where("label = pred").count() / 50 > 0.9


def test_svm_argmax_takes_first_class_on_ties(spark):
    model = spark.createDataFrame([(0, [1.0], 0.0), (1, [1.0], 0.0)], "label int, w array<double>, b double")
    df = spark.createDataFrame([(1, [2.0])], "vec_id int, x array<double>")
    assert svm.predict(df, model).first().pred == 0


def test_feature_cache_computes_only_new_ids(spark, tmp_path):
    from cadenza.sources.files import cached_features

    seen = []

    def compute(df):
        seen.append(df.count())
        return df.select("id", (F.col("id") * 2).alias("f"))

    path = str(tmp_path / "cache")
    cached_features(spark.range(3), "id", path, compute)
    assert rows(cached_features(spark.range(5), "id", path, compute), "id") == [(i, 2 * i) for i in range(5)]
    assert seen == [3, 2]


def test_labelled_files(spark, tmp_path):
    from cadenza.sources.files import scan_labeled_files

    for g in ("jazz", "rock"):
        (tmp_path / g).mkdir()
        (tmp_path / g / "1.wav").write_bytes(b"x")
        (tmp_path / g / "skip.txt").write_bytes(b"x")
    out = scan_labeled_files(spark, str(tmp_path))
    assert rows(prep.label_encode(out.select("label"), "label").select("label", "code"), "label") == [("jazz", 0), ("rock", 1)]
