"""Joins, aggregations, rankings, set operations and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cadenza.operators import joins, metrics, profiles, ranking
from cadenza.operators.prep import in_share, standard_scale
from cadenza.plans.catalogue import _share, r6
from cadenza.plans.registry import query
from cadenza.sources.catalog import FEATURES


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({x: r6(x) for x in cols})


# ---- joins ----------------------------------------------------------------------------------


@query(
    "equi_catalog_join",
    "select a.album_id, a.song_id, s.title, ar.name as artist_name, n.n_name as country, s.genre, cast(year(i.release_date) as int) as album_year "
    "from albums a join songs s on a.song_id = s.song_id join album_info i on a.album_id = i.album_id join artists ar on a.credited_artist = ar.artist_id "
    "join nation n on ar.nation_id = n.n_nationkey",
)
def equi_catalog_join(c):
    n = c.table("nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("country"))
    ar = c.artists.select(F.col("artist_id").alias("credited_artist"), F.col("name").alias("artist_name"), "nation_id")
    return (
        c.albums.join(c.songs.select("song_id", "title", "genre"), "song_id")
        .join(c.album_info.select("album_id", F.year("release_date").alias("album_year")), "album_id")
        .join(ar, "credited_artist")
        .join(n, "nation_id")
        .select("album_id", "song_id", "title", "artist_name", "country", "genre", "album_year")
    )


@query(
    "seed_lookup",
    "with w as (select artist_id as request, case when artist_id % 2 = 0 then replace(lower(name), 'supplier', 'suplier') when artist_id % 7 = 0 then 'zzzz' else lower(name) end as typed from artists), "
    "p as (select request, artist_id, levenshtein(typed, lower(name)) as edits, row_number() over (partition by request order by levenshtein(typed, lower(name)), s_acctbal desc, artist_id) as rn "
    "from w, artists join supplier on s_suppkey = artist_id) "
    "select request, case when edits <= 2 then artist_id end as artist_id, case when edits <= 2 then cast(edits as int) end as edits from p where rn = 1",
)
def seed_lookup(c):
    typed = (
        F.when(F.col("artist_id") % 2 == 0, F.regexp_replace("name", "Supplier", "The SUPLIER"))
        .when(F.col("artist_id") % 7 == 0, "zzzz")
        .otherwise(F.upper("name"))
    )
    wanted = c.artists.select(F.col("artist_id").alias("request"), typed.alias("typed"))
    named = c.table("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("popularity"))
    return joins.seed_lookup(wanted, "request", "typed", named, "artist_id", "name", "popularity")


@query(
    "same_album",
    "select b.song_id, count(distinct b.album_id) as shared_albums from albums a join albums b on a.album_id = b.album_id where a.song_id = 7 and b.song_id <> 7 group by 1",
)
def same_album(c):
    return joins.same_album(c.albums, 7)


@query(
    "same_genre_recommend",
    "select genre, artist, song_id, rank from (select s.genre, s.artist, t.song_id, row_number() over (partition by s.genre, s.artist order by t.popularity desc, t.song_id) as rank "
    "from (select distinct genre, artist from songs) s join songs t on s.genre = t.genre and s.artist <> t.artist) where rank <= 10",
)
def same_genre_recommend(c):
    out = profiles.same_genre_lists(c.songs.select("genre", "artist", "song_id", "popularity"), 10)
    return out.select("genre", "artist", "song_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "artist_collab",
    "select b.credited_artist, count(distinct b.album_id) as shared_albums from albums a join albums b on a.album_id = b.album_id where a.credited_artist = 7 and b.credited_artist <> 7 group by 1",
)
def artist_collab(c):
    return joins.collaborators(c.albums, 7)


_ZF = "(select song_id, artist, " + ", ".join(f"({f} - avg({f}) over ()) / stddev_pop({f}) over () as {f}" for f in FEATURES) + " from songs)"


def _d(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{f}-{b}.{f})**2" for f in FEATURES) + ")"


@query(
    "seed_knn_join",
    f"with z as {_ZF}, seeds as (select song_id as seed, z.* exclude (song_id) from z join (select artist as a, min(song_id) as s from songs group by 1) on song_id = s), "
    f"r as (select seed, z.song_id, round({_d('seeds', 'z')},9) as d from seeds, z where seed <> z.song_id), "
    "k as (select *, row_number() over (partition by seed order by d, song_id) as rank from r) select seed, song_id, round(d,6) as distance, rank from k where rank <= 5",
)
def seed_knn_join(c):
    from cadenza.operators.knn import knn

    z = standard_scale(c.songs, FEATURES)
    v = profiles.packed(z, "song_id", FEATURES, "song_id")
    seeds = c.songs.groupBy("artist").agg(F.min("song_id").alias("seed")).select("seed")
    q = v.withColumnRenamed("song_id", "seed").join(seeds, "seed", "left_semi")
    return rounded(knn(q, v, 5, query_id="seed", candidate_id="song_id", exclude_self=True), "distance")


_PZ = "(select artist, " + ", ".join(f"avg({f}) as {f}" for f in FEATURES) + " from z group by 1)"


@query(
    "knn_join",
    f"with z as {_ZF}, p as {_PZ}, r as (select z.song_id, p.artist, round({_d('z', 'p')},9) as d from z, p), "
    "k as (select *, row_number() over (partition by song_id order by d, artist) as rank from r) select song_id, artist, round(d,6) as distance, rank from k where rank <= 3",
)
def knn_join(c):
    z = standard_scale(c.songs, FEATURES)
    prof = z.groupBy("artist").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return rounded(profiles.nearest_profiles(z, prof, FEATURES, 3), "distance")


@query(
    "exclude_seen",
    "select event_id, user_id, song_id from (select event_id, user_id, event_id % (select count(*) from part) as song_id from events) r "
    "where not exists (select 1 from plays p where p.user_id = r.user_id and p.song_id = r.song_id)",
)
def exclude_seen(c):
    many = c.table("part").agg(F.count("*")).scalar()
    shown = c.table("events").select("event_id", "user_id", (F.col("event_id") % many).alias("song_id"))
    return shown.join(c.plays.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti").select("event_id", "user_id", "song_id")


@query(
    "tempo_band_join",
    "with q as (select artist, avg(tempo) as bpm from songs group by 1) select q.artist, s.song_id, round(abs(s.tempo - q.bpm),6) as off from q join songs s on abs(s.tempo - q.bpm) <= 3",
)
def tempo_band_join(c):
    q = c.songs.groupBy("artist").agg(F.avg("tempo").alias("bpm"))
    out = joins.band_join(q, c.songs.select("song_id", "tempo"), bpm="bpm", tempo="tempo", tolerance=3.0)
    return out.select("artist", "song_id", r6(F.abs(F.col("tempo") - F.col("bpm"))).alias("off"))


# ---- aggregations ---------------------------------------------------------------------------


def _majority(cat: str) -> str:
    return (
        f"(select artist, {cat} from (select artist, {cat}, row_number() over (partition by artist order by count(*) desc, {cat}) as rn from songs group by artist, {cat}) where rn = 1)"
    )


@query(
    "artist_profile",
    "select p.*, a.song_key, b.song_mode from (select artist, " + ", ".join(f"round(avg({f}),6) as {f}" for f in FEATURES)
    + ", count(*) as n_songs, min(release_year) as first_year, max(release_year) as last_year, string_agg(distinct genre, ',' order by genre) as genres from songs group by 1) p "
    f"join {_majority('song_key')} a using (artist) join {_majority('song_mode')} b using (artist)",
)
def artist_profile(c):
    out = profiles.artist_profile(c.songs, FEATURES)
    return rounded(out, *FEATURES).withColumn("genres", F.array_join("genres", ","))


@query("artist_profile_median", "select artist, " + ", ".join(f"round(median({f}),6) as {f}" for f in FEATURES) + " from songs group by 1")
def artist_profile_median(c):
    return rounded(profiles.artist_medians(c.songs, FEATURES), *FEATURES)


@query("artist_profile_var", "select artist, " + ", ".join(f"round(var_pop({f}),6) as {f}" for f in FEATURES) + " from songs group by 1")
def artist_profile_var(c):
    return rounded(profiles.artist_variances(c.songs, FEATURES), *FEATURES)


@query(
    "artist_profile_shrunk",
    "select artist, count(*) as n, " + ", ".join(f"round((count(*)*avg({f}) + 5*(select avg({f}) from songs)) / (count(*) + 5),6) as {f}" for f in FEATURES) + " from songs group by 1",
)
def artist_profile_shrunk(c):
    return rounded(profiles.shrunk_profile(c.songs, FEATURES), *FEATURES)


@query(
    "artist_histogram",
    "select artist, cast(least(floor((tempo - lo) / ((hi - lo) / 10)), 9) as int) as bin, count(*) as n from songs, (select min(tempo) as lo, max(tempo) as hi from songs) group by 1, 2",
)
def artist_histogram(c):
    return profiles.artist_histogram(c.songs, "tempo")


def _method(name: str, prof: str, dist: str) -> str:
    return (
        f"select '{name}' as method, avg(case when artist = truth then 1.0::double else 0.0 end) as accuracy from (select z.song_id, z.artist as truth, p.artist, "
        f"row_number() over (partition by z.song_id order by round({dist},9), p.artist) as rn from z, {prof} p) where rn = 1"
    )


_MEAN = "(select artist, " + ", ".join(f"avg({f}) as {f}, var_pop({f}) as v_{f}" for f in FEATURES) + " from z group by 1)"
_MED = "(select artist, " + ", ".join(f"median({f}) as {f}" for f in FEATURES) + " from z group by 1)"


@query(
    "profile_method_compare",
    f"with z as {_ZF}, methods as ("
    + " union all ".join(
        [
            _method("mean", _MEAN, _d("z", "p")),
            _method("median", _MED, _d("z", "p")),
            _method("variance", _MEAN, "sqrt(" + " + ".join(f"(z.{f}-p.{f})**2/(p.v_{f}+1e-9)" for f in FEATURES) + ")"),
        ]
    )
    + ") select method, round(accuracy,6) as accuracy from methods",
)
def profile_method_compare(c):
    return rounded(profiles.method_accuracy(c.songs, FEATURES), "accuracy")


@query(
    "class_weights",
    "select genre, count(*) as n, round((select count(*) from songs) / ((select count(distinct genre) from songs) * count(*)::double),6) as weight from songs group by 1",
)
def class_weights(c):
    return rounded(profiles.class_weights(c.songs, "genre"), "weight")


@query(
    "popular_genres",
    "select g as genre, count(*) as songs, round(avg(popularity),6) as mean_popularity from (select unnest(genres) as g, popularity from songs) group by 1",
)
def popular_genres(c):
    return (
        c.songs.select(F.explode("genres").alias("genre"), "popularity")
        .groupBy("genre")
        .agg(F.count("*").alias("songs"), r6(F.avg("popularity")).alias("mean_popularity"))
    )


@query(
    "catalog_profile",
    "select 'songs' as what, count(distinct song_id) as n from songs union all select 'artists', count(distinct artist) from songs union all "
    "select 'albums', count(distinct album_id) from albums union all select 'languages', count(distinct lang) from lyrics union all "
    "select 'genres', count(distinct g) from (select unnest(genres) as g from songs) union all select 'tags', count(distinct t) from (select unnest(tags) as t from songs)",
)
def catalog_profile(c):
    s = c.songs
    counted = {
        "songs": s.select(F.col("song_id").cast("string").alias("v")),
        "artists": s.select(F.col("artist").alias("v")),
        "albums": c.table("lineitem").select(F.col("l_orderkey").cast("string").alias("v")),
        "languages": c.lyrics.select(F.col("lang").alias("v")),
        "genres": s.select(F.explode("genres").alias("v")),
        "tags": s.select(F.explode("tags").alias("v")),
    }
    long = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("what"), "v") for k, df in counted.items()])
    return long.distinct().groupBy("what").agg(F.count("v").alias("n"))


@query("language_counts", "select lang, count(*) as songs from lyrics group by 1")
def language_counts(c):
    return c.lyrics.groupBy("lang").agg(F.count("*").alias("songs"))


@query("play_counts", "select song_id, sum(plays) as plays, count(distinct user_id) as listeners from plays group by 1")
def play_counts(c):
    # one row per song and listener first: the distinct count then is a plain count
    per = c.plays.groupBy("song_id", "user_id").agg(F.sum("plays").alias("plays"))
    return per.groupBy("song_id").agg(F.sum("plays").alias("plays"), F.count("user_id").alias("listeners"))


@query("accuracy", "select split, model, round(avg(case when truth = pred then 1.0::double else 0.0 end),6) as accuracy from ballots group by 1, 2")
def accuracy(c):
    return rounded(metrics.accuracy(c.ballots, ["split", "model"]), "accuracy")


_NEAR = (
    f"with z as {_ZF}, p as {_PZ}, r as (select z.song_id, z.artist as truth, p.artist, row_number() over (partition by z.song_id order by round({_d('z', 'p')},9), p.artist) as rank from z, p) "
)


def _nearest(c, k):
    z = standard_scale(c.songs, FEATURES)
    prof = z.groupBy("artist").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return profiles.nearest_profiles(z, prof, FEATURES, k).join(c.songs.select("song_id", F.col("artist").alias("truth")), "song_id")


@query(
    "topk_accuracy",
    _NEAR + "select cast(k as int) as k, round(avg(case when h <= k then 1.0::double else 0.0 end),6) as accuracy from (select song_id, min(rank) filter (truth = artist) as h from r group by 1), (values (1),(5)) v(k) group by 1",
)
def topk_accuracy(c):
    return rounded(metrics.top_k_accuracy(_nearest(c, 5), "song_id", F.col("truth"), F.col("artist")), "accuracy")


_CM = (
    "cm as (select t.l as truth, p.l as pred, count(x.vec_id) as n from (select distinct truth as l from preds union select distinct pred from preds) t "
    "cross join (select distinct truth as l from preds union select distinct pred from preds) p left join preds x on x.truth = t.l and x.pred = p.l group by 1, 2)"
)


@query("confusion_matrix", f"with {_CM} select * from cm")
def confusion_matrix(c):
    return metrics.confusion_matrix(c.preds)


@query("confusion_norm", f"with {_CM} select truth, pred, round(n / nullif(sum(n) over (partition by truth), 0),6) as share from cm")
def confusion_norm(c):
    return rounded(metrics.confusion_shares(metrics.confusion_matrix(c.preds)), "share")


@query(
    "per_class_accuracy",
    f"with {_CM} select coalesce(cast(truth as varchar), 'OVERALL') as label, cast(sum(n) filter (truth = pred) as bigint) as correct, cast(sum(n) as bigint) as total, "
    "round(sum(n) filter (truth = pred) / sum(n)::double,6) as accuracy from cm group by rollup (truth)",
)
def per_class_accuracy(c):
    return rounded(metrics.per_class_accuracy(metrics.confusion_matrix(c.preds)), "accuracy")


@query("most_confused_pairs", f"with {_CM} select * from (select * from cm where truth <> pred order by n desc, truth desc, pred desc limit 10) where n > 0")
def most_confused_pairs(c):
    return metrics.most_confused_pairs(metrics.confusion_matrix(c.preds))


@query(
    "classification_report",
    f"with {_CM}, l as (select distinct truth as label from cm), s as (select label, (select n from cm where truth = label and pred = label) as tp, "
    "(select sum(n) from cm where truth = label) as support, (select sum(n) from cm where pred = label) as predicted from l), "
    "q as (select label, tp, support, coalesce(tp / nullif(predicted,0)::double, 0) as p, coalesce(tp / nullif(support,0)::double, 0) as r from s), "
    "f as (select *, coalesce(2*p*r/nullif(p+r,0), 0) as f1 from q) "
    "select cast(label as varchar) as label, round(p,6) as precision, round(r,6) as recall, round(f1,6) as f1, cast(support as bigint) as support from f union all "
    "select 'accuracy', round(sum(tp)/sum(support)::double,6), round(sum(tp)/sum(support)::double,6), round(sum(tp)/sum(support)::double,6), cast(sum(support) as bigint) from f union all "
    "select 'macro avg', round(avg(p),6), round(avg(r),6), round(avg(f1),6), cast(sum(support) as bigint) from f union all "
    "select 'weighted avg', round(sum(p*support)/sum(support),6), round(sum(r*support)/sum(support),6), round(sum(f1*support)/sum(support),6), cast(sum(support) as bigint) from f",
)
def classification_report(c):
    return rounded(metrics.classification_report(metrics.confusion_matrix(c.preds)), "precision", "recall", "f1")


_EV = (
    "with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), r as (select a.vec_id as q, a.label as ql, b.vec_id as c, b.label as cl, "
    "row_number() over (partition by a.vec_id order by round(1 - list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))),9), b.vec_id) as rank "
    "from e a join e b on a.vec_id <> b.vec_id) "
)


def _neighbours(c, k, metric="cosine"):
    from cadenza.operators.knn import knn

    v = c.vectors.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return knn(v, v.withColumnRenamed("q", "c"), k, metric=metric, exclude_self=True)


@query(
    "precision_recall_at_k",
    _EV + "select q as vec_id, round(count(*) filter (cl = ql and rank <= 10) / 10.0::double,6) as precision, "
    "round(count(*) filter (cl = ql and rank <= 10) / nullif(count(*) filter (cl = ql),0)::double,6) as recall from r group by 1",
)
def precision_recall_at_k(c):
    lab = c.vectors.select("vec_id", "label")
    ranked = (
        _neighbours(c, 10)
        .join(lab.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q")
        .join(lab.select(F.col("vec_id").alias("c"), F.col("label").alias("cl")), "c")
    )
    sizes = lab.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    totals = lab.join(sizes, "label").select(F.col("vec_id").alias("q"), "relevant")
    out = metrics.precision_recall_at_k(ranked, "q", F.col("ql") == F.col("cl"), totals, 10)
    return rounded(out, "precision", "recall").withColumnRenamed("q", "vec_id")


_SIM = (
    "with p as (select artist, " + ", ".join(f"avg({f}) as {f}" for f in FEATURES) + " from songs group by 1), z as (select artist, "
    + ", ".join(f"({f} - avg({f}) over ()) / stddev_pop({f}) over () as {f}" for f in FEATURES) + " from p), "
    f"r as (select a.artist, b.artist as neighbour, round({_d('a', 'b')},9) as d, row_number() over (partition by a.artist order by round({_d('a', 'b')},9), b.artist) as rank "
    "from z a join z b on a.artist <> b.artist) "
)


def _similar(c, k, metric="euclidean", features=FEATURES):
    prof = c.songs.groupBy("artist").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return profiles.similar_artists(prof, features, k, metric)


@query(
    "known_pair_rank",
    _SIM.rstrip() + ", pairs as (select a.artist, max(b.artist) as neighbour from z a join z b on a.artist <> b.artist group by 1 union "
    "select a.artist, min(b.artist) from z a join z b on a.artist <> b.artist group by 1) "
    "select p.artist, p.neighbour, min(r.rank) filter (r.rank <= 8) as rank from pairs p left join r using (artist, neighbour) group by 1, 2",
)
def known_pair_rank(c):
    names = c.songs.select("artist").distinct()

    def ends(order):
        """The first two names in an order, as one two-element array."""
        two = names.orderBy(order).limit(2)
        return two.agg(F.array_sort(F.collect_list("artist"))).scalar()

    low, high = ends(F.asc("artist")), ends(F.desc("artist"))
    lo = F.when(F.col("artist") == low[0], low[1]).otherwise(low[0])
    hi = F.when(F.col("artist") == high[1], high[0]).otherwise(high[1])
    pairs = names.select("artist", F.explode(F.array(lo, hi)).alias("neighbour")).distinct()
    return metrics.known_pair_rank(pairs, _similar(c, 8), "artist", "neighbour")


@query(
    "model_compare",
    "select split, model, round(accuracy,6) as accuracy, row_number() over (partition by split order by round(accuracy,9) desc, model) as place from "
    "(select split, model, avg(case when truth = pred then 1.0::double else 0.0 end) as accuracy from ballots group by 1, 2)",
)
def model_compare(c):
    out = rounded(metrics.model_comparison(c.ballots), "accuracy")
    return out.withColumn("place", F.col("place").cast("bigint"))


@query(
    "best_model",
    "select split, model, round(accuracy,6) as accuracy from (select split, model, accuracy, row_number() over (partition by split order by accuracy desc, priority) as rn from "
    "(select split, model, priority, avg(case when truth = pred then 1.0::double else 0.0 end) as accuracy from ballots group by 1, 2, 3)) where rn = 1",
)
def best_model(c):
    acc = metrics.accuracy(c.ballots, ["split", "model", "priority"])
    return rounded(metrics.best_model(acc, ["split"]), "accuracy")


@query(
    "vote_hard",
    "select vec_id, pred from (select vec_id, pred, row_number() over (partition by vec_id order by count(*) desc, pred) as rn from ballots group by 1, 2) where rn = 1",
)
def vote_hard(c):
    return metrics.hard_vote(c.ballots, "vec_id")




@query(
    "tempo_genre_corr",
    "with g as (select distinct genre from (select unnest(genres) as genre from songs)) select g.genre, count(*) filter (list_contains(genres, g.genre)) as n, "
    "round(avg(tempo) filter (list_contains(genres, g.genre)),6) as mean_tempo, round(corr(tempo, case when list_contains(genres, g.genre) then 1.0::double else 0.0 end),6) as correlation from g, songs group by 1",
)
def tempo_genre_corr(c):
    return rounded(metrics.tempo_genre_correlation(c.songs), "mean_tempo", "correlation")


def _fscore(f: str) -> str:
    return (
        f"select '{f}' as feature, round((sum(n*(m-g)**2)/(count(*)-1)) / (sum(n*v)/(sum(n)-count(*))),6) as f_score from "
        f"(select genre, count(*) as n, avg({f}) as m, var_pop({f}) as v, (select avg({f}) from songs) as g from songs group by 1)"
    )


@query("feature_f_score", " union all ".join(_fscore(f) for f in FEATURES))
def feature_f_score(c):
    return rounded(metrics.feature_f_scores(c.songs, FEATURES, "genre"), "f_score")


def _estimates(c):
    t = F.col("tempo")
    est = (
        F.when(F.col("song_id") % 6 == 0, t / 2).when(F.col("song_id") % 6 == 1, t * 2).when(F.col("song_id") % 6 == 2, t / 3)
        .when(F.col("song_id") % 6 == 3, t * 1.02).when(F.col("song_id") % 6 == 4, t * 1.3).otherwise(t * 3)
    )
    return c.songs.select("song_id", "genre", "tempo", est.alias("estimate"))


_EST = (
    "est as (select song_id, genre, tempo, case song_id % 6 when 0 then tempo/2 when 1 then tempo*2 when 2 then tempo/3 when 3 then tempo*1.02::double when 4 then tempo*1.3::double else tempo*3 end as estimate from songs), "
    "cls as (select *, case when abs(estimate/tempo - 1) <= 0.04 then 'exact' when abs(estimate/tempo/0.5 - 1) <= 0.04 then 'half' when abs(estimate/tempo/2 - 1) <= 0.04 then 'double' "
    "when abs(estimate/tempo*3 - 1) <= 0.04 then 'third' when abs(estimate/tempo/3 - 1) <= 0.04 then 'triple' else 'other' end as octave from est)"
)


@query("tempo_octave_confusion", f"with {_EST} select genre, octave, count(*) as n from cls group by 1, 2")
def tempo_octave_confusion(c):
    return _estimates(c).groupBy("genre", metrics.octave_class(F.col("estimate"), F.col("tempo")).alias("octave")).agg(F.count("*").alias("n"))


@query(
    "tempo_eval",
    f"with {_EST} select genre, round(avg(case when octave = 'exact' then 1.0::double else 0 end),6) as acc1, round(avg(case when octave <> 'other' then 1.0::double else 0 end),6) as acc2 from cls group by 1",
)
def tempo_eval(c):
    return rounded(metrics.tempo_accuracy(_estimates(c), "genre", "estimate", "tempo"), "acc1", "acc2")


@query(
    "service_metrics",
    "select endpoint, count(*) as n, round(avg(is_error::double),6) as error_rate, round(avg(latency_ms),6) as mean_latency, round(quantile_cont(latency_ms,0.5),6) as p50, "
    "round(quantile_cont(latency_ms,0.95),6) as p95, round(quantile_cont(latency_ms,0.99),6) as p99 from requests group by 1",
)
def service_metrics(c):
    return rounded(metrics.service_metrics(c.requests), "error_rate", "mean_latency", "p50", "p95", "p99")


@query(
    "service_throughput",
    "select cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as bigint) as hour_no, count(*) as n, round(avg(latency_ms),6) as mean_latency from requests group by 1",
)
def service_throughput(c):
    return rounded(metrics.throughput(c.requests), "mean_latency")


# ---- sorts and limits -----------------------------------------------------------------------


@query("top_popular", "select song_id, title, popularity from songs order by popularity desc, song_id limit 10")
def top_popular(c):
    return c.songs.select("song_id", "title", "popularity").orderBy(F.desc("popularity"), "song_id").limit(10)


@query(
    "topk_per_query",
    "select genre, song_id, rank from (select genre, song_id, row_number() over (partition by genre order by popularity desc, song_id) as rank from songs) where rank <= 10",
)
def topk_per_query(c):
    out = ranking.top_k(c.songs.select("genre", "song_id", "popularity"), ["genre"], [F.desc("popularity"), F.col("song_id")], 10)
    return out.select("genre", "song_id", F.col("rank").cast("bigint").alias("rank"))


def _importances(c):
    """Share of each vector position in the total absolute weight, standing in for model importances."""
    long = c.vectors.select(F.posexplode("embedding").alias("idx", "x"))
    per = long.groupBy("idx").agg(F.sum(F.abs(F.col("x").cast("double"))).alias("a"))
    t = per.agg(F.sum("a").alias("t")).scalar()
    return per.select("idx", F.round(F.col("a") / t, 9).alias("importance"))


_IMP = (
    "imp as (select idx, round(a / sum(a) over (),9) as importance from (select cast(idx-1 as int) as idx, sum(abs(cast(x as double))) as a from "
    "(select generate_subscripts(embedding,1) as idx, unnest(embedding) as x from embeddings) group by 1))"
)


@query("top_importances", f"with {_IMP} select idx, importance from imp order by importance desc, idx desc limit 20")
def top_importances(c):
    return _importances(c).orderBy(F.desc("importance"), F.desc("idx")).limit(20)


# Which positions of the 25-wide vector belong to which feature category.
CATEGORIES = {
    "Spectral Centroid": range(0, 4),
    "Spectral Rolloff": range(4, 8),
    "Zero Crossing Rate": range(8, 12),
    "Mel Spectrogram": range(12, 16),
    "MFCC": range(16, 20),
    "Chroma": range(20, 24),
    "Tempo": range(24, 25),
}


@query(
    "importance_by_category",
    f"with {_IMP}, c as (select case " + " ".join(f"when idx between {min(r)} and {max(r)} then '{n}'" for n, r in CATEGORIES.items()) + " else 'Other' end as category, importance from imp) "
    "select category, round(sum(importance),6) as importance, round(sum(importance) / (select sum(importance) from c) * 100,6) as percentage from c group by 1",
)
def importance_by_category(c):
    return rounded(metrics.importance_by_category(_importances(c), CATEGORIES), "importance", "percentage")


# ---- set operations -------------------------------------------------------------------------


@query(
    "intersect_constraints",
    "select song_id from songs where tempo > 120 intersect select song_id from songs where valence > 0.5 except select song_id from songs where release_year between 1970 and 1979",
)
def intersect_constraints(c):
    s = c.songs
    fast, bright = s.where("tempo > 120").select("song_id"), s.where("valence > 0.5").select("song_id")
    old = s.where(F.col("release_year").between(1970, 1979)).select("song_id")
    return fast.intersect(bright).subtract(old)


_RETR = (
    "sqlr as (select artist as query, song_id, row_number() over (partition by artist order by popularity desc, song_id) as rank from songs), "
    "vecr as (select artist as query, song_id, row_number() over (partition by artist order by abs(tempo - 120), song_id) as rank from songs), "
    "grar as (select artist as query, song_id, row_number() over (partition by artist order by coalesce(n,0) desc, song_id) as rank from songs left join (select song_id, count(*) as n from albums group by 1) using (song_id)), "
    "hits as (select query, song_id, rank, 'sql' as source from sqlr where rank <= 20 union all select query, song_id, rank, 'vector' from vecr where rank <= 20 union all select query, song_id, rank, 'graph' from grar where rank <= 20)"
)


def retriever_hits(c):
    """Ranked hits of three retrievers for one query per artist."""
    s = c.songs.select(F.col("artist").alias("query"), "song_id", "popularity", "tempo")
    n = c.albums.groupBy("song_id").agg(F.count("*").alias("n"))
    by_sql = ranking.top_k(s, ["query"], [F.desc("popularity"), F.col("song_id")], 20)
    by_vec = ranking.top_k(s, ["query"], [F.abs(F.col("tempo") - 120), F.col("song_id")], 20)
    g = s.join(n, "song_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_graph = ranking.top_k(g, ["query"], [F.desc("n"), F.col("song_id")], 20)
    parts = [df.select("query", "song_id", F.col("rank").cast("bigint").alias("rank"), F.lit(src).alias("source")) for src, df in (("sql", by_sql), ("vector", by_vec), ("graph", by_graph))]
    return reduce(DataFrame.unionByName, parts)


@query("union_retrievers", f"with {_RETR} select * from hits")
def union_retrievers(c):
    return retriever_hits(c)


@query(
    "dedup_results",
    f"with {_RETR} select query, song_id, max(1.0::double / rank) as score, string_agg(distinct source, ',' order by source) as sources from hits group by 1, 2",
)
def dedup_results(c):
    hits = retriever_hits(c).withColumn("score", F.lit(1.0) / F.col("rank"))
    return ranking.dedup_results(hits, ["query"], "song_id").withColumn("sources", F.array_join("sources", ","))


@query("fuse_rrf", f"with {_RETR} select query, song_id, round(sum(1.0::double / (60 + rank)),6) as score from hits group by 1, 2")
def fuse_rrf(c):
    return rounded(ranking.reciprocal_rank_fusion(retriever_hits(c), ["query"], "song_id"), "score")


# ---- neighbours and profiles ----------------------------------------------------------------


@query("artist_similar", _SIM + "select artist, neighbour, round(d,6) as distance, rank from r where rank <= 5")
def artist_similar(c):
    return rounded(_similar(c, 5), "distance")


@query(
    "request_similar",
    _SIM.split(", r as")[0]
    + ", q as (select event_id, 'Brand#' || (user_id % 25 + 1) as artist, event_id % 20 as k, (user_id % 10) / 10.0::double as we, (event_id % 10) / 10.0::double as wv from events "
    "where event_type in ('view', 'click') and event_id % 20 > 0 and not (user_id % 10 = 0 and event_id % 10 = 0)), "
    "s as (select event_id, k, b.artist as neighbour, round(sqrt(we * (a.energy - b.energy)**2 + wv * (a.valence - b.valence)**2),9) as d from q join z a using (artist) join z b on b.artist <> a.artist) "
    "select event_id, neighbour, round(d,6) as distance, rank from (select *, row_number() over (partition by event_id order by d, neighbour) as rank from s) where rank <= k",
)
def request_similar(c):
    from cadenza.operators import requests as rq

    asked = rq.validate_requests(rq.parse_requests(c.request_docs), types=["view", "click"])
    prof = c.songs.groupBy("artist").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return rounded(rq.run_similarity(asked, standard_scale(prof, FEATURES), FEATURES, "event_id"), "distance")


def _cos_sql(feats, name):
    dot = " + ".join(f"a.{f}*b.{f}" for f in feats)
    na, nb = " + ".join(f"a.{f}**2" for f in feats), " + ".join(f"b.{f}**2" for f in feats)
    d = "sqrt(" + " + ".join(f"(a.{f}-b.{f})**2" for f in feats) + ")"
    cos = f"round(1 - ({dot}) / (sqrt({na}) * sqrt({nb})),9)"
    return (
        f"select '{name}' as features, artist, round(count(*) filter (ce <= 5 and cc <= 5) / (10.0::double - count(*) filter (ce <= 5 and cc <= 5)),6) as overlap from (select a.artist, "
        f"row_number() over (partition by a.artist order by round({d},9), b.artist) as ce, row_number() over (partition by a.artist order by {cos}, b.artist) as cc from z a join z b on a.artist <> b.artist) group by artist"
    )


_SUBSETS = {"all": FEATURES, "rhythm": ["tempo", "danceability"]}


@query(
    "artist_similar_cos",
    _SIM.split(", r as")[0] + " " + " union all ".join(_cos_sql(f, n) for n, f in _SUBSETS.items()),
)
def artist_similar_cos(c):
    out = []
    for name, feats in _SUBSETS.items():
        e = _similar(c, 5, "euclidean", feats).select("artist", "neighbour")
        k = _similar(c, 5, "cosine", feats).select("artist", "neighbour", F.lit(1).alias("hit"))
        both = e.join(k, ["artist", "neighbour"], "left").groupBy("artist").agg(F.count("hit").alias("n"))
        out.append(both.select(F.lit(name).alias("features"), "artist", r6(F.col("n") / (F.lit(10.0) - F.col("n"))).alias("overlap")))
    return reduce(DataFrame.unionByName, out)


@query(
    "artist_filtered",
    "with f as (select * from songs where not list_has_any(genres, ['promo']) and not (release_year between 2010 and 2019)), "
    + _SIM[5:].replace("from songs", "from f")
    + "select artist, neighbour, round(d,6) as distance, rank from r where rank <= 5",
)
def artist_filtered(c):
    from cadenza.operators import filters

    kept = filters.outside_year_ranges(filters.genre_exclude(c.songs, ["promo"]), [(2010, 2019)])
    prof = kept.groupBy("artist").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return rounded(profiles.similar_artists(prof, FEATURES, 5), "distance")


@query(
    "song_to_artist_knn",
    f"with z as {_ZF}, r as (select a.song_id, b.artist, round({_d('a', 'b')},9) as d, row_number() over (partition by a.song_id order by round({_d('a', 'b')},9), b.song_id) as rank "
    "from z a join z b on a.song_id <> b.song_id), v as (select song_id, artist, count(*) as n, round(avg(d),9) as m from r where rank <= 5 group by 1, 2) "
    "select song_id, artist from (select *, row_number() over (partition by song_id order by n desc, m, artist) as rn from v) where rn = 1",
)
def song_to_artist_knn(c):
    return profiles.song_to_artist(c.songs, FEATURES, 5)


_FOLD = "cast(('0x' || substr(md5(vec_id || ':42'),1,7)) as bigint) % 5"


@query(
    "knn_cv",
    f"with e as (select vec_id, label, x as v, {_FOLD} as fold from labelled), r as (select a.vec_id as q, a.label as truth, b.label as vote, "
    "row_number() over (partition by a.vec_id order by round(sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])**2))),9), b.vec_id) as rank from e a join e b on a.fold <> b.fold), "
    "v as (select k, q, truth, vote, count(*) as n from r, (values (1),(3),(5),(9)) t(k) where rank <= k group by 1,2,3,4), "
    "w as (select k, q, truth, vote, row_number() over (partition by k, q order by n desc, vote) as rn from v) "
    "select cast(k as int) as k, round(avg(case when vote = truth then 1.0::double else 0 end),6) as accuracy from w where rn = 1 group by 1",
)
def knn_cv(c):
    v = c.labelled.select("vec_id", "label", F.col("x").alias("v"))
    return rounded(profiles.knn_cross_validation(v, "vec_id", "label", [1, 3, 5, 9]), "accuracy")


@query(
    "knn_classifier",
    f"with e as (select vec_id, label, x as v, {_share('vec_id')} >= 0.8 as test from labelled), r as (select a.vec_id, a.label as truth, b.label as vote, "
    "row_number() over (partition by a.vec_id order by round(sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])**2))),9), b.vec_id) as rank from e a join e b on a.test and not b.test), "
    "v as (select vec_id, truth, vote, row_number() over (partition by vec_id order by count(*) desc, vote) as rn from r where rank <= 7 group by 1,2,3) select vec_id, truth, vote as pred from v where rn = 1",
)
def knn_classifier(c):
    from cadenza.operators.knn import knn

    v = c.labelled
    test, train = v.where(~in_share("vec_id", 0.8)), v.where(in_share("vec_id", 0.8))
    near = knn(test.select(F.col("vec_id").alias("q"), F.col("x").alias("v")), train.select(F.col("vec_id").alias("c"), F.col("x").alias("v")), 7)
    votes = near.join(train.select(F.col("vec_id").alias("c"), F.col("label").alias("pred")), "c")
    return metrics.hard_vote(votes, "q").join(test.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").select(F.col("q").alias("vec_id"), "truth", "pred")
