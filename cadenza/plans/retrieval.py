"""Similarity, lyrics, vector retrieval and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import musical
from cadenza.operators import graph, inverted_file, lyrics, ranking, retrieval, similarity
from cadenza.operators.prep import standard_scale
from cadenza.plans.analytics import rounded
from cadenza.plans.catalogue import _MOOD
from cadenza.plans.registry import query

# ---- similarity -----------------------------------------------------------------------------

_ZTV = (
    "z as (select *, (tempo - avg(tempo) over ()) / stddev_pop(tempo) over () as zt, (valence - avg(valence) over ()) / stddev_pop(valence) over () as zv from songs), "
    "s as (select zt as st, zv as sv from z where song_id = 7)"
)
_PD = "sqrt(0.7*(zt-st)**2 + 0.3*(zv-sv)**2)"
_WEIGHTS = {"tempo": 0.7, "valence": 0.3}


@query(
    "playlist_topk",
    f"with {_ZTV} select song_id, title, artist, genre, release_year, round({_PD},6) as distance from z, s where song_id <> 7 and not list_has_any(genres, ['economy']) "
    f"and not (release_year between 2010 and 2019) order by round({_PD},9), song_id limit 10",
)
def playlist_topk(c):
    out = similarity.playlist(c.songs, 7, _WEIGHTS, 10, exclude_genres=["ECONOMY"], exclude_years=[(2010, 2019)])
    return out.select("song_id", "title", "artist", "genre", "release_year", "distance")


@query(
    "mood_recommend",
    f"with {_ZTV}, m as (select *, {_MOOD} as mood from z) select song_id, mood, round({_PD},6) as distance from m, s where song_id <> 7 and mood = (select mood from m where song_id = 7) order by round({_PD},9), song_id limit 15",
)
def mood_recommend(c):
    z = standard_scale(c.songs.withColumn("mood", musical.mood(F.col("valence"), F.col("energy"))), list(_WEIGHTS))
    mine = z.where("song_id = 7").select("mood").scalar()
    return similarity.rank_against_seed(z, z.where(F.col("mood") == mine), 7, _WEIGHTS, 15).select("song_id", "mood", "distance")


@query(
    "explain_distance",
    f"with {_ZTV}, p as (select song_id, 0.7*(zt-st)**2 as t, 0.3*(zv-sv)**2 as v from z, s where song_id <> 7) "
    "select song_id, 'tempo' as feature, round(coalesce(t/nullif(t+v,0),0),6) as share, round(1/(1+sqrt(t+v)),6) as confidence from p union all "
    "select song_id, 'valence', round(coalesce(v/nullif(t+v,0),0),6), round(1/(1+sqrt(t+v)),6) from p",
)
def explain_distance(c):
    z = standard_scale(c.songs, list(_WEIGHTS))
    seed = z.where("song_id = 7").select(F.struct("tempo", "valence")).scalar()
    return rounded(retrieval.explain_distance(z.where("song_id <> 7"), seed, _WEIGHTS, "song_id"), "share", "confidence")


# ---- lyrics ---------------------------------------------------------------------------------

_TF = "tf as (select song_id, tok as term, count(*) as tf from tokens group by 1, 2)"
_TFIDF = f"{_TF}, dfs as (select term, ln(((select count(*) from lyrics) + 1) / (count(*) + 1)::double) as idf from tf group by 1), w as (select song_id, term, tf, tf * idf as weight from tf join dfs using (term))"


@query("tfidf", f"with {_TFIDF} select song_id, term, tf, round(weight,6) as weight from w")
def tfidf(c):
    return rounded(lyrics.tfidf(c.lyrics, "song_id"), "weight")


@query(
    "keywords_per_song",
    f"with {_TFIDF} select song_id, term, tf, round(weight,6) as weight, rank from (select *, row_number() over (partition by song_id order by round(weight,9) desc, term) as rank from w) where rank <= 10",
)
def keywords_per_song(c):
    return rounded(lyrics.keywords(c.lyrics, "song_id", 10), "weight").withColumn("rank", F.col("rank").cast("bigint"))


_QTOK = (
    "qt as (select item_id, tok as term, count(*) as tf from (select item_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}'' ]', ' ', 'g'), ' ')) as tok from benchmark) where tok <> '' group by 1, 2)"
)
_KEYWORD = (
    f"{_TFIDF}, {_QTOK}, sc as (select item_id, song_id, round(sum(weight),6) as score from w join qt using (term) group by 1, 2), "
    "hits as (select * from (select *, row_number() over (partition by item_id order by score desc, song_id) as rank from sc where score > 0) where rank <= 10)"
)


def _keyword_hits(c):
    return lyrics.keyword_search(c.lyrics, "song_id", c.table("benchmark"), "item_id", 10)


@query("keyword_search", f"with {_KEYWORD} select item_id, song_id, score, rank from hits")
def keyword_search(c):
    return _keyword_hits(c).select("item_id", "song_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "lyrics_similar",
    f"with {_TFIDF}, {_QTOK}, v as (select item_id, term, tf * idf as weight from qt join dfs using (term)), dn as (select song_id, sqrt(sum(weight*weight)) as n from w group by 1), vn as (select item_id, sqrt(sum(weight*weight)) as n from v group by 1), "
    "sc as (select item_id, song_id, round(d / nullif(dn.n * vn.n, 0),6) as cosine from (select item_id, song_id, sum(w.weight * v.weight) as d from w join v using (term) group by 1, 2) join dn using (song_id) join vn using (item_id)) "
    "select item_id, song_id, cosine, rank from (select *, row_number() over (partition by item_id order by cosine desc, song_id) as rank from sc where cosine > 0) where rank <= 5",
)
def lyrics_similar(c):
    out = lyrics.similar_lyrics(c.lyrics, "song_id", c.table("benchmark"), "item_id", 5)
    return out.select("item_id", "song_id", "cosine", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rag_context",
    f"with {_KEYWORD}, f as (select item_id, song_id, rank, l.text, sum(length(l.text)) over (partition by item_id order by rank) as used from hits join lyrics l using (song_id)) "
    "select item_id, count(*) filter (used <= 20000) as passages, cast(coalesce(max(used) filter (used <= 20000), 0) as bigint) as used, coalesce(string_agg('[' || song_id || '] ' || text, chr(10) order by rank) filter (used <= 20000), '') as context from f group by 1",
)
def rag_context(c):
    return retrieval.rag_context(_keyword_hits(c), c.lyrics, "item_id", "song_id", 20000)


# ---- vectors --------------------------------------------------------------------------------

_ITEMS = "it as (select e.vec_id, cast(e.embedding as double[]) as v, d.lang, l.toxic as explicit from embeddings e join documents d on d.doc_id = e.vec_id left join labels l on l.doc_id = e.vec_id)"


def _items(c):
    meta = c.lyrics.select(F.col("song_id").alias("vec_id"), "lang", "explicit")
    return c.vectors.select("vec_id", F.col("embedding").alias("v")).join(meta, "vec_id")


def _query_vectors(c):
    ids = c.table("benchmark").select(F.col("item_id").alias("vec_id"))
    return c.vectors.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


def _semantic(where: str, k: int) -> str:
    return (
        f"{_ITEMS}, sem as (select * from (select b.item_id, it.vec_id, round(1 - list_cosine_similarity(it.v, cast(q.embedding as double[])),9) as d, "
        f"row_number() over (partition by b.item_id order by round(1 - list_cosine_similarity(it.v, cast(q.embedding as double[])),9), it.vec_id) as rank from benchmark b join embeddings q on q.vec_id = b.item_id, it where {where}) where rank <= {k})"
    )


_CLEAN = "lang = 'en' and coalesce(explicit, 0) <> 1"


@query("semantic_search", f"with {_semantic(_CLEAN, 5)} select item_id, vec_id, round(1 - d,6) as cosine, rank from sem")
def semantic_search(c):
    out = retrieval.semantic_search(_query_vectors(c), _items(c), 5, query_id="item_id", item_id="vec_id", where=_CLEAN)
    return rounded(out, "cosine")


_FOREIGN = "lang in ('fr', 'de')"


@query("multilingual_search", f"with {_semantic(_FOREIGN, 5)} select item_id, vec_id, round(1 - d,6) as cosine, rank from sem")
def multilingual_search(c):
    out = retrieval.semantic_search(_query_vectors(c), _items(c), 5, query_id="item_id", item_id="vec_id", where=_FOREIGN)
    return rounded(out, "cosine")


@query(
    "hybrid_search",
    f"with {_KEYWORD}, {_semantic(_CLEAN, 20)}, u as (select item_id, song_id, rank from hits where song_id in (select vec_id from it where {_CLEAN}) union all select item_id, vec_id, rank from sem) "
    "select item_id, song_id, round(sum(1.0::double/(60+rank)),6) as score from u group by 1, 2",
)
def hybrid_search(c):
    items = _items(c)
    vec = retrieval.semantic_search(_query_vectors(c), items, 20, query_id="item_id", item_id="vec_id", where=_CLEAN)
    allowed = items.where(_CLEAN).select(F.col("vec_id").alias("song_id"))
    kw = _keyword_hits(c).join(allowed, "song_id", "left_semi").select("item_id", "song_id", "rank")
    both = kw.unionByName(vec.select("item_id", F.col("vec_id").alias("song_id"), "rank"))
    return rounded(ranking.reciprocal_rank_fusion(both, ["item_id"], "song_id"), "score")


def _ann(c, k=10):
    v = c.vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return retrieval.lsh_search(_query_vectors(c), v, k, query_id="item_id", item_id="item")


_ANN = (
    "px as (select vec_id, cast(generate_subscripts(embedding,1)-1 as int) as i, cast(unnest(embedding) as double) as x from embeddings), "
    "pl as (select t.range as t, b.range as b, i.range as i, cast(('0x' || substr(md5(t.range || ':' || b.range || ':' || i.range || ':42'),1,8)) as bigint) / 4294967296.0::double * 2 - 1 as w from range(16) t, range(4) b, range(64) i), "
    "cd as (select vec_id, t, string_agg(case when round(s,9) >= 0 then '1' else '0' end, '' order by b) as code from (select vec_id, t, b, sum(x*w) as s from px join pl using (i) group by 1, 2, 3) group by 1, 2), "
    "mt as (select distinct q.vec_id as item_id, c.vec_id as item from cd q join cd c using (t, code) where q.vec_id in (select item_id from benchmark) and q.vec_id <> c.vec_id), "
    "ds as (select item_id, item, round(sqrt(sum((a.x-b.x)**2)),9) as distance from mt join px a on a.vec_id = item_id join px b on b.vec_id = item and b.i = a.i group by 1, 2), "
    "an as (select * from (select *, row_number() over (partition by item_id order by distance, item) as rank from ds) where rank <= 10)"
)


@query("ann_search", f"with {_ANN} select item_id, item, round(distance,6) as distance, rank from an")
def ann_search(c):
    return rounded(_ann(c), "distance").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "ann_recall",
    f"with {_ANN}, ex as (select * from (select item_id, item, row_number() over (partition by item_id order by distance, item) as rank from (select a.vec_id as item_id, b.vec_id as item, round(sqrt(sum((a.x-b.x)**2)),9) as distance "
    "from px a join px b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id in (select item_id from benchmark) group by 1, 2)) where rank <= 10) "
    "select count(*) as wanted, count(an.item) as found, round(count(an.item) / count(*)::double,6) as recall from ex left join an on an.item_id = ex.item_id and an.item = ex.item",
)
def ann_recall(c):
    from cadenza.operators.knn import knn

    v = c.vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    exact = knn(_query_vectors(c), v, 10, query_id="item_id", candidate_id="item", exclude_self=True)
    return rounded(retrieval.recall_at_k(exact, _ann(c), "item_id", "item"), "recall")


def _ivf(c, k=10):
    v = c.vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return inverted_file.search(inverted_file.build_index(v, item_id="item"), _query_vectors(c), v, k, query_id="item_id", item_id="item")


@query("ivf_search")
def ivf_search(c):
    return rounded(_ivf(c), "distance").withColumn("rank", F.col("rank").cast("bigint"))


@query("ivf_recall")
def ivf_recall(c):
    from cadenza.operators.knn import knn

    v = c.vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    exact = knn(_query_vectors(c), v, 10, query_id="item_id", candidate_id="item", exclude_self=True)
    return rounded(retrieval.recall_at_k(exact, _ivf(c), "item_id", "item"), "recall")


@query(
    "quantize_vectors",
    "with x as (select vec_id, generate_subscripts(embedding,1) as i, cast(unnest(embedding) as double) as x from embeddings), r as (select i, min(x) as lo, (max(x)-min(x))/255 as step from x group by 1), "
    "q as (select vec_id, i, x, lo, step, case when step = 0 then 0 else floor((x-lo)/step + 0.5) end as code from x join r using (i)) "
    "select vec_id, cast(sum(code) as bigint) as code_sum, round(max(abs(x - (code*step+lo))),9) as max_error, round(avg((x - (code*step+lo))**2),12) as mse from q group by 1",
)
def quantize_vectors(c):
    out = retrieval.quantize(c.vectors, "vec_id", "embedding")
    total = F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.select("vec_id", total.alias("code_sum"), F.round("max_error", 9).alias("max_error"), F.round("mse", 12).alias("mse"))


_NAMES = "names as (select distinct lower(artist) as name from songs union select distinct lower(n_name) from nation union select distinct lower(s_name) from supplier)"
_PAIRS = f"{_NAMES}, pairs as (select a.name as a, b.name as b, levenshtein(a.name, b.name) as edits from names a join names b on a.name < b.name and levenshtein(a.name, b.name) <= 2)"


def _names(c):
    n = c.songs.select(F.lower("artist").alias("name"))
    n = n.unionByName(c.table("nation").select(F.lower("n_name").alias("name")))
    return n.unionByName(c.artists.select(F.lower("name").alias("name"))).distinct()


@query("entity_resolution", f"with {_PAIRS} select a, b, cast(edits as int) as edits from pairs")
def entity_resolution(c):
    return retrieval.near_duplicate_names(_names(c), "name")


@query(
    "entity_components",
    f"with recursive {_PAIRS}, und as (select a, b from pairs union select b, a from pairs), walk(name, here) as (select name, name from names union select w.name, u.b from walk w join und u on w.here = u.a) "
    "select name, min(here) as canonical from walk group by 1",
)
def entity_components(c):
    return retrieval.resolve_entities(_names(c), "name")


# ---- graph ----------------------------------------------------------------------------------


@query("graph_build", "select src, dst, rel from edges")
def graph_build(c):
    return c.edges


@query("graph_nodes", "select split_part(id, ':', 1) as kind, count(*) as n from (select src as id from edges union select dst from edges) group by 1")
def graph_nodes(c):
    return graph.nodes(c.edges).groupBy("kind").agg(F.count("*").alias("n"))


_UND = "und as (select src, dst, rel from edges union all select dst, src, rel from edges)"


@query(
    "neighbors",
    f"with {_UND}, h1 as (select distinct dst as node from und where src = 'song:7'), h2 as (select distinct dst as node from und where src in (select node from h1)) "
    "select node, cast(min(hops) as int) as hops from (select node, 1 as hops from h1 union all select node, 2 from h2) where node <> 'song:7' group by 1",
)
def neighbors(c):
    return graph.neighbours(c.edges, "song:7", 2)


@query(
    "related_path",
    "with e as (select * from edges where rel = 'IN_ALBUM'), g as (select * from edges where rel = 'HAS_GENRE'), p as (select * from edges where rel = 'PERFORMED') "
    "select 'same album' as pattern, b.src as node, count(*) as paths from e a join e b on a.dst = b.dst where a.src = 'song:7' and b.src <> 'song:7' group by 2 union all "
    "select 'shared genre', d.src, count(*) from p a join g b on a.dst = b.src join g k on b.dst = k.dst join p d on d.dst = k.src where a.src = 'artist:Brand#5' and d.src <> 'artist:Brand#5' group by 2",
)
def related_path(c):
    album = graph.path_counts(c.edges, "song:7", [("IN_ALBUM", "out"), ("IN_ALBUM", "in")])
    genre = graph.path_counts(c.edges, "artist:Brand#5", [("PERFORMED", "out"), ("HAS_GENRE", "out"), ("HAS_GENRE", "in"), ("PERFORMED", "in")])
    return album.select(F.lit("same album").alias("pattern"), "node", "paths").unionByName(genre.select(F.lit("shared genre").alias("pattern"), "node", "paths"))


@query(
    "shortest_path",
    f"with recursive {_UND}, bfs(node, hops) using key (node) as (select 'artist:Brand#5', 0 union select u.dst, b.hops + 1 from bfs b join und u on u.src = b.node where not exists (select 1 from recurring.bfs r where r.node = u.dst)) select node, cast(hops as int) as hops from bfs",
)
def shortest_path(c):
    return graph.shortest_paths(c.edges, "artist:Brand#5")


@query(
    "degree_centrality",
    "with d as (select id, count(*) as degree from (select src as id from edges union all select dst from edges) group by 1) select id, split_part(id, ':', 1) as kind, degree, round(degree / ((select count(*) from d) - 1)::double,9) as centrality from d",
)
def degree_centrality(c):
    return graph.degree_centrality(c.edges).withColumn("centrality", F.round("centrality", 9))


def _pagerank_sql(rounds: int) -> str:
    parts = [
        "ids as (select src as id from edges union select dst from edges)",
        "od as (select src, count(*) as deg from edges group by 1)",
        "r0 as (select id, 1.0::double / (select count(*) from ids) as rank from ids)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} as materialized (select ids.id, 0.15::double / (select count(*) from ids) + 0.85::double * (coalesce(f.s, 0) + (select coalesce(sum(rank), 0) from {p} where id not in (select src from od)) / (select count(*) from ids)) as rank "
            f"from ids left join (select e.dst as id, sum({p}.rank / od.deg) as s from edges e join od on od.src = e.src join {p} on {p}.id = e.src group by 1) f on f.id = ids.id)"
        )
    return "with " + ", ".join(parts) + f" select id, round(rank,12) as rank from r{rounds}"


@query("pagerank", _pagerank_sql(20))
def pagerank(c):
    return graph.pagerank(c.edges, 20).withColumn("rank", F.round("rank", 12))


def _labels_sql(rounds: int) -> str:
    parts = [_UND, "l0 as (select distinct src as id, src as label from und)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"l{i} as (select id, label from (select u.dst as id, l.label, row_number() over (partition by u.dst order by count(*) desc, l.label) as rn from und u join l{i - 1} l on l.id = u.src group by 1, 2) where rn = 1)"
        )
    return "with " + ", ".join(parts) + f" select id, label from l{rounds}"


@query("communities", _labels_sql(5))
def communities(c):
    return graph.communities(c.edges, 5)


@query(
    "graph_recommend",
    "with l as (select distinct user_id, song_id from plays), m as (select song_id from l where user_id = 7), a as (select user_id, count(*) as shared from l where user_id <> 7 and song_id in (select song_id from m) group by 1) "
    "select song_id, cast(sum(shared) as bigint) as score from l join a using (user_id) where song_id not in (select song_id from m) group by 1",
)
def graph_recommend(c):
    return graph.recommend_by_listeners(c.plays, 7)


_SETS = (
    "it as (select distinct credited_artist as id, lower(genre) || '/' || cast(release_year as varchar) as i from albums join songs using (song_id)), "
    "st as (select id, string_agg(i, ',' order by i) as k, count(*) as n from it group by 1), g as (select k, min(id) as rep, count(*) as holders, min(n) as n from st group by 1), "
    "gi as (select g.rep, g.n, g.holders, it.i from g join it on it.id = g.rep)"
)


def _artist_sets(c):
    s = c.songs.select("song_id", F.concat(F.lower("genre"), F.lit("/"), F.col("release_year").cast("string")).alias("i"))
    return c.albums.select("song_id", F.col("credited_artist").alias("id")).join(s, "song_id").select("id", "i").distinct()


@query(
    "artist_jaccard",
    f"with {_SETS}, x as (select a.rep as a, b.rep as b, a.holders as ha, b.holders as hb, count(*) / (a.n + b.n - count(*))::double as j from gi a join gi b on a.i = b.i and a.rep < b.rep group by 1, 2, 3, 4, a.n, b.n) "
    "select a, b, ha as holders_a, hb as holders_b, round(j,6) as jaccard from x where j >= 0.7 union all select rep, rep, holders, holders, 1.0 from g where holders > 1",
)
def artist_jaccard(c):
    return rounded(graph.set_similarity(_artist_sets(c), "id", "i", 0.7), "jaccard")


@query(
    "genre_hierarchy",
    "with recursive t(ancestor, descendant, depth) as (select parent, child, 1 from hierarchy union select t.ancestor, h.child, t.depth + 1 from t join hierarchy h on h.parent = t.descendant) "
    "select ancestor, descendant, cast(min(depth) as int) as depth from t group by 1, 2",
)
def genre_hierarchy(c):
    return graph.hierarchy_closure(c.hierarchy)


_INFL = "infl as (select distinct 'u' || o_custkey as src, 'u' || ((o_custkey * 7 + o_orderkey) % (select count(*) from customer)) as dst from orders)"


@query(
    "influence_reach",
    f"with recursive {_INFL}, t(node, hops) using key (node) as (select 'u7', 0 union select i.dst, t.hops + 1 from t join infl i on i.src = t.node where not exists (select 1 from recurring.t r where r.node = i.dst)) select node, cast(hops as int) as hops from t",
)
def influence_reach(c):
    o, people = c.table("orders"), c.table("customer").agg(F.count("*")).scalar()
    links = o.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("u"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % people).cast("string")).alias("dst"),
    )
    return graph.reach(links, ["u7"])


@query(
    "graph_context",
    f"with {_UND}, h as (select artist as query, 'song:' || song_id as song, row_number() over (partition by artist order by popularity desc, song_id) as rank from songs) "
    "select h.query, h.song, h.rank, u.rel, u.dst as related from h join und u on u.src = h.song where h.rank <= 5",
)
def graph_context(c):
    top = ranking.top_k(c.songs, ["artist"], [F.desc("popularity"), F.col("song_id")], 5)
    hits = top.select(F.col("artist").alias("query"), F.concat(F.lit("song:"), F.col("song_id").cast("string")).alias("song"), F.col("rank").cast("bigint").alias("rank"))
    return graph.context_edges(hits, c.edges, "song")


