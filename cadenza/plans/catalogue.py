"""Scans, requests, filters, preparation and scalar functions over the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cadenza.functions import distance, musical, text
from cadenza.operators import filters, prep, requests as rq, validate
from cadenza.plans.registry import query
from cadenza.session import scratch_path
from cadenza.sources import files
from cadenza.sources.catalog import FEATURES


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _share(id_col: str) -> str:
    """The hashed position of an id in [0, 1), in DuckDB spelling."""
    return f"(cast(('0x' || substr(md5({id_col} || ':42'),1,8)) as bigint) / 4294967296.0::double)"


def ids(df: DataFrame) -> DataFrame:
    return df.select("song_id")


# ---- scans, sources, sinks ------------------------------------------------------------------


@query(
    "scan_catalog",
    "select song_id, title, artist, genre, round(tempo,6) as tempo, round(energy,6) as energy, round(valence,6) as valence, "
    "round(danceability,6) as danceability, song_key, song_mode, popularity, release_year from songs",
)
def scan_catalog(c):
    return c.songs.select(
        "song_id", "title", "artist", "genre", *[r6(f).alias(f) for f in FEATURES], "song_key", "song_mode", "popularity", "release_year"
    )


@query("scan_labeled_files", "select lang as label, count(*) as documents from documents where lang is not null group by 1")
def scan_labeled_files(c):
    root = scratch_path(c.spark, "labelled")
    c.table("documents").where("lang is not null").select("doc_id", "lang").withColumn("label", F.col("lang")).write.partitionBy("label").parquet(root)
    found = files.scan_labeled_files(c.spark, root, "*.parquet").select(F.element_at(F.split("label", "="), -1).alias("label")).distinct()
    read = c.spark.read.parquet(root).groupBy("lang").agg(F.count("*").alias("documents"))
    return found.join(read.withColumnRenamed("lang", "label"), "label").select("label", "documents")


@query(
    "label_encode",
    "select song_id, genre, cast(code as int) as code from songs join "
    "(select g, row_number() over (order by g) - 1 as code from (select distinct genre as g from songs)) on g = genre",
)
def label_encode(c):
    return prep.label_encode(c.songs.select("song_id", "genre"), "genre").select("song_id", "genre", "code")


@query(
    "merge_two_sources",
    "select s.song_id, s.title, l.lang, length(l.text) as n_chars, l.song_id is not null as has_lyrics "
    "from songs s left join lyrics l on s.song_id = l.song_id",
)
def merge_two_sources(c):
    lyr = c.lyrics.select("song_id", "lang", F.length("text").cast("bigint").alias("n_chars"), F.lit(True).alias("has_lyrics"))
    return c.songs.join(lyr, "song_id", "left").select(
        "song_id", "title", "lang", "n_chars", F.coalesce("has_lyrics", F.lit(False)).alias("has_lyrics")
    )


@query(
    "batch_ingest",
    "select 'artist' as entity, count(distinct artist) as n_rows from songs union all "
    "select 'genre', count(distinct g) from (select unnest(genres) as g from songs) union all "
    "select 'tag', count(distinct t) from (select unnest(tags) as t from songs) union all "
    "select 'song_genre', count(*) from (select distinct song_id, unnest(genres) as g from songs) union all "
    "select 'song_tag', count(*) from (select distinct song_id, unnest(tags) as t from songs) union all "
    "select 'song', count(*) from songs",
)
def batch_ingest(c):
    written = files.write_entities(prep.normalize_entities(c.songs), scratch_path(c.spark, "ingest"))
    return reduce(
        DataFrame.unionByName,
        [c.spark.read.parquet(p).agg(F.lit(n).alias("entity"), F.count("*").alias("n_rows")) for n, p in written.items()],
    ).select("entity", "n_rows")


@query(
    "normalize_entities",
    "with names as (select distinct 'artist' as kind, lower(artist) as name, song_id from songs union all "
    "select distinct 'genre', lower(unnest(genres)), song_id from songs union all select distinct 'tag', lower(unnest(tags)), song_id from songs), "
    "keyed as (select kind, name, row_number() over (partition by kind order by md5(name), name) - 1 as key from (select distinct kind, name from names)) "
    "select n.kind, n.name, k.key, count(*) as songs from names n join keyed k on n.kind = k.kind and n.name = k.name group by 1, 2, 3",
)
def normalize_entities(c):
    t = prep.normalize_entities(c.songs)
    links = {
        "artist": t["song"].select("song_id", F.col("artist_key").alias("key")),
        "genre": t["song_genre"],
        "tag": t["song_tag"],
    }
    parts = [
        links[k].groupBy("key").agg(F.count("*").alias("songs")).join(t[k], "key").select(F.lit(k).alias("kind"), "name", "key", "songs")
        for k in links
    ]
    return reduce(DataFrame.unionByName, parts)


def _decodable():
    return F.col("explicit").isNotNull() & (F.length("text") > 0)


@query(
    "corrupt_filter",
    "select split, count(*) filter (ok) as kept, count(*) filter (not ok) as rejected from (select "
    f"case when {_share('song_id')} < 0.8 then 'train' else 'test' end as split, explicit is not null and length(text) > 0 as ok from lyrics) group by 1",
)
def corrupt_filter(c):
    split = F.when(prep.in_share("song_id", 0.8), "train").otherwise("test")
    return filters.split_corrupt(c.lyrics.withColumn("split", split), _decodable(), "split")[2]


_REQUEST_TRUTH = (
    "select event_id, event_type <> 'error' as valid_json, case when event_type <> 'error' then event_type end as type, "
    "case when event_type <> 'error' then 'Brand#' || (user_id % 25 + 1) end as artist, "
    "case when event_type <> 'error' then cast(event_id % 20 as int) end as k, "
    "case when event_type <> 'error' then (user_id % 10) / 10.0::double end as energy_w, "
    "case when event_type <> 'error' then (event_id % 10) / 10.0::double end as valence_w, "
    "case when event_type <> 'error' then cast(1960 + user_id % 60 as int) end as year_from from events"
)


@query("parse_query_json", _REQUEST_TRUTH)
def parse_query_json(c):
    p = rq.parse_requests(c.request_docs)
    return p.select(
        "event_id", "valid_json", "type", "artist", "k",
        F.try_element_at("weights", F.lit("energy")).alias("energy_w"),
        F.try_element_at("weights", F.lit("valence")).alias("valence_w"),
        F.try_element_at(F.try_element_at("exclude_years", F.lit(1)), F.lit(1)).alias("year_from"),
    )


@query(
    "validate_query",
    "select event_id, concat_ws(', ', case when event_type = 'error' then 'malformed' end, "
    "case when event_type not in ('error','view','click') then 'unknown type' end, "
    "case when event_type = 'error' or event_id % 20 = 0 then case when event_type <> 'error' then 'k must be positive' end end, "
    "case when event_type <> 'error' and user_id % 10 = 0 and event_id % 10 = 0 then 'weights sum to zero' end) as errors from events",
)
def validate_query(c):
    checked = rq.validate_requests(rq.parse_requests(c.request_docs), types=["view", "click"])
    return checked.select("event_id", F.array_join("errors", ", ").alias("errors"))


@query(
    "parse_constraint_list",
    "select event_id, 'similarity' as type, 'Brand#' || (user_id % 25 + 1) as artist, cast(event_id % 20 as int) as k, "
    "'energy,valence' as features, lower(event_type) as exclude_genre, cast(1945 + user_id % 20 as int) as year_from, "
    "cast(1970 + user_id % 20 as int) as year_to from events",
)
def parse_constraint_list(c):
    doc = F.concat(
        F.lit("type = similarity\n artist = Brand#"), (F.col("user_id") % 25 + 1).cast("string"),
        F.lit("\nk = "), (F.col("event_id") % 20).cast("string"),
        F.lit("\nmatch = energy, valence\nexclude_genre = "), F.initcap("event_type"),
        F.lit("\nexclude_year = "), (F.lit(1945) + F.col("user_id") % 20).cast("string"),
        F.lit("-"), (F.lit(1970) + F.col("user_id") % 20).cast("string"),
    )
    p = rq.parse_constraint_list(c.table("events").select("event_id", doc.alias("doc")), "doc")
    return p.withColumns({"features": F.array_join("features", ","), "exclude_genre": F.array_join("exclude_genre", ",")})


@query(
    "results_to_json",
    "with r as (select artist as request, song_id as id, row_number() over (partition by artist order by popularity desc, song_id) as rank from songs) "
    "select request, '{\"request\":\"' || request || '\",\"results\":[' || string_agg('{\"rank\":' || rank || ',\"id\":' || id || '}', ',' order by rank) || ']}' as doc "
    "from r where rank <= 5 group by request",
)
def results_to_json(c):
    from cadenza.operators.ranking import top_k

    top = top_k(c.songs, ["artist"], [F.col("popularity").desc(), F.col("song_id")], 5)
    return rq.results_to_json(top.withColumnRenamed("artist", "request"), "request", "rank", "song_id")


@query(
    "feature_cache",
    "select vec_id, label < 5 as from_cache, round(list_sum(list_transform(embedding, lambda x: cast(x as double)*cast(x as double))),6) as energy from embeddings",
)
def feature_cache(c):
    def compute(df):
        return df.select("vec_id", distance.dot(F.col("embedding"), F.col("embedding")).alias("energy"))

    path = scratch_path(c.spark, "features")
    compute(c.vectors.where("label < 5")).write.parquet(path)
    known = c.vectors.where("label < 5").select("vec_id", F.lit(True).alias("from_cache"))
    full = files.cached_features(c.vectors, "vec_id", path, compute)
    return full.join(known, "vec_id", "left").select("vec_id", F.coalesce("from_cache", F.lit(False)).alias("from_cache"), r6("energy").alias("energy"))


# ---- projection and predicates --------------------------------------------------------------


@query("prune_features", "select song_id, round(tempo,6) as tempo, round(valence,6) as valence from songs")
def prune_features(c):
    return c.songs.select("song_id", r6("tempo").alias("tempo"), r6("valence").alias("valence"))


@query("songs_by_artist", "select song_id, title from songs where artist = 'Brand#5'")
def songs_by_artist(c):
    return filters.by_artist(c.songs, "Brand#5").select("song_id", "title")


@query("tempo_above", "select song_id from songs where tempo > 120")
def tempo_above(c):
    return ids(filters.tempo_above(c.songs, 120.0))


@query("high_energy_dance", "select song_id from songs where energy >= 0.7 and danceability >= 0.7")
def high_energy_dance(c):
    return ids(filters.high_energy_dance(c.songs))


@query("between_years", "select song_id, release_year from songs where release_year between 1990 and 1999")
def between_years(c):
    return filters.between_years(c.songs, 1990, 1999).select("song_id", "release_year")


@query(
    "exclude_year_ranges",
    "select song_id, release_year from gappy_songs where release_year is null or not (release_year between 1970 and 1979 or release_year between 2010 and 2019)",
)
def exclude_year_ranges(c):
    return filters.outside_year_ranges(c.gappy_songs, [(1970, 1979), (2010, 2019)]).select("song_id", "release_year")


@query("has_tag", "select song_id from songs where list_contains(list_transform(tags, lambda t: lower(t)), 'red')")
def has_tag(c):
    return ids(filters.has_tag(c.songs, "Red"))


@query("genre_include", "select song_id from songs where list_has_any(genres, ['promo','small'])")
def genre_include(c):
    return ids(filters.genre_include(c.songs, ["PROMO", "small"]))


@query("genre_exclude", "select song_id from songs where not list_has_any(genres, ['promo','small'])")
def genre_exclude(c):
    return ids(filters.genre_exclude(c.songs, ["PROMO", "small"]))


@query(
    "include_exclude_terms",
    "select song_id from lyrics where (explicit is null or explicit <> 1) and song_id in (select song_id from tokens where tok = 'the') "
    "and song_id not in (select song_id from tokens where tok = 'with')",
)
def include_exclude_terms(c):
    return ids(filters.include_exclude_terms(c.lyrics, ["the"], ["with", "explicit"], text.tokens("text")))


@query("lyric_word_search", "select distinct song_id from tokens where tok = 'les'")
def lyric_word_search(c):
    return ids(filters.word_search(c.lyrics, ["les"], text.tokens("text")))


@query("minor_upbeat", "select song_id from songs where song_mode = 0 and energy >= 0.6 and valence >= 0.6")
def minor_upbeat(c):
    return ids(filters.minor_upbeat(c.songs))


@query(
    "fuzzy_tempo",
    "select song_id from songs where tempo between 138 and 142 or tempo between 68 and 72 or tempo between 278 and 282",
)
def fuzzy_tempo(c):
    return ids(filters.fuzzy_tempo(c.songs, 140.0, 2.0))


@query(
    "relative_constraint",
    "with sc as (select song_id, tempo, (energy - avg(energy) over ()) / stddev_pop(energy) over () as e, "
    "(valence - avg(valence) over ()) / stddev_pop(valence) over () as v from songs), seed as (select * from sc where song_id = 7) "
    "select s.song_id, round(sqrt(0.5*(s.e-x.e)**2 + 0.5*(s.v-x.v)**2),6) as distance from sc s, seed x where s.tempo < x.tempo and s.song_id <> 7 "
    "order by round(sqrt(0.5*(s.e-x.e)**2 + 0.5*(s.v-x.v)**2),9), s.song_id limit 20",
)
def relative_constraint(c):
    from cadenza.operators.similarity import rank_against_seed

    scaled = prep.standard_scale(c.songs, ["energy", "valence"])
    cands = filters.relative_to_seed(scaled, 7, "tempo", "less")
    return rank_against_seed(scaled, cands, 7, {"energy": 0.5, "valence": 0.5}, 20).select("song_id", "distance")


@query(
    "drop_nonfinite",
    "select vec_id from embeddings where vec_id % 5 <> 0",
)
def drop_nonfinite(c):
    nan = F.array_repeat(F.lit(float("nan")).cast("float"), 1)
    v = c.vectors.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.concat("embedding", nan)).otherwise(F.col("embedding")))
    return filters.finite_vectors(v, "embedding").select("vec_id")


@query(
    "min_length_filter",
    "select song_id, len(string_split(text, ' ')) as n from lyrics where len(string_split(text, ' ')) >= 100",
)
def min_length_filter(c):
    n = F.size(F.split("text", " ")).cast("bigint")
    return filters.long_enough(c.lyrics.select("song_id", n.alias("n")), F.col("n"), 100)




@query(
    "impute_missing",
    "with g as (select song_id, genre, tempo, energy, case when isnan(valence) then null else valence end as valence from gappy_songs) "
    "select song_id, genre, "
    + ", ".join(f"round(coalesce({f}, avg({f}) over (partition by genre), avg({f}) over ()),6) as {f}" for f in ("tempo", "energy", "valence"))
    + " from g",
)
def impute_missing(c):
    cols = ["tempo", "energy", "valence"]
    out = prep.impute_missing(c.gappy_songs.select("song_id", "genre", *cols), cols, "genre")
    return out.select("song_id", "genre", *[r6(x).alias(x) for x in cols])


@query(
    "validation_report",
    "select 'nulls' as \"check\", 'tempo' as column_name, count(*) filter (tempo is null) as n from gappy_songs union all "
    "select 'nulls', 'energy', count(*) filter (energy is null) from gappy_songs union all "
    "select 'nulls', 'valence', count(*) filter (valence is null) from gappy_songs union all "
    "select 'domain', 'tempo', count(*) filter (not (tempo between 30 and 170)) from gappy_songs union all "
    "select 'domain', 'energy', count(*) filter (not (energy between 0 and 1)) from gappy_songs union all "
    "select 'domain', 'valence', count(*) filter (isnan(valence)) from gappy_songs union all "
    "select 'duplicates', 'song_id', count(*) - count(distinct song_id) from gappy_songs",
)
def validation_report(c):
    return validate.validation_report(
        c.gappy_songs,
        "song_id",
        {
            "tempo": F.col("tempo").between(30, 170),
            "energy": F.col("energy").between(0, 1),
            "valence": ~F.isnan("valence") & F.col("valence").between(0, 1),
        },
    )


@query(
    "referential_check",
    " union all ".join(
        f"select '{n}' as relation, cast(count(*) as bigint) as orphan_rows, count(distinct {fk}) as orphan_keys from {a} where {fk} is not null and {fk} not in (select {pk} from {b})"
        for n, a, fk, b, pk in [
            ("album_song", "lineitem", "l_partkey", "part", "p_partkey"),
            ("album_artist", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
            ("listener", "orders", "o_custkey", "customer", "c_custkey"),
            ("song_lyrics", "part", "p_partkey", "documents", "doc_id"),
            ("label_lyrics", "labels", "doc_id", "documents", "doc_id"),
        ]
    ),
)
def referential_check(c):
    return validate.referential_check(
        [
            ("album_song", c.table("lineitem"), "l_partkey", c.table("part"), "p_partkey"),
            ("album_artist", c.table("lineitem"), "l_suppkey", c.table("supplier"), "s_suppkey"),
            ("listener", c.table("orders"), "o_custkey", c.table("customer"), "c_custkey"),
            ("song_lyrics", c.table("part"), "p_partkey", c.table("documents"), "doc_id"),
            ("label_lyrics", c.table("labels"), "doc_id", c.table("documents"), "doc_id"),
        ]
    )


@query(
    "schema_consistency",
    "select 'doc_id' as column_name, 'bigint' as expected, 'bigint' as actual, count(doc_id) as filled, true as consistent from documents union all "
    "select 'text', 'string', 'string', count(text), true from documents union all select 'lang', 'string', 'string', count(lang), true from documents union all "
    "select 'source', null, 'string', count(source), false from documents union all "
    "select 'n_chars', 'int', 'bigint', count(n_chars), false from documents union all select 'license', 'string', null, 0, false",
)
def schema_consistency(c):
    expected = {"doc_id": "bigint", "text": "string", "lang": "string", "n_chars": "int", "license": "string"}
    return validate.schema_consistency(c.spark.read.parquet(f"{c.path}/documents.parquet"), expected)


@query(
    "gold_subset",
    "select song_id, genre, round from (select song_id, genre, row_number() over (partition by genre order by md5(song_id || ':42'), song_id) as round from songs) "
    "order by round, genre limit 50",
)
def gold_subset(c):
    return prep.gold_subset(c.songs.select("song_id", "genre"), "song_id", "genre").select("song_id", "genre", F.col("round").cast("bigint").alias("round"))


# ---- scaling and splitting ------------------------------------------------------------------

_TRAIN = _share("song_id") + " < 0.8"
_Z = "({0} - (select avg({0}) from songs where {_TRAIN})) / (select stddev_pop({0}) from songs where {_TRAIN})".replace("{_TRAIN}", _TRAIN)


@query("standard_scale", "select song_id, " + ", ".join(f"round({_Z.format(f)},6) + 0.0 as {f}" for f in FEATURES) + " from songs")
def standard_scale(c):
    out = prep.standard_scale(c.songs, FEATURES, prep.in_share("song_id", 0.8))
    return out.select("song_id", *[r6(f).alias(f) for f in FEATURES])


_M = "({0} - (select min({0}) from songs where {_TRAIN})) / (select max({0}) - min({0}) from songs where {_TRAIN})".replace("{_TRAIN}", _TRAIN)


@query("minmax_scale", "select song_id, " + ", ".join(f"round({_M.format(f)},6) as {f}" for f in FEATURES) + " from songs")
def minmax_scale(c):
    out = prep.minmax_scale(c.songs, FEATURES, prep.in_share("song_id", 0.8))
    return out.select("song_id", *[r6(f).alias(f) for f in FEATURES])


@query(
    "global_norm",
    "select clip, frame, bin, round((value - (select avg(value) from frames where {t})) / (select stddev_pop(value) from frames where {t}),6) + 0.0 as value from frames".replace(
        "{t}", _share("clip") + " < 0.8"
    ),
)
def global_norm(c):
    out = prep.global_norm(c.frames, "value", prep.in_share("clip", 0.8))
    return out.withColumn("value", r6("value"))


_SPLIT = "case when rn <= floor(0.8*cnt) then 'train' when rn <= floor(0.8*cnt) + floor(0.1*cnt) then 'val' else 'test' end as split"


@query(
    "stratified_split",
    f"select vec_id, label, {_SPLIT} from (select vec_id, label, row_number() over (partition by label order by md5(vec_id || ':42'), vec_id) as rn, "
    "count(*) over (partition by label) as cnt from embeddings)",
)
def stratified_split(c):
    return prep.stratified_split(c.vectors.select("vec_id", "label"), "vec_id", "label")


@query(
    "random_split",
    f"select song_id, {_SPLIT} from (select song_id, row_number() over (order by md5(song_id || ':42'), song_id) as rn, count(*) over () as cnt from songs)",
)
def random_split(c):
    return prep.random_split(c.songs.select("song_id"), "song_id")


@query("shuffle_rows", "select song_id, row_number() over (order by md5(song_id || ':42'), song_id) as position from songs")
def shuffle_rows(c):
    return prep.shuffle_rows(c.songs.select("song_id"), "song_id")


@query(
    "batch_assemble",
    "select song_id, (rn - 1) // 16 as batch, (rn - 1) % 16 as slot from (select song_id, row_number() over (order by md5(song_id || ':42'), song_id) as rn, "
    "count(*) over () as cnt from songs) where (rn - 1) // 16 < cnt // 16",
)
def batch_assemble(c):
    return prep.batch_assemble(c.songs.select("song_id"), "song_id", drop_remainder=True)


@query(
    "steps_per_epoch",
    f"select split, count(*) as n, cast(ceil(count(*) / 16.0) as bigint) as steps from (select {_SPLIT} from (select "
    "row_number() over (partition by label order by md5(vec_id || ':42'), vec_id) as rn, count(*) over (partition by label) as cnt from embeddings)) group by 1",
)
def steps_per_epoch(c):
    return prep.steps_per_epoch(prep.stratified_split(c.vectors.select("vec_id", "label"), "vec_id", "label"), "split")


# ---- scalar functions -----------------------------------------------------------------------


@query(
    "tokenize",
    "select song_id, tok as token, count(*) as n from tokens group by 1, 2",
)
def tokenize(c):
    from cadenza.operators.lyrics import term_frequencies

    return term_frequencies(c.lyrics, "song_id").withColumnsRenamed({"term": "token", "tf": "n"})


@query(
    "clean_lyrics",
    "select song_id, string_agg(tok, ' ' order by pos) as clean from (select song_id, lang, unnest(toks) as tok, generate_subscripts(toks, 1) as pos from "
    "(select song_id, lang, string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}'' ]', ' ', 'g'), ' ') as toks from lyrics)) "
    "where tok <> '' and not ((lang = 'en' and tok in ('the','and','of','to','in','is','on','with','by','for','that','as','it','was','are')) "
    "or (lang = 'fr' and tok in ('le','la','les','de','des','du','un','une','et','en','que','pour','dans')) "
    "or (lang = 'de' and tok in ('der','die','das','und','in','zu','den','mit','von','ist','ein','eine')) "
    "or (lang = 'es' and tok in ('el','la','los','de','que','y','en','un','una','por','con','para'))) group by song_id",
)
def clean_lyrics(c):
    from cadenza.operators.lyrics import clean_lyrics as clean

    return clean(c.lyrics).where(F.col("clean") != "").select("song_id", "clean")


@query(
    "split_multivalue",
    "select song_id, list_sort(list_distinct([lower(genre), lower(tags[1])]))[1] as first_value, "
    "len(list_distinct([lower(genre), lower(tags[1])])) as n from songs",
)
def split_multivalue(c):
    raw = F.concat("genre", F.lit(" , "), F.upper(F.col("tags")[0]), F.lit(", ,"), F.lower("genre"))
    v = text.split_multivalue(raw)
    return c.songs.select("song_id", F.array_min(v).alias("first_value"), F.size(v).cast("bigint").alias("n"))


@query("normalize_name", "select artist_id, lower(name) as name from artists")
def normalize_name(c):
    messy = F.concat(F.lit("  The  "), F.col("name"), F.lit(" "))
    return c.artists.select("artist_id", text.normal_name(messy).alias("name"))


@query(
    "song_text",
    "select song_id, concat_ws(' | ', title, artist, array_to_string(genres, ', '), array_to_string(tags, ', ')) as text from songs",
)
def song_text(c):
    return c.songs.select("song_id", text.song_text(F.col("title"), F.col("artist"), F.col("genres"), F.col("tags")).alias("text"))


@query("release_year", "select cast(year(release_date) as int) as release_year, count(*) as albums from album_info group by 1")
def release_year(c):
    return c.album_info.groupBy(F.year("release_date").alias("release_year")).agg(F.count("*").alias("albums"))


@query(
    "euclid_w",
    "with s as (select * from songs where song_id = 7) select a.song_id, round(sqrt(0.7*(a.tempo-s.tempo)**2 + 0.3*(a.valence-s.valence)**2),6) as distance from songs a, s",
)
def euclid_w(c):
    s = c.songs.where("song_id = 7").select(F.struct("tempo", "valence")).scalar()
    pairs = {f: (F.col(f), s[f]) for f in ("tempo", "valence")}
    return c.songs.select("song_id", r6(distance.weighted_euclid(pairs, {"tempo": 0.7, "valence": 0.3})).alias("distance"))


@query(
    "cosine",
    "with q as (select cast(embedding as double[]) as e from embeddings where vec_id = 0) select vec_id, "
    "round(list_dot_product(cast(embedding as double[]), e) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(e, e))),6) as cosine "
    "from embeddings, q",
)
def cosine(c):
    q = c.vectors.where("vec_id = 0").select("embedding").scalar()
    return c.vectors.withColumn("q", q).select("vec_id", r6(distance.cosine(F.col("embedding"), F.col("q"))).alias("cosine"))


@query(
    "normalize_weights",
    "select event_id, round(case when e + v = 0 then e else e / (e + v) end,6) as energy, round(case when e + v = 0 then v else v / (e + v) end,6) as valence from "
    "(select event_id, (user_id % 10)/10.0::double as e, (event_id % 10)/10.0::double as v from events where event_type <> 'error')",
)
def normalize_weights(c):
    p = rq.parse_requests(c.request_docs).where("valid_json")
    w = distance.normalized_weights(F.col("weights"))
    return p.select("event_id", r6(F.try_element_at(w, F.lit("energy"))).alias("energy"), r6(F.try_element_at(w, F.lit("valence"))).alias("valence"))


@query(
    "one_hot_key",
    "select song_id, cast(least(abs(song_key - 7) % 12, 12 - abs(song_key - 7) % 12) as int) as key_steps, cast(song_mode <> 1 as int) as mode_mismatch, "
    + ", ".join(f"cast(song_key = {k} as int) as key_{k}" for k in range(12))
    + " from songs",
)
def one_hot_key(c):
    s = c.songs.where("song_id = 7").select(F.struct("song_key", "song_mode")).scalar()
    return c.songs.select(
        "song_id",
        distance.key_distance(F.col("song_key"), s["song_key"]).alias("key_steps"),
        (F.col("song_mode") != s["song_mode"]).cast("int").alias("mode_mismatch"),
        *[(F.col("song_key") == k).cast("int").alias(f"key_{k}") for k in range(12)],
    )


@query(
    "tempo_class",
    "select tempo_class, count(*) as songs from (select case when tempo < 60 then 'Largo' when tempo < 76 then 'Adagio' when tempo < 108 then 'Andante' "
    "when tempo < 120 then 'Moderato' when tempo < 156 then 'Allegro' when tempo < 176 then 'Vivace' when tempo is not null then 'Presto' end as tempo_class from gappy_songs) group by 1",
)
def tempo_class(c):
    return c.gappy_songs.groupBy(musical.tempo_class(F.col("tempo")).alias("tempo_class")).agg(F.count("*").alias("songs"))


@query(
    "semantic_tempo",
    "select song_id, case when tempo > 170 then 'High Intensity' when tempo > 140 then 'Energetic' when tempo > 115 then 'Driving' when tempo > 85 then 'Steady' "
    "when tempo is not null then 'Relaxed' end as wording from gappy_songs",
)
def semantic_tempo(c):
    return c.gappy_songs.select("song_id", musical.semantic_tempo(F.col("tempo")).alias("wording"))


@query("workout_check", "select song_id, coalesce(tempo >= 140 and energy >= 0.5, false) as fast_enough from gappy_songs")
def workout_check(c):
    return c.gappy_songs.select("song_id", musical.fast_enough(F.col("tempo"), F.col("energy")).alias("fast_enough"))


_MOOD = "case when valence >= 0.5 and energy >= 0.5 then 'happy' when valence >= 0.5 then 'calm' when energy >= 0.5 then 'angry' else 'sad' end"


@query("mood_label", f"select song_id, {_MOOD} as mood from songs")
def mood_label(c):
    return c.songs.select("song_id", musical.mood(F.col("valence"), F.col("energy")).alias("mood"))


_PROMPT = (
    "select event_id, case event_type when 'click' then 'something upbeat but slower' when 'view' then 'Same vibe, faster!' "
    "when 'purchase' then 'similar songs from this album' when 'signup' then 'top popular songs above 120' else 'hello' end as prompt from events"
)


def prompts(c):
    t = F.col("event_type")
    p = (
        F.when(t == "click", "something upbeat but slower").when(t == "view", "Same vibe, faster!")
        .when(t == "purchase", "similar songs from this album").when(t == "signup", "top popular songs above 120").otherwise("hello")
    )
    return c.table("events").select("event_id", p.alias("prompt"))


@query(
    "vibe_weights",
    "select event_id, feature, round(w,6) as weight, direction from events join (values ('click','valence',1.0/2.5,1),('click','tempo',1.5/2.5,0),"
    "('view','valence',0.5/2.0,0),('view','energy',0.5/2.0,0),('view','tempo',1.0/2.0,1)) v(event_type,feature,w,direction) using (event_type)".replace(
        "round(w,6)", "cast(round(w,6) as double)"
    ),
)
def vibe_weights(c):
    out = rq.vibe_weights(prompts(c), "event_id", text.tokens("prompt"))
    return out.withColumn("weight", r6("weight"))


@query(
    "route_features",
    "select event_id, case event_type when 'purchase' then 'hybrid' when 'signup' then 'sql' else 'hybrid' end as route, "
    "cast(case event_type when 'purchase' then 0.5 when 'signup' then 1.0 else 0.0 end as double) as confidence from events",
)
def route_features(c):
    return rq.route_questions(prompts(c), "event_id", text.tokens("prompt"))

