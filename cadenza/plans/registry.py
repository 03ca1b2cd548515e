"""Registry of runnable queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The views of ``sources.catalog`` in DuckDB spelling, used as CTEs by the oracles.
VIEWS = {
    "songs": "select p_partkey as song_id, p_name as title, p_brand as artist, p_type as genre, "
    "[lower(p_type), split_part(p_name,' ',1)] as genres, string_split(p_name,' ') as tags, "
    "60 + cast(2.4 as double)*p_size as tempo, p_size/cast(50 as double) as energy, "
    "(p_partkey % 100)/cast(100 as double) as valence, (p_partkey*7 % 100)/cast(100 as double) as danceability, "
    "cast(p_partkey % 12 as int) as song_key, cast(p_partkey % 2 as int) as song_mode, p_retailprice as popularity, "
    "cast(1960 + p_partkey % 60 as int) as release_year from part",
    "gappy_songs": "select * replace (case when song_id % 11 <> 0 then tempo end as tempo, "
    "case when song_id % 13 <> 0 then energy end as energy, "
    "case when song_id % 17 = 0 then cast('nan' as double) else valence end as valence, "
    "case when song_id % 19 <> 0 then release_year end as release_year) from songs",
    "albums": "select distinct l_orderkey as album_id, l_partkey as song_id, l_suppkey as credited_artist from lineitem",
    "album_info": "select o_orderkey as album_id, o_orderdate as release_date, o_custkey as publisher_id from orders",
    "artists": "select s_suppkey as artist_id, s_name as name, s_nationkey as nation_id from supplier",
    "plays": "select o_custkey as user_id, l_partkey as song_id, o_orderdate as ts, l_quantity as plays "
    "from orders join lineitem on o_orderkey = l_orderkey",
    "lyrics": "select d.doc_id as song_id, d.text, d.lang, d.source as artist, l.toxic as explicit, l.quality as mood "
    "from documents d left join labels l on d.doc_id = l.doc_id",
    "vectors": "select vec_id, label, embedding from embeddings",
    "labelled": "select vec_id, case when x[1]+x[2] > 0.1 then 2 when x[1]+x[2] > -0.1 then 1 else 0 end as label, x "
    "from (select vec_id, cast(embedding as double[]) as x from embeddings)",
    "samples": "select vec_id as clip, cast(generate_subscripts(embedding,1)-1 as int) as t, "
    "cast(unnest(embedding) as double) as x from embeddings",
    "frames": "select clip, cast(floor(t/8.0) as int) as frame, cast(t % 8 as int) as bin, abs(x) as value from samples",
    "onsets": "select event_type as clip, cast(date_diff('hour', timestamp '2024-01-01 00:00:00', ts) as int) as t, "
    "cast(count(*) as double) as strength from events group by 1,2",
    "beats": "select user_id as clip, row_number() over (partition by user_id order by ts, event_id) as beat_no, ts, value from events",
    "requests": "select event_id, user_id, ts, event_type as endpoint, value as latency_ms, "
    "case when event_type='error' then 1 else 0 end as is_error from events",
    "turns": "select conv_id, turn, role, text from conversations",
    "preds": "select vec_id, label as truth, case when vec_id % 3 = 0 then (label+1) % 10 else label end as pred from embeddings",
    "ballots": "select vec_id, label as truth, case when h < 0.8 then 'train' when h < 0.9 then 'val' else 'test' end as split, "
    "model, priority, case when vec_id % step = 0 then (label + priority + 1) % 10 else label end as pred from (select *, cast(('0x' || substr(md5(vec_id || ':42'),1,8)) as bigint) / 4294967296.0::double as h from embeddings), "
    "(values ('rf',0,5),('gb',1,4),('svm',2,3),('lr',3,4)) m(model,priority,step)",
    "edges": "select distinct 'artist:' || artist as src, 'song:' || song_id as dst, 'PERFORMED' as rel from songs union all "
    "select 'song:' || song_id, 'genre:' || genre, 'HAS_GENRE' from songs union all "
    "select distinct 'song:' || song_id, 'album:' || album_id, 'IN_ALBUM' from albums",
    "hierarchy": "select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all "
    "select 'n' || s_nationkey, 's' || s_suppkey from supplier",
    "tokens": "select song_id, lang, artist, tok from (select song_id, lang, artist, unnest(string_split("
    "regexp_replace(lower(text), '[^\\p{L}\\p{N}'' ]', ' ', 'g'), ' ')) as tok from lyrics) where tok <> ''",
}


def _needed(body: str, found: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    """Views a statement reads, dependencies first."""
    for name, text in VIEWS.items():
        if name not in found and name not in inside and re.search(rf"(from|join|,)\s+{name}\b", body, re.I):
            _needed(text, found, (*inside, name))
            if name not in found:
                found.append(name)
    return found


def with_views(body: str) -> str:
    """Prefix an oracle body with the catalogue views it mentions."""
    body = body.strip()
    ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in _needed(body, []))
    if not ctes:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(catalog) -> DataFrame`` under ``name`` with an optional DuckDB twin."""

    def wrap(fn: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: fn(Catalog(spark, path))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
