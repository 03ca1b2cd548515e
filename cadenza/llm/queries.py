"""Queries over the corpus tables, one per operator, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm.bpe import round_trip_digests
from cadenza.llm.byte_bpe import byte_round_trip
from cadenza.llm.fingerprints import edited_report
from cadenza.llm.language import identify_documents
from cadenza.llm.licences import RULES, SENTENCES, default_sentences, rule_patterns, scan_licences
from cadenza.llm.packing import pack_documents
from cadenza.llm.runs import run_report
from cadenza.llm.shards import shard_report
from cadenza.llm.topk import top_k
from cadenza.llm.shingle_join import near_classes
from cadenza.llm.toxicity import grade_documents
from cadenza.llm.urls import judge_urls
from cadenza.llm.whitening import whitening_report
from cadenza.session import small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The default tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _urls_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
split as (select page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(r_host, r_path, verdict) as (values {rules}),
seen as (select host, path, max_by(r_host || r_path, length(r_host || r_path)) as rule, max_by(verdict, length(r_host || r_path)) as verdict
  from (select distinct host, path from split) join rules
  on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by host, path)
select page_id, split.host, split.path, rule, coalesce(verdict, 'allow') as verdict from split left join seen on split.host = seen.host and split.path = seen.path"""


@query("op2_url_filters", _urls_sql())
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = small_table(spark, URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op5_histogram_shards")
def histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"))


@query("op4_winnowed_fingerprints")
def winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(table(spark, sf_dir, "documents"))


def _licences_sql() -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(s)})" for i, s in SENTENCES)
    norm = lambda c: f"trim(regexp_replace(translate({c}, '{up}', '{low}'), '[^a-z0-9]+', ' ', 'g'))"
    # RE2 has no lookahead: ends of sentences are marked with a line break first
    marked = "regexp_replace(regexp_replace(text, '[.!?:;]+([ \t\r\f\v]|\n|$)', '\n', 'g'), ',\\s+(either version)', '\n\\1', 'g')"
    steps, left, names = "", "s0", []
    for i, (name, pattern) in enumerate(rule_patterns(RULES)):
        steps += f", s{i + 1} as (select *, case when contains(left_{i}, '{pattern}') then '{name}' end as r{i}, replace(left_{i}, '{pattern}', '~') as left_{i + 1} from {left})"
        left = f"s{i + 1}"
        names.append(f"r{i}")
    return f"""
with told as (select min(i) as sentence_id, {norm('s')} as sentence from (values {known}) k(i, s) group by 2),
parts as (select doc_id, list_filter(list_transform(string_split({marked}, chr(10)), lambda x: {norm('x')}), lambda x: x <> '') as p from documents),
spread as (select doc_id, unnest(p) as sentence, generate_subscripts(p, 1) as place from parts),
found as (select doc_id, place, sentence_id, lag(place) over (partition by doc_id order by place) as prev from spread join told using (sentence)),
s0 as (select doc_id, count(*) as n_sentences, string_agg(case when place > prev + 1 then '~' else '' end || '<' || sentence_id || '>', '' order by place) as sentence_ids,
  sentence_ids as left_0 from found group by doc_id){steps}
select doc_id, n_sentences, sentence_ids, nullif(array_to_string(list_sort(list_distinct(list_filter([{', '.join(names)}], lambda x: x is not null))), ' '), '') as licences from {left}"""


@query("op7_licence_rules", _licences_sql())
def licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), default_sentences(spark), RULES)


@query("op1_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op3_bit_sliced_top_k",
    """
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint)) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
p as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id and len(q.x) = len(v.x)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10""",
)
def bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@query("op8_shingle_join")
def shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


@query("op12_byte_bpe_round_trip")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))
