"""Lyrics: cleaning, TF-IDF and sparse search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cadenza.functions.text import tokens
from cadenza.operators.ranking import top_k
from cadenza.session import cut_lineage, shuffle_width

# Function words per language that cleaning removes.
STOPWORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "on", "with", "by", "for", "that", "as", "it", "was", "are"],
    "fr": ["le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "pour", "dans"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "ein", "eine"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "por", "con", "para"],
}


def _not_in(words: Sequence[str]):
    return lambda t: ~t.isin(*words)


def clean_lyrics(lyrics: DataFrame, stopwords: dict[str, Sequence[str]] = STOPWORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """Lower case, no punctuation, no stopwords of the song's language; words stay in order."""
    kept = None
    for code, words in stopwords.items():
        test, out = F.col(lang) == code, F.filter("_tok", _not_in(words))
        kept = F.when(test, out) if kept is None else kept.when(test, out)
    return lyrics.withColumn("_tok", tokens(text)).withColumn("clean", F.array_join(kept.otherwise(F.col("_tok")), " ")).drop("_tok")


def term_frequencies(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``(id, term, tf)``: texts are dealt by document and their words counted there, so no word is shuffled."""
    dealt = docs.select(id_col, text).repartition(shuffle_width(docs), id_col)
    return dealt.select(id_col, F.explode(tokens(text)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf_table(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency ``ln((N + 1) / (df + 1))``."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    return document_frequencies(tf).select("term", F.log((n + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def tfidf(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Sparse TF-IDF weights ``(id, term, tf, weight)``."""
    tf = term_frequencies(docs, id_col, text)
    return tf.join(idf_table(tf, docs), "term").select(id_col, "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def keywords(docs: DataFrame, id_col: str, k: int = 10, text: str = "text") -> DataFrame:
    """The ``k`` heaviest terms of every document."""
    w = tfidf(docs, id_col, text).withColumn("_w", F.round("weight", 9))
    return top_k(w, [id_col], [F.col("_w").desc(), F.col("term")], k).drop("_w")


SHORT = 8  # a query of more words can reach its k-th score in so many ways that no posting can be passed over


def by_length(wanted: DataFrame, query_id: str, short: int = SHORT) -> tuple[DataFrame | None, DataFrame | None]:
    """The words of queries with at most ``short`` words, and those of the others; None where there are none."""
    counted = cut_lineage(wanted.withColumn("_words", F.count("*").over(W.partitionBy(query_id))))
    most = counted.agg(F.min("_words").alias("low"), F.max("_words").alias("high")).first()
    few = counted.where(F.col("_words") <= short).drop("_words") if most["low"] is not None and most["low"] <= short else None
    many = counted.where(F.col("_words") > short).drop("_words") if most["high"] is not None and most["high"] > short else None
    return few, many


def keyword_search(docs: DataFrame, doc_id: str, queries: DataFrame, query_id: str, k: int = 10, text: str = "text", short: int = SHORT) -> DataFrame:
    """Top ``k`` documents per query by summed TF-IDF of the query's words.

    For queries of at most ``short`` words only documents that can be among the top ``k`` are scored.
    """
    wanted = queries.select(query_id, F.explode(F.array_distinct(tokens(text))).alias("term"))
    few, many = by_length(wanted, query_id, short)
    index = docs_with_any(docs, doc_id, wanted, text)
    scored = index.limit(0).join(wanted.limit(0), "term").groupBy(query_id, doc_id).agg(F.sum("weight").alias("score"))
    if few is not None:
        index = cut_lineage(index)
        able = promising(index, few.withColumn("_qw", F.lit(1.0)), doc_id, query_id, k)
        scored = score(able, index, few, doc_id, query_id, F.col("weight"))
    if many is not None:
        every = by_document(index, doc_id).join(many, "term").groupBy(query_id, doc_id).agg(F.sum("weight").alias("score"))
        scored = every if few is None else scored.unionByName(every)
    scored = scored.withColumn("score", F.round("score", 6))
    return top_k(scored.where("score > 0"), [query_id], [F.col("score").desc(), F.col(doc_id)], k)


def by_document(index: DataFrame, doc_id: str) -> DataFrame:
    """Postings dealt by document over all tasks of a shuffle.

    Every posting meets each query that asks for its word, so few bytes are much work. A document's scores are summed
    where its postings lie: where the words of the queries are sent to them, no pair of query and document is shuffled.
    """
    return index.repartition(shuffle_width(index), doc_id)


def score(pairs: DataFrame, index: DataFrame, wanted: DataFrame, doc_id: str, query_id: str, value: Column) -> DataFrame:
    """``(query, document, score)`` of the given pairs: ``value`` summed over the words they share."""
    asked = pairs.join(index, doc_id).join(wanted, [query_id, "term"])
    return asked.groupBy(query_id, doc_id).agg(F.sum(value).alias("score"))


def posting_blocks(index: DataFrame, doc_id: str, weight: str = "weight", most: int = 4096) -> DataFrame:
    """``(term, top, docs)``: postings in blocks of like weight, with the largest weight of each block.

    A word of many documents has many blocks: its postings are cut by weight and, beyond ``most`` of one weight, by a
    hash of the document.
    """
    level = F.floor(F.log2(F.col(weight)) * 4)
    sizes = index.where(F.col(weight) > 0).groupBy("term", level.alias("_level")).agg(F.ceil(F.count("*") / most).alias("_parts"))
    cut = index.where(F.col(weight) > 0).withColumn("_level", level).join(sizes, ["term", "_level"])
    part = F.pmod(F.xxhash64(doc_id), F.col("_parts"))
    entry = F.struct(F.col(doc_id).alias("doc"), F.col(weight).alias("w"))
    return cut.groupBy("term", "_level", part.alias("_part")).agg(F.max(weight).alias("top"), F.collect_list(entry).alias("docs")).select("term", "top", "docs")


def promising(index: DataFrame, wanted: DataFrame, doc_id: str, query_id: str, k: int, *, weight: str = "weight", slack: float = 2e-6) -> DataFrame:
    """``(query, document)`` pairs that hold the top ``k`` of every query by the sum of ``weight`` times ``_qw`` (MaxScore).

    The best postings of each word give every query a score that its k-th document reaches at least. The words of a
    query are put in order of the most they can add. A document whose last word in that order is t scores no more than
    what t gives it and the most of the words before t, so where that falls short of the k-th score the posting is
    passed over; words and blocks whose largest weight falls short are never read. No document of the answer is lost:
    its last word passes. ``slack`` covers rounding of scores.
    """
    best = top_k(index.where(F.col(weight) > 0), ["term"], [F.col(weight).desc(), F.col(doc_id)], k, "_r")
    best = cut_lineage(best.select("term", doc_id, weight))
    seeds = best.join(wanted, "term").select(query_id, doc_id).distinct()
    reached = score(seeds, index, wanted, doc_id, query_id, F.col(weight) * F.col("_qw"))
    kth = top_k(reached, [query_id], [F.col("score").desc(), F.col(doc_id)], k).where(F.col("rank") == k).select(query_id, F.col("score").alias("_least"))
    most = best.groupBy("term").agg(F.max(weight).alias("_top"))
    # words in order of the most they can add, and the most of all words before each
    order = W.partitionBy(query_id).orderBy("_most", "term").rowsBetween(W.unboundedPreceding, -1)
    bounded = wanted.join(most, "term").withColumn("_most", F.col("_top") * F.col("_qw")).withColumn("_before", F.coalesce(F.sum("_most").over(order), F.lit(0.0)))
    bounded = bounded.join(kth, query_id, "left").withColumn("_need", (F.coalesce("_least", F.lit(0.0)) - slack - F.col("_before")) / F.col("_qw"))
    asked = bounded.where((F.col("_qw") > 0) & (F.col("_top") >= F.col("_need"))).select(query_id, "term", "_need")
    blocks = posting_blocks(index, doc_id, weight)
    met = asked.join(blocks, "term").where(F.col("top") >= F.col("_need"))
    kept = met.select(query_id, F.explode(F.filter("docs", lambda d: d["w"] >= F.col("_need"))).alias("_d"))
    return kept.select(query_id, F.col("_d.doc").alias(doc_id)).distinct()


def docs_with_any(docs: DataFrame, doc_id: str, wanted: DataFrame, text: str = "text") -> DataFrame:
    """TF-IDF weights of only the terms that some query asks for."""
    words = docs.select(doc_id, F.explode(tokens(text)).alias("term"))
    # only asked words are counted and shuffled; the small table then serves both frequencies and weights
    asked = words.join(wanted.select("term").distinct(), "term", "left_semi").groupBy(doc_id, "term").agg(F.count("*").alias("tf"))
    asked = cut_lineage(asked)
    n = docs.agg(F.count("*").alias("n")).scalar()
    idf = document_frequencies(asked).select("term", F.log((n + 1.0) / (F.col("df") + 1.0)).alias("idf"))
    idf = idf.where("idf > 0")  # a word of every document weighs nothing
    return asked.join(idf, "term").select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def similar_lyrics(docs: DataFrame, doc_id: str, verses: DataFrame, verse_id: str, k: int = 10, text: str = "text", short: int = SHORT) -> DataFrame:
    """Top ``k`` songs per verse by cosine of TF-IDF vectors; the corpus supplies the idf.

    For verses of at most ``short`` different words only songs that can be among the top ``k`` are scored.
    """
    tf = cut_lineage(term_frequencies(docs, doc_id, text))  # read three times below
    idf = idf_table(tf, docs).where("idf > 0")  # a word of every document weighs nothing
    d = tf.join(idf, "term").select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("dw"))
    v = term_frequencies(verses, verse_id, text).join(idf, "term").select(verse_id, "term", (F.col("tf") * F.col("idf")).alias("vw"))
    dn = d.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    vn = v.groupBy(verse_id).agg(F.sqrt(F.sum(F.col("vw") * F.col("vw"))).alias("vn"))
    few, many = by_length(v, verse_id, short)
    dots = None
    if many is not None:
        dots = by_document(d, doc_id).join(many, "term").groupBy(verse_id, doc_id).agg(F.sum(F.col("dw") * F.col("vw")).alias("dot"))
    if few is not None:
        # cosine is the sum of both sides' shares, which is what a word can add at most
        asked = cut_lineage(few.join(vn, verse_id).where("vn > 0").withColumn("_qw", F.col("vw") / F.col("vn")))
        unit = d.join(asked.select("term").distinct(), "term", "left_semi").join(dn, doc_id).where("dn > 0")
        unit = cut_lineage(unit.select(doc_id, "term", "dw", (F.col("dw") / F.col("dn")).alias("weight")))
        able = promising(unit, asked, doc_id, verse_id, k)
        some = score(able, unit, asked, doc_id, verse_id, F.col("dw") * F.col("vw")).withColumnRenamed("score", "dot")
        dots = some if dots is None else dots.unionByName(some)
    if dots is None:
        dots = d.limit(0).join(v.limit(0), "term").groupBy(verse_id, doc_id).agg(F.sum("dw").alias("dot"))
    scored = dots.join(dn, doc_id).join(vn, verse_id)
    scored = scored.select(verse_id, doc_id, F.round(F.try_divide("dot", F.col("dn") * F.col("vn")), 6).alias("cosine"))
    return top_k(scored.where(F.col("cosine") > 0), [verse_id], [F.col("cosine").desc(), F.col(doc_id)], k)
