"""Vector and hybrid retrieval, quantisation and context building."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.functions.hashing import hash_fraction
from cadenza.operators.graph import connected_components
from cadenza.operators.joins import close_names, masked_names, shifted
from cadenza.operators.knn import block_top_k, knn
from cadenza.operators.ranking import top_k
from cadenza.session import cut_lineage, shuffle_width


def semantic_search(queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, vector: str = "v", where=None) -> DataFrame:
    """Top ``k`` items per query vector by cosine, after the metadata filter."""
    pool = items if where is None else items.where(where)
    near = knn(queries, pool, k, query_id=query_id, candidate_id=item_id, vector=vector, metric="cosine")
    return near.select(query_id, item_id, (1 - F.col("distance")).alias("cosine"), "rank")


def sign_codes(df: DataFrame, id_col: str, vector: str, bits: int, tables: int, seed: int = 42) -> DataFrame:
    """``(id, table, code)``: the signs of ``bits`` random projections per table; the planes come from md5, alike in every engine.

    A plane's numbers depend on the position alone, so they are worked out once per position and not once per component.
    """
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    x = df.select(id_col, F.posexplode(vector).alias("i", "x")).select(id_col, "i", F.col("x").cast("double").alias("x"))
    planes = [[hash_unit(f"{t}:{b}:{{}}:{seed}") for b in range(bits)] for t in range(tables)]
    names = [f"p{t}_{b}" for t in range(tables) for b in range(bits)]
    at = df.sparkSession.range(max(width, 0)).select(F.col("id").cast("int").alias("i"))
    at = at.select("i", *[plane(F.col("i")).alias(n) for n, plane in zip(names, [plane for row in planes for plane in row])])
    x, sums = x.join(F.broadcast(at), "i"), [F.sum(F.col("x") * F.col(n)).alias(n) for n in names]
    per = x.groupBy(id_col).agg(*sums)
    code = lambda t: F.concat(*[F.when(F.round(f"p{t}_{b}", 9) >= 0, "1").otherwise("0") for b in range(bits)])
    return per.select(id_col, F.posexplode(F.array(*[code(t) for t in range(tables)])).alias("table", "code"))


def hash_unit(pattern: str):
    """A function of a position column: a number in [-1, 1) from the md5 of ``pattern`` with the position filled in."""
    head, tail = pattern.split("{}")
    return lambda i: hash_fraction(F.md5(F.concat(F.lit(head), i.cast("string"), F.lit(tail)))) * 2 - 1


def lsh_search(queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, vector: str = "v", bits: int = 4, tables: int = 16, seed: int = 42, block: int = 4096) -> DataFrame:
    """Approximate neighbours: items that share a sign code with the query in some table, then exact distances, no cut-off.

    More rows ask for more ``bits``: their expected number per code is rows / 2 ** bits. Queries and items of one code meet in
    blocks of about ``block`` rows and only k items per query leave a block, so no pair carries vectors through a join. Rows
    with a component that is missing or not finite, of another length, or with an id that was there before are joined pair by pair.
    """
    width = items.select(F.max(F.size(vector))).first()[0] or 0
    sides = []
    for df, name, end in ((queries, query_id, "q"), (items, item_id, "c")):
        copy = F.row_number().over(W.partitionBy(name).orderBy(vector))
        fine = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = df.where(F.col(name).isNotNull() & F.col(vector).isNotNull()).select(F.col(name).alias(end), F.col(vector).alias(f"{end}v"), fine.alias("_fine"), copy.alias("_copy"))
        rows = cut_lineage(rows.select(end, f"{end}v", (F.col("_fine") & (F.col("_copy") == 1)).alias(f"{end}_plain")))
        sides.append((cut_lineage(sign_codes(df, name, vector, bits, tables, seed).withColumnRenamed(name, end)), rows))
    (qc, qs), (cc, cs) = sides
    found = _code_blocks(qc, qs.where("q_plain"), cc, cs.where("c_plain"), k, block)
    odd = [codes.join(rows.where(f"not {end}_plain").select(end).distinct(), end, "left_semi") for codes, rows, end in ((qc, qs, "q"), (cc, cs, "c"))]
    mates = odd[0].join(cc, ["table", "code"]).select("q", "c").unionByName(qc.join(odd[1], ["table", "code"]).select("q", "c")).where("q <> c").distinct()
    met = mates.join(qs, "q").join(cs, "c").where("not (q_plain and c_plain)")
    apart = F.aggregate(F.zip_with(F.col("qv").cast("array<double>"), F.col("cv").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    every = found.unionByName(met.select("q", "c", F.round(F.sqrt(apart), 9).alias("distance")))
    return top_k(every.select(F.col("q").alias(query_id), F.col("c").alias(item_id), "distance"), [query_id], [F.col("distance"), F.col(item_id)], k)


def _code_blocks(qc: DataFrame, qs: DataFrame, cc: DataFrame, cs: DataFrame, k: int, block: int) -> DataFrame:
    """``(q, c, distance)``: at least the ``k`` nearest items of every query among those that share a code with it."""
    left, right = qc.join(qs, "q"), cc.join(cs, "c")
    sizes = [df.groupBy("table", "code").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((qc, "_nq"), (cc, "_nc"))]
    met = cut_lineage(sizes[0].join(sizes[1], ["table", "code"]))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    left = left.join(met, ["table", "code"]).select("table", "code", at("q", "_nq").alias("_qb"), spread("_nc").alias("_cb"), "q", "qv")
    # every column of the other side is a new one, so that the two sides of the cogroup share none
    right = right.join(met, ["table", "code"]).select(F.col("table").alias("_t"), F.col("code").alias("_code"), spread("_nq").alias("_qb2"), at("c", "_nc").alias("_cb2"), "c", "cv")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": [], "c": [], "distance": []})
        q, c = (np.vstack(v).astype(np.float64) for v in (one["qv"], two["cv"]))
        return block_top_k(one["q"].to_numpy(), q, two["c"].to_numpy(), c, None, k, "euclidean", True)[["q", "c", "distance"]]

    schema = f"q {dict(left.dtypes)['q']}, c {dict(right.dtypes)['c']}, distance double"
    return left.groupBy("table", "code", "_qb", "_cb").cogroup(right.groupBy("_t", "_code", "_qb2", "_cb2")).applyInPandas(run, schema).distinct()


def recall_at_k(exact: DataFrame, approximate: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """Share of the exact neighbours that the approximate search also returns."""
    found = exact.join(approximate.select(query_id, item_id, F.lit(1).alias("hit")), [query_id, item_id], "left")
    return found.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row of per-dimension arrays: mean, std, min and max."""
    long = df.select(F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    per = long.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    rows = per.agg(F.array_sort(F.collect_list(F.struct("i", "mean", "std", "min", "max"))).alias("s"))
    return rows.select(*[F.col(f"s.{n}").alias(n) for n in ("mean", "std", "min", "max")])


def quantize(df: DataFrame, id_col: str, vector: str, levels: int = 255) -> DataFrame:
    """Eight-bit codes per dimension range, the reconstruction, and its error per vector."""
    stats = dimension_stats(df, vector).select(F.struct("min", "max")).scalar()
    x = df.withColumns({"_lo": stats["min"], "_hi": stats["max"], "_x": F.col(vector).cast("array<double>")})
    step = F.zip_with("_lo", "_hi", lambda a, b: (b - a) / levels)
    x = x.withColumn("_step", step)
    off = F.zip_with("_x", "_lo", lambda v, a: v - a)
    code = F.zip_with(off, F.col("_step"), lambda d, s: F.when(s == 0, 0).otherwise(F.floor(d / s + 0.5)).cast("int"))
    x = x.withColumn("codes", code)
    back = F.zip_with(F.zip_with("codes", "_step", lambda n, s: n * s), F.col("_lo"), lambda d, a: d + a)
    err = F.transform(F.zip_with(F.col("_x"), back, lambda v, b: v - b), lambda e: F.abs(e))
    x = x.withColumn("_e", err)
    return x.select(id_col, "codes", F.array_max("_e").alias("max_error"), F.aggregate("_e", F.lit(0.0), lambda s, e: s + e * e, lambda s: s / F.size("_e")).alias("mse"))


def near_duplicate_names(names: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct names within ``depth`` edits.

    Names of one length meet with the same places masked, each pair once; only pairs with insertions or deletions are
    sought through deletion variants. The holders of a mask are bounded by the ways to fill ``depth`` places, not by how
    often a name occurs in the data.
    """
    distinct = names.select(F.col(name).alias("a")).distinct()
    return close_names(distinct, distinct.withColumnRenamed("a", "b"), depth).where("a < b")


def resolve_entities(names: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """Canonical (smallest) name for every distinct name.

    All names under one mask are near duplicates of each other, so each is linked to the least of them: the components
    are those of all pairs, but a name has no more links than masks.
    """
    distinct = names.select(F.col(name).alias("a")).distinct()
    masks = masked_names(distinct, "a", depth).where(F.col("t") == F.least(F.lit(depth), F.length("a"))).repartition(shuffle_width(names), "at", "v")
    least = masks.select("a", F.min("a").over(W.partitionBy("at", "v")).alias("b")).where("a <> b").distinct()
    rest = shifted(distinct, distinct.withColumnRenamed("a", "b"), depth).where("a < b").select("a", "b")
    labels = connected_components(least.unionByName(rest), "a", "b")
    distinct = distinct.withColumnRenamed("a", "node")
    return distinct.join(labels, "node", "left").select(F.col("node").alias("name"), F.coalesce("label", "node").alias("canonical"))


def rag_context(hits: DataFrame, docs: DataFrame, query_id: str, doc_id: str, budget: int, text: str = "text") -> DataFrame:
    """Whole passages in rank order, each with its source id, as many as fit the character budget.

    ``hits`` hold at most k rows per query, so a query's window and list are bounded. A query whose first
    passage is longer than the budget keeps its row, with no passage.
    """
    full = hits.join(docs.select(doc_id, text), doc_id)
    order = W.partitionBy(query_id).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    fit = full.withColumn("used", F.sum(F.length(text)).over(order)).withColumn("fits", F.col("used") <= budget)
    piece = F.concat(F.lit("["), F.col(doc_id).cast("string"), F.lit("] "), F.col(text))
    rows = fit.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", piece.alias("p"))))).alias("s"), F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).cast("bigint").alias("used")
    )
    return rows.select(query_id, F.size("s").cast("bigint").alias("passages"), "used", F.array_join(F.transform("s", lambda x: x["p"]), "\n").alias("context"))


def explain_distance(items: DataFrame, seed, weights: Mapping[str, float], id_col: str) -> DataFrame:
    """Each feature's share of the squared distance to the seed, and a confidence ``1 / (1 + d)``."""
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - seed[f]) * (F.col(f) - seed[f])).alias("part")) for f, w in weights.items()]
    total = None
    for f, w in weights.items():
        t = F.lit(float(w)) * (F.col(f) - seed[f]) * (F.col(f) - seed[f])
        total = t if total is None else total + t
    long = items.select(id_col, total.alias("_t"), F.inline(F.array(*parts)))
    return long.select(id_col, "feature", F.coalesce(F.try_divide("part", "_t"), F.lit(0.0)).alias("share"), (1 / (1 + F.sqrt("_t"))).alias("confidence"))
