"""Approximate vector search that grows with the data: an inverted file of residual product codes.

Vectors fall into cells around centres learned from a bounded sample, more cells for more rows. Inside a cell a vector
is kept as a short code of its offset from the centre. A query visits the cells nearest to it, scores their codes by
table lookup, and only the best few candidates are compared in full. How many cells a query visits is chosen on the
sample, so that the wanted recall is reached whether the data are clustered or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadenza.operators.knn import _arrow, _finite, _matrix, _type
from cadenza.operators.ranking import top_k
from cadenza.session import cut_lineage, small_table

SAMPLE = 65_536  # rows the centres and code books are learned from, at most
CELLS = 4_096  # cells at most
BLOCK = 16_384  # codes of a cell that one task scores together


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row."""
    out = np.zeros(len(x), dtype=np.int64)
    half = 0.5 * (centres * centres).sum(1)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (half - x[at : at + 8192] @ centres.T).argmin(1)
    return out


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Centres of ``k`` means at most; an empty cell keeps its centre."""
    x = np.asarray(x, dtype=float)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


@dataclass
class Coder:
    """Cell centres, and code books for the parts of a vector's offset from its centre."""

    centres: np.ndarray  # cells x dimensions
    books: list[np.ndarray]  # per part: up to 256 x its dimensions
    cuts: list[int]  # where parts begin, and the end

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes (rows x parts, one byte each)."""
        cell = nearest(x, self.centres)
        off = x - self.centres[cell]
        return cell, np.stack([nearest(off[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Per query and part, the squared distance to every code of this cell: queries x parts x 256."""
        off, out = q - self.centres[cell], np.full((len(q), len(self.books), 256), np.inf)
        for p, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out[:, p, : len(book)] = ((off[:, None, a:b] - book[None]) ** 2).sum(2)
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells by distance from each query."""
        return np.argsort(0.5 * (self.centres**2).sum(1) - q @ self.centres.T, axis=1, kind="stable")


@dataclass
class InvertedFile:
    """An index over all rows: ``rows`` holds id, cell, block in the cell, code."""

    coder: Coder
    rows: DataFrame
    blocks: np.ndarray  # blocks of each cell
    visits: int  # cells a query visits
    metric: str


def _sampled(items: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of smallest id hash: the same ones whatever the partitioning."""
    n = items.count()
    if n == 0:
        return np.zeros((0, 0))
    share = min(1.0, 2.0 * most / n)
    low = items.where(F.pmod(F.xxhash64("c"), F.lit(1 << 20)) < F.ceil(F.lit(share * (1 << 20)))) if share < 1 else items
    return _matrix(low.orderBy(F.xxhash64("c"), "c").limit(most).select("v").toArrow().column("v"))


def _visits(coder: Coder, x: np.ndarray, k: int, recall: float) -> int:
    """Least number of cells that hold the wanted share of the sample's own nearest neighbours.

    Neighbours in the whole table are nearer than those in the sample, so they are found at least as often.
    """
    q = x[: min(len(x), 256)]
    d = (x * x).sum(1)[None] - 2 * q @ x.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(coder.centres)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    cell = nearest(x, coder.centres)
    place = np.argsort(coder.order(q), axis=1)  # how soon a query comes to each cell
    soon = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(soon[min(len(soon) - 1, int(np.ceil(recall * len(soon))) - 1)]) + 1


def build_index(items: DataFrame, *, item_id: str, vector: str = "v", metric: str = "euclidean", parts: int = 32, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, cells: int = CELLS, block: int = BLOCK) -> InvertedFile | None:
    """Index every row; None for a table without usable vectors.

    ``recall`` is the share of neighbours whose cells are visited; what the codes lose comes on top. Rows with null or
    non-finite components are left out; vectors of unequal length raise. The centres, at most ``cells`` vectors, go to every task.
    """
    spark = items.sparkSession
    tagged = _finite(items.where(F.col(vector).isNotNull()).select(F.col(item_id).alias("c"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0), metric)
    x = _sampled(tagged, sample)
    if not len(x):
        return None
    many = max(1, min(cells, len(x) // 16, round(tagged.count() ** 0.5)))
    centres = lloyd(x, many)
    width = x.shape[1]
    cuts = [round(i * width / min(parts, width)) for i in range(min(parts, width) + 1)]
    off = x - centres[nearest(x, centres)]
    coder = Coder(centres, [lloyd(off[:, a:b], 256) for a, b in zip(cuts, cuts[1:])], cuts)
    side = spark.sparkContext.broadcast(coder)
    out = pa.schema([("c", _arrow(tagged, "c")), ("cell", pa.int32()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code = side.value.encode(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary())], schema=out)

    coded = cut_lineage(tagged.mapInArrow(run, f"c {_type(tagged, 'c')}, cell int, code binary"))
    blocks = np.ones(len(centres), dtype=np.int64)
    for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect():
        blocks[r["cell"]] = -(-r["n"] // block)
    table = small_table(spark, list(enumerate(blocks.tolist())), "cell int, _n int")
    rows = coded.join(table, "cell").select("c", "cell", F.pmod(F.xxhash64("c"), F.col("_n")).cast("int").alias("block"), "code")
    # stored in order of cells, so that a search for few cells reads few row groups
    rows = cut_lineage(rows.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block"))
    return InvertedFile(coder, rows, blocks, _visits(coder, x, k, recall), metric)


def candidates(index: InvertedFile, queries: DataFrame, *, query_id: str, vector: str = "v", deep: int, visits: int | None = None, together: int = 1024) -> DataFrame:
    """``(q, c, score)``: the ``deep`` rows of best code score per query among the cells it visits."""
    spark, coder = queries.sparkSession, index.coder
    visits = min(visits or index.visits, len(coder.centres))
    qs = _finite(queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")), index.metric)
    side = spark.sparkContext.broadcast(coder)

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = side.value.order(_matrix(b.column("v")))[:, :visits]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), lists], names=["q", "v", "cells"])

    going = qs.mapInArrow(where, f"q {_type(qs, 'q')}, v array<double>, cells array<int>").select("q", "v", F.explode("cells").alias("cell"))
    groups = max(1, -(-qs.count() // together))
    table = small_table(spark, list(enumerate(index.blocks.tolist())), "cell int, _n int")
    part = F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("part")
    left = going.join(table, "cell").select("q", "v", "cell", part, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("block"))
    # codes go to the query parts that visit their cell
    asked = left.select("cell", "block", F.col("part").alias("_to")).distinct()
    right = index.rows.join(asked, ["cell", "block"]).select("c", "cell", "block", F.col("_to").alias("part"), "code")
    keys = ["cell", "block", "part"]

    def run(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        codes = np.frombuffer(b"".join(two["code"]), dtype=np.uint8).reshape(len(two), -1)
        ids, out = two["c"].to_numpy(), []
        for at in range(0, len(one), 32):
            some = one.iloc[at : at + 32]
            tables = side.value.tables(np.vstack(some["v"]), int(key[0]))
            score = sum(tables[:, p, :][:, codes[:, p]] for p in range(codes.shape[1]))
            take = min(deep, score.shape[1])
            best = np.argpartition(score, take - 1, axis=1)[:, :take]
            out.append(pd.DataFrame({"q": np.repeat(some["q"].to_numpy(), take), "c": ids[best.ravel()], "score": np.take_along_axis(score, best, axis=1).ravel()}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"q {_type(qs, 'q')}, c {_type(index.rows, 'c')}, score double")
    return top_k(found, ["q"], [F.col("score"), F.col("c")], deep, "_r").drop("_r")


def search(index: InvertedFile | None, queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, vector: str = "v", deep: int | None = None, visits: int | None = None) -> DataFrame:
    """``(query_id, item_id, distance, rank)``: of the candidates by code the ``k`` nearest in full; a row is not its own neighbour.

    Distances carry nine decimals and ties go to the smaller id.
    """
    kinds = f"{query_id} {_type(queries, query_id)}, {item_id} {_type(items, item_id)}, distance double, rank int"
    if index is None:
        return queries.sparkSession.createDataFrame([], kinds)
    near = candidates(index, queries, query_id=query_id, vector=vector, deep=1 + (deep or max(100, 10 * k)), visits=visits)
    pairs = near.where(F.col("q") != F.col("c")).select(F.col("q").alias(query_id), F.col("c").alias(item_id))
    return rerank(pairs, queries, items, k, query_id=query_id, item_id=item_id, vector=vector, metric=index.metric)


def rerank(pairs: DataFrame, queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, vector: str = "v", metric: str = "euclidean") -> DataFrame:
    """The ``k`` best of the given pairs by full distance."""
    whole = lambda df, i, v: df.select(i, F.col(vector).cast("array<double>").alias(v))
    met = pairs.join(whole(queries, query_id, "_q"), query_id).join(whole(items, item_id, "_c"), item_id)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d)
    if metric == "cosine":
        apart = 1 - dot("_q", "_c") / F.sqrt(dot("_q", "_q") * dot("_c", "_c"))
    else:
        apart = F.sqrt(F.aggregate(F.zip_with("_q", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    return top_k(met.select(query_id, item_id, F.round(apart, 9).alias("distance")), [query_id], [F.col("distance"), F.col(item_id)], k)


def effort(index: InvertedFile, queries: DataFrame, *, query_id: str, vector: str = "v", deep: int) -> DataFrame:
    """One row: codes scored and pairs compared in full, as shares of all pairs."""
    near = candidates(index, queries, query_id=query_id, vector=vector, deep=deep)
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    n, nq = index.rows.count(), queries.count()
    biggest = [r["n"] for r in sizes.orderBy(F.desc("n")).limit(index.visits).collect()]
    compared = near.count()
    return small_table(queries.sparkSession, [(n, nq, index.visits, min(1.0, sum(biggest) / max(1, n)), compared / max(1, n * nq))], "items bigint, queries bigint, cells_visited int, scored_at_most double, compared double")
