"""Exact k-nearest-neighbour joins.

Spark partitions the work; numpy computes distances for one block of queries against one block of
candidates and keeps only k per query, so no pair of rows ever leaves a task. Four exact layouts:

* few candidates (profiles): they travel to every task, queries stay where they are, no shuffle;
* few queries (requests): they travel, every task returns its best k, one small shuffle merges;
* neither side small: candidates are grouped by their nearest pivot. A query meets its own group first; the distance of
  its k-th neighbour there bounds the groups it still has to meet. Groups larger than a block are cut by a hash of the row
  id, so a group of copies is many tasks;
* where the bounds rule out less than half of all pairs, or distances are weighted: block nested loops over a grid of
  bounded hash blocks (Zhang, Li & Jestes, EDBT 2012).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from cadenza.operators.ranking import top_k
from cadenza.session import cut_lineage, shuffle_width, small_table

BOUND = 8192  # rows a side may have to be sent to every task
BYTES = 64 << 20  # and bytes
BLOCK = 4096  # rows a block of a grid has at least
BLOCK_BYTES = 16 << 20  # and bytes at most, beyond that


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0)
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"vectors of unequal length: {int(widths.min())} and {int(widths.max())}")
    return flat.reshape(len(col), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def _distances(q: np.ndarray, c: np.ndarray, w: np.ndarray | None, metric: str, qw: np.ndarray | None = None) -> np.ndarray:
    if metric == "cosine":
        out = _unit(q) @ _unit(c).T
        return np.subtract(1.0, out, out=out)
    out = np.zeros((len(q), len(c)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - c[None, :, j]
        scale = (1.0 if w is None else w[None, :, j]) * (1.0 if qw is None else qw[:, j, None])
        out += scale * d * d
    return np.sqrt(out)


def _reach(d: np.ndarray, k: int, share: int = 16) -> np.ndarray:
    """A distance per row that at least ``k`` of its entries do not pass, close to the k-th least.

    The least entries of groups of ``share`` columns are ranked instead of all entries; groups take every n-th column, since like rows lie side by side.
    """
    groups = d.shape[1] // share
    if groups <= 4 * k:
        at = min(k, d.shape[1]) - 1
        return np.partition(d, at, axis=1)[:, at]
    whole = groups * share
    least = d[:, :whole].reshape(len(d), share, groups).min(1)
    return np.partition(np.hstack([least, d[:, whole:]]), k - 1, axis=1)[:, k - 1]


def _close_pairs(q: np.ndarray, c: np.ndarray, w: np.ndarray | None, qw: np.ndarray | None, k: int, own: np.ndarray):
    """``(query, candidate, distance)`` of every pair that can be among the k nearest of its query, or None to compare all in full.

    Products of matrices give all squared distances up to a rounding error that is bounded per query; only pairs within
    that error of the k-th are computed term by term, as ``_distances`` does. ``own`` is the candidate a query must not meet, or -1.
    """
    if not len(c) or any(x is not None and not (x >= 0).all() for x in (w, qw)):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        left = q if qw is None else qw * q
        right = c if w is None else w * c
        ones = np.ones((1, q.shape[1]))
        mine = (left * q) @ (ones if w is None else w).T
        theirs = (ones if qw is None else qw) @ (right * c).T
        d = left @ right.T
        d *= -2.0
        d += mine
        d += theirs
        error = 4 * np.finfo(float).eps * (q.shape[1] + 8) * (mine.max(1) + theirs.max(1))
    # a pair that is not finite makes its row's sum so
    if not (np.isfinite(error).all() and np.isfinite(d.sum(1)).all()):
        return None
    at = np.flatnonzero(own >= 0)
    d[at, own[at]] = np.inf
    kth = _reach(d, k)
    most = (np.sqrt(np.maximum(kth + error, 0.0)) + 2e-8) ** 2 * (1 + 1e-12) + error
    near = np.flatnonzero(d <= most[:, None])
    near = near[np.isfinite(d.ravel()[near])]
    if len(near) > d.size // 8:
        return None
    qi, ci = np.divmod(near, d.shape[1])
    dist = np.zeros(len(qi))
    for j in range(q.shape[1]):
        gap = q[qi, j] - c[ci, j]
        scale = (1.0 if w is None else w[ci, j]) * (1.0 if qw is None else qw[qi, j])
        dist += scale * gap * gap
    return qi, ci, np.sqrt(dist)


def block_top_k(qid, q, cid, c, w, k, metric, exclude_self, qw=None) -> pd.DataFrame:
    """The k nearest candidates of every query of a block; ties by candidate id."""
    order = np.argsort(cid, kind="stable")
    # rows that are not finite have no distance to any other
    order = order[np.isfinite(c[order]).all(1)]
    cid, c, w = cid[order], c[order], None if w is None else w[order]
    fine = np.isfinite(q).all(1)
    qid, q, qw = qid[fine], q[fine], None if qw is None else qw[fine]
    if not len(c):
        q = q[:0]
    parts, unit = [], _unit(c) if metric == "cosine" else None
    step = max(1, 1_000_000 // max(1, len(c)))
    for s in range(0, len(q), step):
        some, scale = q[s : s + step], None if qw is None else qw[s : s + step]
        at = pd.Index(cid).get_indexer(qid[s : s + step]) if exclude_self else np.full(len(some), -1)
        found = None if metric == "cosine" else _close_pairs(some, c, w, scale, k, at)
        if found is None:
            if metric == "cosine":
                d = _unit(some) @ unit.T
                np.subtract(1.0, d, out=d)
            else:
                d = _distances(some, c, w, metric, scale)
            if np.isnan(d.sum()):
                d[np.isnan(d)] = np.inf
            d[np.flatnonzero(at >= 0), at[at >= 0]] = np.inf
            kth = _reach(d, k)
            near = np.flatnonzero(d <= kth[:, None] + 1e-8)
            near = near[np.isfinite(d.ravel()[near])]
            qi, ci = np.divmod(near, d.shape[1])
            found = qi, ci, d[qi, ci]
        qi, ci, dist = found
        dist = np.round(dist, 9)
        o = np.lexsort((ci, dist, qi))
        qi, ci, dist = qi[o], ci[o], dist[o]
        first = np.searchsorted(qi, qi, side="left")
        rank = np.arange(len(qi)) - first + 1
        keep = rank <= k
        parts.append(pd.DataFrame({"q": qid[s : s + step][qi[keep]], "c": cid[ci[keep]], "distance": dist[keep], "rank": rank[keep]}))
    return pd.concat(parts) if parts else pd.DataFrame({"q": [], "c": [], "distance": [], "rank": []})


def self_knn(df: DataFrame, k: int, *, id_col: str, vector: str = "v", metric: str = "euclidean", bound: int = BOUND) -> DataFrame:
    """``(id, neighbour, distance, rank)``: the k nearest other rows of every row.

    Copies of one vector are one point that lists its k + 1 smallest ids, which is all a neighbour list
    can use; so a group of copies costs one point and its pairs never meet.
    """
    tag = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = top_k(tag, ["v"], [F.col("id")], k + 1, "_r")
    points = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("p", F.col("ids")[0])
    points = cut_lineage(points)
    near = knn(points.select("p", "v"), points.select(F.col("p").alias("c"), "v"), k + 1, query_id="p", metric=metric, bound=bound)
    ids = near.join(points.select(F.col("p").alias("c"), "ids"), "c").select("p", "distance", F.explode("ids").alias("neighbour"))
    lists = top_k(ids, ["p"], [F.col("distance"), F.col("neighbour")], k + 1, "_r").drop("_r")
    member = tag.join(points.select("p", "v"), "v").select("id", "p")
    own = member.join(lists, "p").where(F.col("id") != F.col("neighbour"))
    return top_k(own, ["id"], [F.col("distance"), F.col("neighbour")], k).select(F.col("id").alias(id_col), "neighbour", "distance", "rank")


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _ids(col) -> np.ndarray:
    return np.asarray(col.to_pylist()) if pa.types.is_string(col.type) else col.to_numpy(zero_copy_only=False)


def knn(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    *,
    query_id: str = "q",
    candidate_id: str = "c",
    vector: str = "v",
    weight: str | None = None,
    query_weight: str | None = None,
    metric: str = "euclidean",
    exclude_self: bool = False,
    bound: int = BOUND,
    block: int | None = None,
) -> DataFrame:
    """``(query_id, candidate_id, distance, rank)`` of the k nearest candidates of every query.

    ``weight`` names an array column of the candidates, ``query_weight`` one of the queries, that scales each squared difference.
    Distances carry nine decimals and ties go to the smaller id. ``block`` fixes the rows of a block; without it blocks are as
    large as ``BLOCK_BYTES`` and the number of tasks allow, since every row is sent once per block of the other side.
    """
    extra = [F.col(weight).alias("w")] if weight else []
    qs = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"), *([F.col(query_weight).cast("array<double>").alias("qw")] if query_weight else []))
    cs = candidates.where(F.col(vector).isNotNull()).select(F.col(candidate_id).alias("c"), F.col(vector).cast("array<double>").alias("v"), *extra)
    schema = f"q {_type(qs, 'q')}, c {_type(cs, 'c')}, distance double, rank bigint"
    sc = queries.sparkSession.sparkContext
    arrow = pa.schema([("q", _arrow(qs, "q")), ("c", _arrow(cs, "c")), ("distance", pa.float64()), ("rank", pa.int64())])

    small = _small(cs, bound)
    if small is not None:
        out = _send_candidates(qs, small, sc, k, metric, exclude_self, schema, arrow)
    else:
        small = _small(qs, bound)
        if small is not None:
            partial = _send_queries(cs, small, sc, k, metric, exclude_self, schema, arrow)
        else:
            weighted = "w" in cs.columns or "qw" in qs.columns
            partial = None if weighted else _pivots(qs, cs, k, metric, exclude_self, schema, block or BLOCK)
            if partial is None:
                partial = _grid(qs, cs, k, metric, exclude_self, schema, block)
        out = top_k(partial.drop("rank"), ["q"], [F.col("distance"), F.col("c")], k)
    return out.select(F.col("q").alias(query_id), F.col("c").alias(candidate_id), "distance", "rank")


def _small(df: DataFrame, bound: int) -> pa.Table | None:
    """A side as a local table if it has at most ``bound`` rows and ``BYTES`` bytes, else None."""
    width = df.select(F.max(F.size("v"))).first()[0] or 0
    rows = min(bound, BYTES // (8 * (width + 2)))
    got = df.limit(rows + 1).toArrow()
    return got if got.num_rows <= rows else None


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[_type(df, name)]


def _to_batch(pdf: pd.DataFrame, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)


def _send_candidates(qs, table, sc, k, metric, exclude_self, schema, arrow) -> DataFrame:
    if table.num_rows == 0:
        return qs.where("false").select("q", F.lit(None).cast(StructType.fromDDL(schema)["c"].dataType).alias("c"), F.lit(0.0).alias("distance"), F.lit(1).cast("bigint").alias("rank"))
    w = _matrix(table.column("w")) if "w" in table.column_names else None
    side = sc.broadcast((_ids(table.column("c")), _matrix(table.column("v")), w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, c, w = side.value
        for b in batches:
            if b.num_rows:
                yield _to_batch(block_top_k(_ids(b.column("q")), _matrix(b.column("v")), cid, c, w, k, metric, exclude_self, _matrix(b.column("qw")) if "qw" in b.schema.names else None), arrow)

    return qs.mapInArrow(run, schema)


def _send_queries(cs, table, sc, k, metric, exclude_self, schema, arrow) -> DataFrame:
    side = sc.broadcast((_ids(table.column("q")), _matrix(table.column("v")), _matrix(table.column("qw")) if "qw" in table.column_names else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, qw = side.value
        best = None
        for b in batches:
            if not b.num_rows or not len(qid):
                continue
            w = _matrix(b.column("w")) if "w" in b.schema.names else None
            new = block_top_k(qid, q, _ids(b.column("c")), _matrix(b.column("v")), w, k, metric, exclude_self, qw)
            both = new if best is None else pd.concat([best, new])
            best = both.sort_values(["q", "distance", "c"]).groupby("q", sort=False).head(k)
        if best is not None:
            yield _to_batch(best, arrow)

    return cs.mapInArrow(run, schema)


PIVOTS = 1024  # groups at most


def _finite(df: DataFrame, metric: str) -> DataFrame:
    """Rows that can have a distance at all; for cosine the vectors are scaled to length 1."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    df = df.where(~F.coalesce(F.exists("v", bad), F.lit(False)))
    if metric != "cosine":
        return df
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("_l", length).where("_l > 0").withColumn("v", F.transform("v", lambda x: x / F.col("_l"))).drop("_l")


def _pivots(qs, cs, k, metric, exclude_self, schema, block, pivots: int = PIVOTS) -> DataFrame | None:
    """Best k per query and group met, or None if the bounds rule out less than half of all pairs.

    What goes to every task are the pivots, at most ``BYTES``, and the distances between them.
    """
    spark = qs.sparkSession
    qs, cs = _finite(qs, metric), _finite(cs, metric)
    nq, nc = qs.count(), cs.count()
    width = cs.select(F.max(F.size("v"))).first()[0] or 1
    many = min(pivots, BYTES // (8 * width), max(1, round((nc / max(1, 4 * k)) ** 0.5)))
    chosen = cs.orderBy(F.xxhash64("c"), "c").limit(many).select("v").toArrow()
    if chosen.num_rows < 2:
        return None
    centres = np.unique(_matrix(chosen.column("v")), axis=0)
    side = spark.sparkContext.broadcast(centres)

    def grouped(df: DataFrame, name: str) -> DataFrame:
        out = pa.schema([(name, _arrow(df, name)), ("v", pa.list_(pa.float64())), ("group", pa.int32()), ("far", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b.column("v")), side.value, None, "euclidean")
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column(name), b.column("v"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], schema=out)

        return df.select(name, "v").mapInArrow(run, f"{name} {_type(df, name)}, v array<double>, `group` int, far double")

    q, c = cut_lineage(grouped(qs, "q")), cut_lineage(grouped(cs, "c"))
    size, reach = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
    for r in c.groupBy("group").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        size[r["group"]], reach[r["group"]] = r["n"], r["far"]
    plain = "cosine" if metric == "cosine" else "euclidean"
    own = cut_lineage(top_k(_meet(q.select("q", "v", "group"), c, size, k, plain, exclude_self, schema, block).drop("rank"), ["q"], [F.col("distance"), F.col("c")], k))
    # the k-th distance so far bounds what else a query has to meet
    kth = own.groupBy("q").agg(F.max("distance").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("q", "kth")
    bounded = q.join(kth, "q", "left")
    stats = spark.sparkContext.broadcast((size, reach, _distances(centres, centres, None, "euclidean")))
    want = k + int(exclude_self)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, reach, between = stats.value
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_matrix(b.column("v")), side.value, None, "euclidean")
            mine = b.column("group").to_numpy()
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(float)
            if metric == "cosine":  # of unit vectors: distance^2 / 2
                kth = np.sqrt(2 * (kth + 1e-9))
            # without k neighbours yet: the groups nearest in full that hold so many rows
            for i in np.flatnonzero(np.isnan(kth)):
                whole = np.where(size > 0, d[i] + reach, np.inf)
                order = np.argsort(whole)
                kth[i] = whole[order[min(np.searchsorted(np.cumsum(size[order]), want), len(order) - 1)]]
            # no candidate of a group is nearer than its border, nor than the plane half way to the query's own pivot
            near = d[np.arange(len(d)), mine][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - near**2 - 1e-13 * (d**2 + near**2)) / (2 * between[mine])
            least = np.maximum(d - reach - 1e-12 * (d + reach), np.where(np.isfinite(plane), plane, -np.inf))
            met = (least <= kth[:, None] * (1 + 1e-9) + 1e-8) & (size > 0)
            met[np.arange(len(d)), mine] = False
            at, group = np.nonzero(met)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(d) + 1)), pa.int32()), pa.array(group, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), lists], names=["q", "v", "groups"])

    told = bounded.select("q", "v", "group", "kth").mapInArrow(others, f"q {_type(qs, 'q')}, v array<double>, groups array<int>")
    told = cut_lineage(told)
    visits = np.zeros(len(centres), dtype=np.int64)
    for r in told.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect():
        visits[r["group"]] = r["n"]
    if int((visits * size).sum()) > nq * nc // 2:
        return None
    more = _meet(told.select("q", "v", F.explode("groups").alias("group")), c, size, k, plain, exclude_self, schema, block, visits)
    return own.select("q", "c", "distance", "rank").unionByName(more)


def _meet(q: DataFrame, c: DataFrame, size: np.ndarray, k, metric, exclude_self, schema, block, visits: np.ndarray | None = None) -> DataFrame:
    """Best k per query and block of candidates, for queries and candidates of one group."""
    if visits is None:
        visits = np.zeros(len(size), dtype=np.int64)
        for r in q.groupBy("group").agg(F.count("*").alias("n")).collect():
            visits[r["group"]] = r["n"]
    blocks = lambda n: [int(-(-int(v) // block)) or 1 for v in n]
    table = small_table(q.sparkSession, list(zip(range(len(size)), blocks(visits), blocks(size))), "`group` int, _nq int, _nc int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    left = q.join(table, "group").select("q", "v", "group", at("q", "_nq").alias("_qb"), spread("_nc").alias("_cb"))
    right = c.join(table, "group").select("c", "v", "group", at("c", "_nc").alias("_cb"), spread("_nq").alias("_qb"))
    keys = ["group", "_qb", "_cb"]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": [], "c": [], "distance": [], "rank": []})
        return block_top_k(one["q"].to_numpy(), np.vstack(one["v"]), two["c"].to_numpy(), np.vstack(two["v"]), None, k, metric, exclude_self)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def block_rows(queries: int, candidates: int, width: int, tasks: int) -> int:
    """Rows of a block: what is shuffled falls with them, so as many as fit, but no more than leave two block pairs per task."""
    return max(BLOCK, min(BLOCK_BYTES // (8 * max(1, width)), math.isqrt(queries * candidates // (2 * tasks))))


def _grid(qs, cs, k, metric, exclude_self, schema, block) -> DataFrame:
    many, others = qs.count(), cs.count()
    if block is None:
        block = block_rows(many, others, cs.select(F.max(F.size("v"))).first()[0] or 1, shuffle_width(qs))
    nq, nc = max(1, -(-many // block)), max(1, -(-others // block))

    def part(i: str, n: int):
        return F.pmod(F.xxhash64(i), F.lit(n)).cast("int")

    def spread(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = qs.withColumn("_qb", part("q", nq)).withColumn("_cb", spread(nc))
    c = cs.withColumn("_cb", part("c", nc)).withColumn("_qb", spread(nq))
    weighted = "w" in cs.columns

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "distance": [], "rank": []})
        w = np.vstack(right["w"]) if weighted else None
        return block_top_k(
            left["q"].to_numpy(), np.vstack(left["v"]), right["c"].to_numpy(), np.vstack(right["v"]), w, k, metric, exclude_self, np.vstack(left["qw"]) if "qw" in left else None
        )

    return q.groupBy("_qb", "_cb").cogroup(c.groupBy("_qb", "_cb")).applyInPandas(run, schema)
