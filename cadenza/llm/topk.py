"""Exact top-k inner products on a bit-sliced index.

The index is one row per block: the ids of its vectors and, for every attribute, one bitmap per bit of the quantised
value. A query's scores for a whole block come from adding those bitmaps, weighed by the bits of the query, with
carry-save adders. The best rows are then picked from the most significant slice of the sum downward; rows that are equal in all
slices at the boundary are settled by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.session import cut_lineage


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, x array<bigint>``: floor(scale * component). Rows with a null id, a null vector or a null or non-finite component take no part."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    ok = df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(whole, F.lit(False)))
    return ok.select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Booleans (n, rows) to bitmaps of 64-bit words (n, words); bit r of a bitmap is row r."""
    pad = -flags.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(flags, ((0, 0), (0, pad))), axis=1, bitorder="little")).view(np.uint64)


def slice_block(x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Bitmaps (attributes, bits, words) of ``x`` (rows, attributes) less each attribute's least value, the bits, and those least values."""
    low = x.min(axis=0)
    rest = (x - low).astype(np.uint64)
    bits = max(1, int(rest.max()).bit_length())
    planes = [pack_bits(((rest >> np.uint64(b)) & np.uint64(1)).astype(bool).T) for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes, axis=1)), bits, low


def add_slices(planes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of sum over attributes of |weight| * value.

    ``planes`` is (attributes, bits, words). Bitmaps of one significance are added three at a time into a sum and a
    carry until one is left.
    """
    piles: dict[int, list[np.ndarray]] = {}
    for b in range(int(np.abs(weights).max()).bit_length()):
        own = planes[(np.abs(weights) >> b) & 1 == 1]
        for p in range(planes.shape[1]):
            if len(own):
                piles.setdefault(b + p, []).append(own[:, p])
    out, at = [], 0
    none = np.zeros(planes.shape[2], dtype=np.uint64)
    while piles:
        pile = piles.pop(at, None)
        if pile is None:
            out.append(none)
            at += 1
            continue
        maps = np.concatenate(pile)
        carries = []
        while len(maps) > 1:
            n = len(maps) // 3
            if n:
                a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
                half = a ^ b
                carries.append(a & b | half & c)
                maps = np.concatenate([half ^ c, maps[3 * n :]])
            else:
                carries.append(maps[:1] & maps[1:2])
                maps = maps[:1] ^ maps[1:2]
        if carries:
            piles.setdefault(at + 1, []).extend(carries)
        out.append(maps[0])
        at += 1
    return out or [none]


def select_top(slices: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of all rows that are among the k greatest, boundary rows included: from the top slice downward."""
    sure, tied = np.zeros_like(alive), alive.copy()
    for plane in reversed(slices):
        ahead = tied & plane
        both = sure | ahead
        n = int(np.bitwise_count(both).sum())
        if n > k:
            tied = ahead
        else:
            sure, tied = both, tied & ~plane
            if n == k:
                tied = np.zeros_like(tied)
                break
    return np.flatnonzero(np.unpackbits((sure | tied).view(np.uint8), bitorder="little"))


def value_at(slices: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The sums of some rows, read from the slices."""
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    total = np.zeros(len(rows), dtype=np.int64)
    for p, plane in enumerate(slices):
        total += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << p
    return total


def build_index(vectors: DataFrame, block_rows: int) -> DataFrame:
    """One row per block: ``dim, block, ids, low, bits, planes`` (binary). Blocks are hashed from the ids, for equal fill."""
    sizes = vectors.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    blocks = sizes.select("dim", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks"))
    dealt = vectors.withColumn("dim", F.size("x")).join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.array(pdf["x"].tolist(), dtype=np.int64)
        planes, bits, low = slice_block(x)
        return pd.DataFrame({"dim": [x.shape[1]], "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()], "bits": [bits], "planes": [planes.tobytes()]})

    return dealt.select("dim", "block", "id", "x").groupBy("dim", "block").applyInPandas(build, "dim int, block int, ids binary, low binary, bits int, planes binary")


def query_blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    """Queries in blocks: ``dim, asked, q_ids, q`` (binary)."""
    part = F.pmod(F.xxhash64("id", F.lit(1)), queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows))).scalar()).cast("int")
    dealt = queries.select(F.size("x").alias("dim"), part.alias("asked"), "id", "x")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "asked": [pdf["asked"].iloc[0]], "q_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "q": [np.array(pdf["x"].tolist(), dtype=np.int64).tobytes()]})

    return dealt.groupBy("dim", "asked").applyInPandas(build, "dim int, asked int, q_ids binary, q binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = 8192, query_rows: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k greatest integer inner products, ties to the smaller id.

    Every row of ``vectors`` but those with the query's own id is a candidate; vectors meet only those of equal length.
    Fewer candidates give fewer rows; repeated rows are repeated candidates. Scores must fit 63 bits.
    """
    index = cut_lineage(build_index(quantised(vectors, key, vector, scale), block_rows))
    asked = query_blocks(quantised(queries, key, vector, scale), query_rows)
    # each query block goes to each index block of its length: a stated query set against all rows, in blocks
    targets = index.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    sent = asked.join(targets, "dim").select("dim", "asked", "q_ids", "q", F.explode("blocks").alias("block"))
    met = index.join(sent, ["dim", "block"]).select("dim", "ids", "low", "bits", "planes", "q_ids", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, low, bits, planes, q_ids, q = (batch.column(c)[i].as_py() for c in range(7))
                ids, low = np.frombuffer(ids, dtype=np.int64), np.frombuffer(low, dtype=np.int64)
                planes = np.frombuffer(planes, dtype=np.uint64).reshape(dim, bits, -1)
                alive = pack_bits(np.ones((1, len(ids)), dtype=bool))[0]
                out = []
                for query, weights in zip(np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(q, dtype=np.int64).reshape(-1, dim)):
                    # a negative weight takes the complement of its attribute, so that all summands are positive
                    used = np.where((weights < 0)[:, None, None], ~planes, planes)
                    flipped = np.where(weights < 0, (1 << bits) - 1, 0)
                    base = int((weights * low).sum() + (weights * flipped).sum())
                    slices = add_slices(used, weights)
                    own = np.flatnonzero(ids == query)
                    left = alive.copy()
                    for r in own:
                        left[r >> 6] &= ~np.uint64(1 << (int(r) & 63))
                    rows = select_top(slices, left, k)
                    score = value_at(slices, rows) + base
                    best = np.lexsort((ids[rows], -score))[:k]
                    out += [(int(query), int(ids[rows[b]]), int(score[b])) for b in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
