"""Top-k, fusion and deduplication of ranked results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts each task's rows to k per key before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def reciprocal_rank_fusion(ranked: DataFrame, keys: Sequence[str], item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """``sum(1 / (k + rank))`` over all result lists an item occurs in."""
    return ranked.groupBy(*keys, item).agg(F.sum(F.lit(1.0) / (F.col(rank) + k)).alias("score"))


def dedup_results(results: DataFrame, keys: Sequence[str], item: str, score: str = "score", source: str = "source") -> DataFrame:
    """One row per item with its best score and the retrievers that found it."""
    return results.groupBy(*keys, item).agg(F.max(score).alias(score), F.array_sort(F.collect_set(source)).alias("sources"))
