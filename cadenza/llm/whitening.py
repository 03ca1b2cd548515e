"""Whitening of vectors with distributed block matrices.

The centred rows are indexed into a ``BlockMatrix``; its transpose times itself is the scatter matrix, whose size is that
of the dimensions alone and whose eigenvectors are found locally. A second product with the whitening matrix projects the
rows. Copies of a vector count once in the fit, however many there are; every row is projected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.session import cut_lineage

_ROWS = 1024  # rows of a block
_COLUMNS = 1024  # columns of a block
_TOGETHER = 16  # block rows that are multiplied in one task


@dataclass
class Whitening:
    """The result of ``fit_whitening``: ``rows`` holds ``rows`` with ``whitened`` array<double> and ``deviation``."""

    rows: DataFrame
    n: int
    means: list[float]
    components: np.ndarray  # one per column, unit length
    eigenvalues: np.ndarray  # of all components, falling
    identity_error: float


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Adds ``x`` array<bigint>: floor(scale * c) + offset of every component; rows without a whole finite vector go."""
    c = F.col(vector).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = df.where(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(F.exists(c, bad), F.lit(False)))
    return usable.withColumn("x", F.transform(c, lambda v: F.floor(v * scale).cast("bigint") + F.lit(offset)))


def indexed(df: DataFrame, index: str) -> DataFrame:
    """The rows as a stored table with gapless numbers from 0: the place in a file after the rows of the files before it.

    The numbers come from the stored files, so a task that runs again after a lost executor gives the same ones, and
    nothing is sorted. Only one row per file passes through a window.
    """
    stored = cut_lineage(df)
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(files.select("_file", before.alias("_before")), "_file").withColumn(index, F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def block_matrix(df: DataFrame, index: str, values: str, rows: int, columns: int) -> BlockMatrix:
    """A block matrix of ``rows`` x ``columns`` from indexed arrays of double; absent rows are rows of zeros."""
    vectors = df.select(F.col(index).cast("bigint").alias("index"), array_to_vector(values).alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(vectors, rows, columns).toBlockMatrix(min(_ROWS, rows), min(_COLUMNS, columns))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix: one row and column per dimension, on the driver.

    The middle of the product is split, so that no task holds more than a few rows of blocks of a tall matrix.
    """
    splits = max(1, math.ceil(matrix.numRows() / matrix.rowsPerBlock / _TOGETHER))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def times(matrix: BlockMatrix, local: np.ndarray) -> DataFrame:
    """The product with a local matrix of as many rows as there are dimensions: ``index`` and ``values`` array<double>."""
    sc, step = matrix._java_matrix_wrapper._sc, matrix.colsPerBlock
    parts = [local[at : at + step] for at in range(0, len(local), step)]
    blocks = [((i, 0), Matrices.dense(*part.shape, part.flatten("F").tolist())) for i, part in enumerate(parts)]
    right = BlockMatrix(sc.parallelize(blocks, 1), step, local.shape[1], *local.shape)
    product = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def identity_error(rows: DataFrame, values: str, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n) of arrays of ``k`` numbers, minus the identity.

    Sums of a task's rows and their products, less a first mean that is 0 but for rounding, leave the task as one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, k)
            n, total, products = n + len(w), total + w.sum(0), products + w.T @ w
        told = [float(n), *total.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([told], pa.list_(pa.float64()))], names=["told"])

    parts = rows.select(values).mapInArrow(run, "told array<double>")
    sums = [r["s"] for r in parts.select(F.posexplode("told").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()]
    n, mean = sums[0], np.array(sums[1 : k + 1]) / sums[0]
    covariance = np.array(sums[k + 1 :]).reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def fit_whitening(df: DataFrame, keys: list[str], components: int = 16) -> Whitening | None:
    """Whiten whole-number vectors ``x``; ``None`` if there are no rows.

    Vectors of another length than the commonest (of equally common, the longest) take no part. Covariances have
    divisor n, the number of different vectors. Centring is exact: n * x - S is a whole number. Components whose
    eigenvalue is 0 but for rounding are left out, since nothing varies along them. ``keys`` are kept as they are, so
    null and repeated ids stay. ``deviation`` is a decimal, exact however large.
    """
    lengths = df.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths["d"]
    rows = indexed(df.where(F.size("x") == d).select(*keys, "x"), "_index")
    # each vector once, under the least index of its copies
    fit = cut_lineage(rows.groupBy("x").agg(F.min("_index").alias("_index")))
    each = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j")
    sums = each.agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("j").collect()
    n, total = sums[0]["n"], [r["s"] for r in sums]
    # squares of this size add up in 64 bits, or need decimals
    small = sum(max(abs(n * r["lo"] - r["s"]), abs(n * r["hi"] - r["s"])) ** 2 for r in sums) < 1 << 63
    off = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in total]), lambda v, s: v * F.lit(n) - s)

    def centred(table: DataFrame) -> DataFrame:
        return table.withColumn("_off", off).withColumn("_c", F.transform("_off", lambda v: v / F.lit(n)))

    height = rows.count()
    spread = scatter(block_matrix(centred(fit), "_index", "_c", height, d)) / n
    values, vectors = np.linalg.eigh((spread + spread.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(components, int((values > values.sum() * d * np.finfo(float).eps).sum()))
    if k == 0:
        return Whitening(rows.limit(0), n, [s / n for s in total], vectors, values, 0.0)

    placed = centred(rows)
    white = cut_lineage(times(block_matrix(placed, "_index", "_c", height, d), vectors[:, :k] / np.sqrt(values[:k])))
    exact = (lambda v: v) if small else (lambda v: v.cast("decimal(38,0)"))
    one = (lambda v: v) if small else (lambda v: v.cast("decimal(19,0)"))
    square = lambda a, v: exact(a + exact(one(v) * one(v)))
    deviation = F.aggregate("_off", exact(F.lit(0).cast("bigint")), square).cast("decimal(38,0)")
    told = placed.select(*keys, "_index", deviation.alias("deviation"))
    white = white.withColumnsRenamed({"index": "_index", "values": "whitened"})
    # one row per vector of the fit list
    seen = white.join(fit.select("_index"), "_index", "left_semi")
    return Whitening(told.join(white, "_index").drop("_index"), n, [s / n for s in total], vectors, values, identity_error(seen, "whitened", k))


def whitening_report(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """A row per row of ``embeddings`` and component: whitened coordinate, share explained, error of the whole.

    Rows whose vector is null, empty, or holds null or non-finite entries have none; nor has a table without usable
    rows or one whose vectors are all equal.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = fit_whitening(whole_numbers(embeddings), ["vec_id"], components)
    if fitted is None or "whitened" not in fitted.rows.columns:
        return embeddings.sparkSession.createDataFrame([], schema)
    shares = [float(v / fitted.eigenvalues.sum()) for v in fitted.eigenvalues]
    rows = fitted.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        F.col("deviation").cast("bigint").alias("deviation"),
        "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("_at") + 1).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )
