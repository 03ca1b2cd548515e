"""File sources and sinks: labelled audio folders, entity tables, the feature cache, stored models."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_labeled_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Files below ``root`` labelled by their parent folder. File contents are never read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return listing.select("path", "length").withColumn("label", F.element_at(F.split("path", "/"), -2))


def write_entities(tables: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Write each entity table as parquet below ``path``; returns where each one is."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def cached_features(inputs: DataFrame, id_col: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute features only for ids the cache lacks, append them, and read the whole cache."""
    spark = inputs.sparkSession
    try:
        known = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = inputs
    else:
        todo = inputs.join(known.select(id_col), id_col, "left_anti")
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(inputs.select(id_col), id_col, "left_semi")


def save_model(model, path: str) -> str:
    """Store a fitted pipeline or model; load it with the ``load`` of its own class."""
    model.write().overwrite().save(path)
    return path
