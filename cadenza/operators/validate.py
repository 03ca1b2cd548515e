"""Catalogue validation: content, keys, references and schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def validation_report(df: DataFrame, id_col: str, domains: Mapping[str, Column]) -> DataFrame:
    """Nulls and domain violations per column in one pass, plus rows with a repeated key."""
    flat = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in domains],
        *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(f"domain:{c}") for c, ok in domains.items()],
    )
    long = flat.unpivot([], flat.columns, "name", "n")
    parts = F.split("name", ":")
    checks = long.select(parts[0].alias("check"), parts[1].alias("column_name"), "n")
    dup = df.groupBy(id_col).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("n"))
    return checks.unionByName(dup.select(F.lit("duplicates").alias("check"), F.lit(id_col).alias("column_name"), "n"))


def referential_check(relations: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphan rows of each ``(name, child, fk, parent, pk)`` relationship."""
    out = []
    for name, child, fk, parent, pk in relations:
        # one row per missing key leaves the join, weighted by how often the child repeats it
        keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("_n"))
        orphans = keys.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
        out.append(
            orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys")).select(
                F.lit(name).alias("relation"), "orphan_rows", "orphan_keys"
            )
        )
    return reduce(DataFrame.unionByName, out)


def schema_consistency(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Expected against actual columns, with the number of filled rows of each actual column."""
    actual = dict(df.dtypes)
    absent = [c for c in expected if c not in actual]
    filled = df.agg(*[F.count(c).alias(c) for c in actual], *[F.count(F.lit(None)).alias(c) for c in absent])
    long = filled.unpivot([], filled.columns, "column_name", "filled")

    def lookup(m: Mapping[str, str]) -> Column:
        pairs = [x for k, v in m.items() for x in (F.lit(k), F.lit(v))]
        return F.create_map(*pairs)[F.col("column_name")]

    return long.select("column_name", lookup(expected).alias("expected"), lookup(actual).alias("actual"), "filled").withColumn(
        "consistent", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    )
