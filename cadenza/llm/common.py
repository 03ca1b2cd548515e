"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadenza.session import cut_lineage, sized


def map_columns(df: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable], rows: int = 512) -> DataFrame:
    """Run Python over Arrow batches, ``rows`` rows at a time.

    ``make`` is called once per task and returns a function from the input columns (lists) to the output
    columns (lists). Small steps keep a worker's memory bounded when texts are long.
    """
    out, names = to_arrow_schema(StructType.fromDDL(schema)), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work(*[part.column(i).to_pylist() for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out)], schema=out)

    return df.select(*names).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable], rows: int = 2048) -> DataFrame:
    """Keep whole rows, with all their columns, by a decision on one column.

    ``make`` is called once per task and returns a function from a list of values to a list of booleans.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def hashed_sample(rows: DataFrame, label: str, h: str, each: int) -> DataFrame:
    """At most ``each`` rows per label, those of smallest hash.

    Labels are counted first and only about twice as many rows as wanted, by hash, are ranked, so that no label
    sends all its rows to one task. A label gets fewer only if its hashes are far from evenly spread.
    """
    rows, wide = cut_lineage(rows), 1 << 20
    share = sized(rows.groupBy(label).agg(F.least(F.lit(1.0), F.lit(2.0 * each) / F.count("*")).alias("_share")))
    low = rows.join(share, label).withColumn("_low", F.pmod(F.col(h), F.lit(wide))).where(F.col("_low") < F.ceil(F.col("_share") * wide))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_low", h))
    return low.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank", "_share", "_low")


def per_process(key: str, make: Callable[[], object]):
    """What ``make`` returns, made once in a worker process and kept for its later tasks.

    Workers outlive the stages of a pipeline, so only one operator's tables are held: the next one's push them out.
    """
    store = sys.__dict__.setdefault("_cadenza_llm", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
