"""Session settings and durable scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cadenza")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The durable folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster a machine-local folder dies with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="cadenza-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter table (basis, lexicon, start nodes) whose size Spark knows.

    A DataFrame built from Python rows has no known size, so joining it would first shuffle the big
    side. One built from Arrow is a local relation, which Spark broadcasts by its own size limit.
    """
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrow = to_arrow_schema(fields)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=fields)


def sized(df: DataFrame, bound: int = 10_000) -> DataFrame:
    """A category table as a local relation if it has at most ``bound`` rows, else unchanged.

    Spark estimates an aggregate as large as its input, so it would shuffle the big side of the join by
    category before it learns better. The row count is checked first; beyond it the shuffle join stays.
    """
    got = df.limit(bound + 1).toArrow()
    return df if got.num_rows > bound else df.sparkSession.createDataFrame(got, schema=df.schema)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from it.

    Like a reliable checkpoint it survives executor loss and keeps iterative plans short; unlike one it
    has a known size, so Spark can choose to broadcast it, and its columns can be pruned.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like ``cut_lineage``, but hashed by ``keys`` into as many buckets as a shuffle has partitions.

    Joins and aggregates by these keys then read the table without shuffling it, which pays where a large table is
    joined again and again with a small one.
    """
    spark = df.sparkSession
    path, many = scratch_path(spark, "cut"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "cut_" + path.rsplit("-", 1)[1]
    df.repartition(many, *keys).write.option("path", path).bucketBy(many, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
