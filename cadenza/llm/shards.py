"""Sharding by histogram sort.

Rows are ordered by a 128-bit key (hash of the text, then the id), so equal texts lie side by side. Splitters
between shards are found without sorting: every round counts the exact bytes and rows below many candidate
keys over all partitions and narrows the brackets, until each splitter is within tolerance. Then the rows are
exchanged once, into fine pieces of the key range, and numbered inside them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cadenza.session import cut_lineage

_TOP = 1 << 128


def _keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Add ``_key``: 16 bytes that sort by the hash of the text and then by the id."""
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    return df.withColumn("_key", F.unhex(F.concat(part(F.xxhash64(F.coalesce(text, F.lit("")))), part(F.coalesce(doc_id, F.lit(0)).cast("bigint")))))


def _bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def _buckets(column: pa.Array, probes: np.ndarray) -> np.ndarray:
    """For each key the number of probes that are not above it."""
    keys = np.frombuffer(b"".join(column.to_pylist()), dtype="S16")
    return np.searchsorted(probes, keys, side="right")


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Exact ``(bucket, bytes, rows, least key, greatest key)`` between candidate keys, over all partitions."""
    cuts = _bytes(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(batch.column(0), cuts), pa.int32()), batch.column(1), batch.column(0)], names=["bucket", "size", "_key"])

    told = rows.select("_key", "size").mapInArrow(run, "bucket int, size bigint, _key binary")
    got = told.groupBy("bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()
    return sorted((r["bucket"], r["b"], r["n"], int.from_bytes(r["lo"], "big"), int.from_bytes(r["hi"], "big")) for r in got)


def splitters(rows: DataFrame, pieces: int, per_shard: int, tolerance: float, probes_each: int = 8) -> list[int]:
    """``pieces - 1`` keys that cut the rows into pieces of near-equal bytes.

    Every ``per_shard``-th splitter, a border between shards, is refined until it is within ``tolerance`` of a
    shard's bytes or stands between two rows; the others may miss by a quarter of a piece. Probes cover whole
    text hashes first, so a border falls inside a group of equal texts only when no border of a group is near enough.
    """
    whole = histogram(rows, [])
    if not whole:
        return [_TOP - 1] * (pieces - 1)
    total = whole[0][1]
    goal = [total * i // pieces for i in range(1, pieces)]
    slack = [tolerance * total * per_shard / pieces if i % per_shard == 0 else 0.25 * total / pieces for i in range(1, pieces)]
    # key -> bytes below it; brackets that hold rows: key of the first row, key of the last, bytes and rows inside
    below = {whole[0][3]: 0, min(whole[0][4] + 1, _TOP - 1): total}
    edges = sorted(below)
    inside = {edges[0]: (whole[0][4], total, whole[0][2])}
    result: list[int | None] = [None] * (pieces - 1)
    while True:
        marks = [below[k] for k in edges]
        probes: set[int] = set()
        ends: set[int] = set()
        for i, want in enumerate(goal):
            if result[i] is not None:
                continue
            at = bisect_left(marks, want)
            hi, lo = edges[at], edges[max(at - 1, 0)]
            near = min((lo, hi), key=lambda k: abs(below[k] - want))
            last, _, count = inside.get(lo, (lo, 0, 0))
            if abs(below[near] - want) <= slack[i] or count <= 1 or last <= lo:
                result[i] = near
                continue
            step = [lo + (last + 1 - lo) * j // (probes_each + 1) for j in range(1, probes_each + 1)]
            # a probe at a whole hash keeps equal texts together as long as the bracket spans several hashes
            probes |= {k for k in ((s >> 64 << 64 if lo >> 64 != last >> 64 and (s >> 64 << 64) > lo else s) for s in step) if lo < k <= last}
            if lo >> 64 != last >> 64 and last >> 64 << 64 > lo:
                probes.add(last >> 64 << 64)
            ends |= {lo, hi}  # counted again, so that each new bucket lies inside its bracket
        if not probes:
            return result
        cuts = sorted(probes | ends)
        got = histogram(rows, cuts)
        base, found = 0, {}
        by_bucket = {b: x for b, *x in got}
        for bucket in range(len(cuts) + 1):
            size, count, least, greatest = by_bucket.get(bucket, (0, 0, 0, 0))
            if bucket:
                below[cuts[bucket - 1]] = base
            if count:
                found[least] = (greatest, size, count)
                below.setdefault(least, base)
                if greatest + 1 < _TOP:
                    below.setdefault(greatest + 1, base + size)
            base += size
        inside.update(found)
        edges = sorted(below)


def shard_by_bytes(df: DataFrame, shards: int = 16, *, tolerance: float = 0.002, doc_id: str = "doc_id", text: str = "text", fine: int = 64) -> DataFrame:
    """Add ``shard`` and ``slot`` (place in the shard, gapless from 0) to rows that have a byte count ``size``.

    Shards differ from the mean by at most about ``tolerance`` of it, or half a row where rows are larger than that.
    Equal texts stand together in one shard unless they hold more bytes than the tolerance lets move. A null text
    sorts as an empty one, a null id as 0; repeated rows keep a place each; an empty table gives no rows.
    """
    rows = cut_lineage(_keyed(df, text, doc_id).drop(text))
    pieces = shards * fine
    cuts = _bytes(splitters(rows, pieces, fine, tolerance))
    names = rows.columns
    at = names.index("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_buckets(batch.column(at), cuts), pa.int32())], names=[*names, "_piece"])

    dealt = rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_piece int"]))
    sums = dealt.groupBy("_piece").agg(F.count("*").alias("_n"))
    shard = F.expr(f"_piece div {fine}").cast("int")
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_piece").orderBy("_key"))
    placed = dealt.withColumn("_row", inside).join(offsets, "_piece")
    return placed.select(*[c for c in names if c != "_key"], shard.alias("shard"), (F.col("_row") - 1 + F.col("_before")).cast("bigint").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document its size in bytes plus one, the checksum of its text, and its place under the law of near-equal bytes."""
    body = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "text", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    return shard_by_bytes(sized, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
