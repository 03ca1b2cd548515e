"""Winnowed document fingerprints: rolling k-gram hashes, the least of every window, rightmost on ties.

Two texts that share a run of ``k + window - 1`` characters share a selected hash; the positions of the selected
k-grams are kept, so that a shared hash points at the passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import map_columns

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self):
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, dtype=np.uint64))]) for b in (_BASE, _INVERSE))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            self.grow(2 * n)
        return self.up[:n], self.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, k: int, powers: Powers) -> np.ndarray:
    """32-bit hashes of all k-grams of code points; of the whole text if it is shorter than k."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    up, down = powers.of(n)
    sums = np.cumsum(_mixed(points + np.uint64(1)) * up)
    rolled = sums[k - 1 :].copy()
    rolled[1:] -= sums[: n - k]
    return _mixed(rolled * down[: n - k + 1] + np.uint64(k)) >> np.uint64(32)


def winnow(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions in order: the rightmost least hash of every window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    window = min(window, n)
    last = np.uint64(0xFFFFFFFF)
    # hash first, then the later position: the minimum is the rightmost least
    least = hashes << np.uint64(32) | (last - np.arange(n, dtype=np.uint64))
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (last - (chosen & last)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, k: int = 12, window: int = 48, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, hashes array<bigint>, positions array<int>`` of every whole text, in order of position.

    Null and empty texts have no hashes; a text shorter than ``k`` has one hash, of all of it.
    """

    def make():
        powers = Powers()

        def work(ids, texts):
            both = [winnow(gram_hashes(t or "", k, powers), window) for t in texts]
            return [ids, [h.tolist() for h, _ in both], [p.tolist() for _, p in both]]

        return work

    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id", "text"], "doc_id bigint, hashes array<bigint>, positions array<int>", make)


def edited_report(docs: DataFrame, k: int = 12, window: int = 48, chunks: int = 1024) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter is the beginning of the next document.

    Order is by doc_id (null first), then by hash of the text; the last document's next is the first; a row repeated
    with the same id and text counts once. Documents are dealt once, compressed, into chunks of neighbouring ids; the first document
    of a chunk is also sent to the chunk before, so that no chunk waits for another. ``chunks`` only sets how finely.
    """
    body, low = F.coalesce("text", F.lit("")), F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), low).alias("k"), body.alias("text"), F.xxhash64(body).alias("h"))
    # at most ``chunks`` ids that exist in the table, in order; each begins a chunk
    told = rows.agg(F.min("k").alias("lo"), F.percentile_approx("k", [i / chunks for i in range(1, chunks)], 10 * chunks).alias("cuts")).first()
    starts = np.array(sorted({told["lo"], *told["cuts"]}) if told["lo"] is not None else [0], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, hashes = part.column(0).to_numpy(), part.column(2).to_numpy()
                texts = [pack.compress(t.encode("utf-8")) for t in part.column(1).to_pylist()]
                home = np.searchsorted(starts, keys, side="right") - 1
                first = np.flatnonzero(starts[home] == keys)
                take = np.concatenate([np.arange(len(keys)), first])
                chunk = np.concatenate([home, (home[first] - 1) % len(starts)])
                halo = np.arange(len(take)) >= len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk, pa.int32()), pa.array(halo), pa.array(keys[take]), pa.array(hashes[take]), pa.array([texts[i] for i in take], pa.binary())],
                    names=["chunk", "halo", "k", "h", "z"],
                )

    dealt = rows.mapInArrow(deal, "chunk int, halo boolean, k bigint, h bigint, z binary")
    ordered = dealt.repartition("chunk").sortWithinPartitions("chunk", "halo", "k", "h")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected int, n_edited int"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_selected", pa.int32()), ("n_edited", pa.int32())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unpack = Powers(), zstandard.ZstdDecompressor()

        def read(chunk: int, k: int, h: int, z: bytes):
            text = unpack.decompress(z).decode("utf-8")
            hashes, _ = winnow(gram_hashes(text, k_gram, powers), window)
            return chunk, k, h, text, hashes, np.unique(hashes)

        def compared(one, other) -> tuple:
            _, key, _, text, hashes, distinct = one
            take = len(text) // 4
            edited = text[: len(text) - take] + other[3][:take]
            again, _ = winnow(gram_hashes(edited, k_gram, powers), window)
            return (
                None if key == -(1 << 63) else key, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), _hex(hashes), _hex(again),
                likeness(distinct, np.unique(again)), likeness(distinct, other[5]), len(hashes), len(again),
            )

        held, closed, out = None, -1, []
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, halo, key, h, z = (batch.column(c)[i].as_py() for c in range(5))
                if chunk == closed or held and held[0] == chunk and (held[1], held[2]) == (key, h) and not halo:
                    continue  # a second copy beyond the border, or a repeated row
                now = read(chunk, key, h, z)
                if held is not None and held[0] == chunk:
                    out.append(compared(held, now))
                held = now
                if halo:
                    closed, held = chunk, None
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    k_gram = k
    return ordered.mapInArrow(pair, schema)


def _hex(hashes: np.ndarray) -> str:
    """The selected hashes in order of position, eight hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()
