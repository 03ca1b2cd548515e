"""Packing of token sequences into bins of a fixed size: best fit over length counts, then swap-based local search.

Every piece is tokenised once. Only the number of pieces of each length (at most ``capacity`` numbers) goes
to the driver, where bins are planned as patterns with a multiplicity. The pieces then find their places by
their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.bpe import loaded, read_tokenizer
from cadenza.llm.common import map_columns
from cadenza.operators.ordered import chunk_scan
from cadenza.session import cut_lineage


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and ``end_id``, cut only when longer than ``capacity``.

    A null or empty text is the end id alone.
    """
    spec = read_tokenizer(docs.sparkSession, path)

    def make():
        bpe = loaded(spec.value)
        end = np.array([end_id], dtype="<u4").tobytes()

        def work(doc_ids, texts):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(doc_ids, bpe.encode(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            return out

        return work

    return map_columns(docs, ["doc_id", "text"], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Bins as a multiset of patterns (descending lengths): longest first, each into the fullest bin that takes it."""
    open_bins: dict[int, Counter] = {}  # room -> patterns
    rooms: list[int] = []  # ascending rooms that have bins
    done: Counter = Counter()

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room == 0:
            done[pattern] += times
            return
        if room not in open_bins:
            open_bins[room] = Counter()
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room][pattern] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            each = min(room // length, left)
            bins = min(times, left // each)
            if bins < times and pattern:
                put(room, pattern, times - bins)
            put(room - each * length, pattern + (length,) * each, bins)
            left -= bins * each
    for some in open_bins.values():
        done.update(some)
    return done


def exchange(low: tuple[int, ...], high: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The move, one-for-one or two-for-one exchange that fills ``high`` most; None if none fills it more.

    Filling the fuller of two bins always increases the sum of squared fills.
    """
    best, found = 0, None
    lows, highs = sorted(set(low)), sorted(set(high))
    for x in lows:
        if best < x <= room:
            best, found = x, ((x,), ())
    for y in highs:
        if best == room:
            break
        at = bisect_left(lows, y + room + 1) - 1
        if at >= 0 and lows[at] - y > best:
            best, found = lows[at] - y, ((lows[at],), (y,))
        i, j = 0, len(low) - 1
        ordered = low[::-1]
        while i < j:
            gain = ordered[i] + ordered[j] - y
            if gain > room:
                j -= 1
            else:
                if gain > best:
                    best, found = gain, ((ordered[i], ordered[j]), (y,))
                i += 1
    return found


def swap(low: tuple[int, ...], high: tuple[int, ...], out: tuple[int, ...], back: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    a, b = Counter(low), Counter(high)
    a.subtract(out)
    b.subtract(back)
    a.update(back)
    b.update(out)
    return tuple(sorted(a.elements(), reverse=True)), tuple(sorted(b.elements(), reverse=True))


class Underfull:
    """Patterns with room, by the lengths that they hold (0 for a bare move), the fullest first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.widest = np.full(capacity + 1, -1)

    def put(self, pattern: tuple[int, ...], there: bool) -> None:
        entry = (self.capacity - sum(pattern), pattern)
        for y in {0, *pattern} if entry[0] else ():
            held = self.by.setdefault(y, [])
            at = bisect_left(held, entry)
            found = at < len(held) and held[at] == entry
            if there and not found:
                held.insert(at, entry)
            elif found and not there:
                del held[at]
            self.widest[y] = held[-1][0] if held else -1

    def partner(self, low: tuple[int, ...], alone: bool) -> tuple[int, ...] | None:
        """The fullest pattern, not emptier than ``low``, with which ``low`` has an exchange."""
        limit = self.capacity - sum(low)
        singles = np.unique(low)
        i, j = np.triu_indices(len(singles), 1)
        twice = [x for x, n in Counter(low).items() if n > 1]
        sums = np.unique(np.concatenate([singles, singles[i] + singles[j], 2 * np.array(twice, dtype=np.int64), [4 * self.capacity]]))
        lengths = np.arange(self.capacity + 1)
        need = sums[np.searchsorted(sums, lengths, side="right")] - lengths
        need[0] = singles[0]
        best = None
        for y in np.flatnonzero(need <= np.minimum(self.widest, limit)).tolist():
            held = self.by[y]
            for at in range(bisect_left(held, (int(need[y]),)), len(held)):
                if held[at][0] > limit or best and held[at] >= best:
                    break
                if not (alone and held[at][1] == low):
                    best = held[at]
                    break
        return best[1] if best else None


def local_search(bins: Counter, capacity: int) -> Counter:
    """Empty the least filled bins by exchanges with other underfull bins.

    A bin without an exchange is set aside for the next emptiest one, and looked at again once others have changed.
    Ends when the number of bins reaches the lower bound given by the total, or when no two underfull bins have an
    exchange left. Exchanges of equal pairs of bins are made together, so the work follows the number of patterns.
    """
    bins = Counter({p: n for p, n in bins.items() if n})
    total = sum(sum(p) * n for p, n in bins.items())
    least, count = -(-total // capacity), sum(bins.values())
    under = Underfull(capacity)
    for p in bins:
        under.put(p, True)
    queue = [(sum(p), p) for p in bins if sum(p) < capacity]
    heapq.heapify(queue)
    aside: list[tuple[int, tuple[int, ...]]] = []
    changed = False
    while count > least and (queue or changed):
        if not queue:
            queue, aside, changed = aside, [], False
            heapq.heapify(queue)
            continue
        level, low = heapq.heappop(queue)
        if not bins.get(low):
            continue
        high = under.partner(low, bins[low] < 2)
        if high is None:
            aside.append((level, low))
            continue
        times = bins[low] // 2 if high == low else min(bins[low], bins[high])
        new_low, new_high = swap(low, high, *exchange(low, high, capacity - sum(high)))
        changed = True
        bins[low] -= times
        bins[high] -= times
        if not new_low:
            count -= times
        for pattern in filter(None, (new_low, new_high)):
            if not bins[pattern] and sum(pattern) < capacity:
                heapq.heappush(queue, (sum(pattern), pattern))
            bins[pattern] += times
        for pattern in {low, high, new_low, new_high} - {()}:
            under.put(pattern, bins[pattern] > 0)
        if bins[low]:
            heapq.heappush(queue, (level, low))
    return +bins


def slots(bins: Counter) -> dict[int, np.ndarray]:
    """Per length, the places in order of rank: first rank, first bin number, offset within the bin."""
    taken: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in sorted(bins.items(), reverse=True):
        at = 0
        for length in pattern:
            out.setdefault(length, []).append((taken[length], first, at))
            taken[length] += times
            at += length
        first += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(pieces: DataFrame, capacity: int, chunks: int = 64) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``; other columns stay.

    Rows are ranked within their length in hash chunks, so that a length shared by most rows is no single task.
    No rows give no rows; repeated rows are packed one by one.
    """
    rows = cut_lineage(pieces)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(local_search(best_fit(counts, capacity), capacity))
    chunk = F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(chunks, sum(counts.values()) // 100_000)))
    ranked = chunk_scan(rows, ["length"], [F.col("doc_id"), F.col("start")], chunk, number="_rank")
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]

    def make():
        def work(*columns):
            length, rank = np.array(columns[rows_at], dtype=np.int64), np.array(columns[-1], dtype=np.int64) - 1
            bin_no, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length):
                own, table = np.flatnonzero(length == n), places[int(n)]
                slot = np.searchsorted(table[:, 0], rank[own], side="right") - 1
                bin_no[own] = table[slot, 1] + rank[own] - table[slot, 0]
                offset[own] = table[slot, 2]
            return [*columns[:-1], bin_no, offset]

        return work

    rows_at = rows.columns.index("length")
    return map_columns(ranked, [*rows.columns, "_rank"], ", ".join([*names, "sequence_id bigint", "offset bigint"]), make, rows=8192)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(cut_pieces(docs, path, capacity), capacity)
