"""Byte-level BPE with a hierarchical-bitmap rank queue, and decoding.

The adjacent pairs of the pre-tokens wait in one bucket per merge rank, each a list of positions in a linked list of
symbols. A bitmap of two levels, 256 wide, marks the buckets that hold something; finding its first set bit gives the
next rank in two steps whatever the length. A merge never searches the queue for the pairs it ends: they go stale and
are skipped when they come up. The work is n log n at most in the bytes of the longest pre-token, so one of megabytes
is no worse than many short ones; all the new pre-tokens of some texts share one queue.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm.bpe import PairTable
from cadenza.llm.common import map_columns, per_process

# The public split pattern in ASCII classes, and over characters whose class is the same in every Unicode version and is
# told by \w and \d; other characters are first mapped to an ASCII one of their class.
_SETTLED = re.compile(r"[^\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0530-\u1fff\u2070-\U0010ffff]*")
_SETTLED_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


class RankQueue:
    """Merges many pre-tokens in one linked list, separated by a symbol that pairs with nothing.

    ``ranks`` maps the bytes of a token to its rank, which is also its id. Two adjacent symbols may merge if their bytes
    joined are ranked: least rank first, leftmost among equals. One order over all pre-tokens is that order in each.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.border = max(ranks.values()) + 1
        # left << 16 | right -> rank, for every way to cut a token into two tokens
        cuts = ((token[:i], token[i:], rank) for token, rank in ranks.items() for i in range(1, len(token)))
        self.pairs = {ranks[a] << 16 | ranks[b]: rank for a, b, rank in cuts if a in ranks and b in ranks}
        self.table = PairTable({key: (rank, rank) for key, rank in self.pairs.items()})
        self.buckets: dict[int, list[int]] = {}
        self.top, self.low = 0, [0] * ((self.border >> 8) + 1)

    def wait(self, rank: np.ndarray, position: np.ndarray) -> None:
        """Put positions into the buckets of their ranks."""
        order = np.argsort(rank, kind="stable")
        rank, position = rank[order], position[order].tolist()
        starts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(position)]):
            if r in self.buckets:
                self.buckets[r] += position[a:b]
            else:
                self.buckets[r] = position[a:b]
                self.top |= 1 << (r >> 8)
                self.low[r >> 8] |= 1 << (r & 255)

    def next_rank(self) -> int:
        """The least rank with a bucket: the first set bit of either level."""
        word = (self.top & -self.top).bit_length() - 1
        return (word << 8) + (self.low[word] & -self.low[word]).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        word = rank >> 8
        self.low[word] ^= 1 << (rank & 255)
        if not self.low[word]:
            self.top ^= 1 << word
        return self.buckets.pop(rank)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Per pre-token its ids as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        # one border before each pre-token and one at the end
        ids = np.full(len(raw) + len(pieces) + 1, self.border, dtype=np.int64)
        ids[np.arange(len(raw)) + np.repeat(np.arange(1, len(pieces) + 1), lengths)] = self.byte[raw]
        pair = np.append(self.table(ids[:-1], ids[1:]).astype(np.int64), -1)
        at = np.flatnonzero(pair >= 0)
        self.wait(pair[at], at)
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        self.merge_wide(ids, pair, after, before)
        lists = ids.tolist(), pair.tolist(), after.tolist(), before.tolist()
        while self.top:
            self.merge_bucket(*lists)
        done = np.array(lists[0])
        done = done[done >= 0]
        border = np.flatnonzero(done == self.border)
        ends = (4 * (border - np.arange(len(border)))).tolist()
        flat = done[done != self.border].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def merge_wide(self, ids: np.ndarray, pair: np.ndarray, after: np.ndarray, before: np.ndarray, wide: int = 64) -> None:
        """Empty whole buckets at once while they hold many positions; stops where they have become small.

        Of pairs that overlap the leftmost goes first and the others wait again. A bucket of which most overlaps, or in
        which a merge would make a pair of lower rank, is left to ``merge_bucket``.
        """
        size = 4.0 * wide
        while self.top and size > wide:
            r = self.next_rank()
            i = np.array(self.buckets[r])
            i = i[pair[i] == r]
            size = 0.9 * size + 0.1 * len(i)
            behind = pair[before[i]] == r
            i, again = i[~behind], i[behind]
            if len(again) > len(i):
                self.merge_bucket(ids, pair, after, before)
                continue
            j = after[i]
            k = after[j]
            old = ids[i], ids[j], before[k]
            ids[i], ids[j], after[i], before[k] = r, -1, k, i
            h = before[i]
            right, left = self.table(ids[i], ids[k]).astype(np.int64), self.table(ids[h], ids[i]).astype(np.int64)
            if ((right >= 0) & (right < r)).any() or ((left >= 0) & (left < r)).any():
                ids[i], ids[j], before[k] = old
                after[i] = j
                self.merge_bucket(ids, pair, after, before)
                continue
            self.take(r)
            pair[j], pair[h], pair[i] = -1, left, right
            made, place = np.concatenate([right, left, np.full(len(again), r)]), np.concatenate([i, h, again])
            self.wait(made[made >= 0], place[made >= 0])

    def merge_bucket(self, ids, pair, after, before) -> None:
        """Empty the bucket of least rank position by position; symbols that were merged away become -1."""
        pairs, buckets, low = self.pairs.get, self.buckets, self.low
        r = self.next_rank()
        bucket = self.take(r)
        bucket.sort()
        for at, i in enumerate(bucket):
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i], before[k], pair[j] = r, -1, k, i, -1
            h, least = before[i], r
            for left, made in ((i, pairs(r << 16 | ids[k], -1)), (h, pairs(ids[h] << 16 | r, -1))):
                pair[left] = made
                if made < 0:
                    continue
                if made in buckets:
                    buckets[made].append(left)
                else:
                    buckets[made] = [left]
                    self.top |= 1 << (made >> 8)
                    low[made >> 8] |= 1 << (made & 255)
                if made < least:
                    least = made
            if least < r and at + 1 < len(bucket):
                # a lower rank has come up: it goes first, the rest of this bucket waits again
                buckets[r] = bucket[at + 1 :]
                self.top |= 1 << (r >> 8)
                low[r >> 8] |= 1 << (r & 255)
                return


class Classes(dict):
    """Code point -> an ASCII character of the same class (letter, number, space, other), as the tokenizer library sees it.

    Unicode versions differ between libraries, so the classes are asked of that library: with a one-class pattern it
    returns the characters of the class alone.
    """

    def __init__(self):
        import tiktoken

        every = "".join(map(chr, (c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)))
        plain = {bytes([b]): b for b in range(256)}
        for pattern, stand in ((r"\p{L}", "A"), (r"\p{N}", "0"), (r"\s", "\t")):
            only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
            self.update(dict.fromkeys(map(ord, bytes(only.encode_ordinary(every)).decode("utf-8")), stand))
        self.update({code: chr(code) for code in range(128)})

    def __missing__(self, code: int) -> str:
        return self.setdefault(code, "!")


class ByteBpe:
    """A tokenizer read from a file of ranks, a base64 token and its rank on each line."""

    def __init__(self, lines: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(self.ranks)
        self.classes: Classes | None = None
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order; joined they are the text."""
        if text.isascii():
            return _SPLIT.findall(text)
        if _SETTLED.fullmatch(text):
            return _SETTLED_SPLIT.findall(text)
        if self.classes is None:
            self.classes = Classes()
        ends = list(accumulate(map(len, _SPLIT.findall(text.translate(self.classes)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: set[str], most: int = 128 << 20) -> None:
        """Encode pre-tokens that are not known yet. The store is emptied when it would pass about ``most`` bytes."""
        new = list(pieces.difference(self.known))
        size = sum(map(len, new)) * 2 + 200 * len(new)
        if self.held + size > most:
            self.known.clear()
            self.held, new = 0, list(pieces)
        self.held += size
        raw = [piece.encode("utf-8") for piece in new]
        # a pre-token that is a token is taken whole
        whole = {p: np.array([self.ranks[r]], dtype="<u4").tobytes() for p, r in zip(new, raw) if r in self.ranks}
        rest = [(p, r) for p, r in zip(new, raw) if p not in whole]
        self.known.update(whole)
        if rest:
            self.known.update(zip([p for p, _ in rest], self.queue.merge([r for _, r in rest])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; null counts as empty."""
        rows = [self.pieces(text) if text else [] for text in texts]
        self.learn(set().union(*rows))
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in rows]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def loaded(lines: str) -> ByteBpe:
    """The tokenizer of this worker process, with the pre-tokens it has met so far."""
    return per_process(hashlib.md5(lines.encode()).hexdigest(), lambda: ByteBpe(lines))


def read_ranks(spark: SparkSession, path: str):
    """Broadcast a file of ranks; its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="ascii") as file:
        return spark.sparkContext.broadcast(file.read())


def byte_encode(df: DataFrame, path: str, keys: str, text: str = "text") -> DataFrame:
    """``keys`` (a DDL list of columns to keep) and ``ids`` binary: ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Texts are taken whole, however long; repeated rows stay repeated; other columns
    are left out; an empty table gives an empty one.
    """
    spec = read_ranks(df.sparkSession, path)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        bpe = loaded(spec.value)
        return lambda *columns: [*columns[:-1], bpe.encode(columns[-1])]

    return map_columns(df, [*names, text], f"{keys}, ids binary", make, rows=128)


def byte_decode(df: DataFrame, path: str, keys: str, ids: str = "ids") -> DataFrame:
    """``keys`` and ``decoded`` binary: the bytes that the ids stand for. Null ids decode to nothing."""
    spec = read_ranks(df.sparkSession, path)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        bpe = loaded(spec.value)
        return lambda *columns: [*columns[:-1], [bpe.decode(i or b"") for i in columns[-1]]]

    return map_columns(df, [*names, ids], f"{keys}, decoded binary", make, rows=128)


def byte_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, number of ids, digest of the ids and digest of the bytes decoded from them.

    A null text counts as empty: no ids, and the digests of nothing. Rows are independent, so null and repeated ids are kept.
    """
    coded = byte_encode(docs, path, "doc_id bigint")
    told = coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = byte_decode(told, path, "doc_id bigint, n_tokens bigint, ids_sha256 string")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
