"""Byte-pair encoding with a segment tree over adjacent pair ranks, and decoding.

A word's adjacent pairs are the leaves of a tree whose nodes hold the smaller of their children's
``(rank, position)``. The root is the leftmost merge of lowest rank; a merge changes at most three leaves,
each in logarithmic time, until no pair can be merged. Long runs without a word border so cost n log n.
Words of up to 65 bytes go through such trees side by side, one per column of a numpy array.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm.common import map_columns, per_process

_NONE = 1 << 62
_FAR = (1 << 31) - 1
_AT = (1 << 32) - 1
_EMPTY = 0xFFFFFFFFFFFFFFFF
# Characters whose properties are the same in every Unicode version; other texts take the library's own splitter.
_SETTLED = r"[^\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe԰-῿⁰-\U0010ffff]*"
_WHITE = r"\t-\r \x85\xa0 -     "


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_symbols(ids: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols by rank, leftmost first. ``ranks``: left << 16 | right -> (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)

    def key(a: int, b: int, at: int) -> int:
        found = ranks.get(a << 16 | b)
        return _NONE if found is None else found[0] << 32 | at

    for i in range(n - 1):
        tree[size + i] = key(ids[i], ids[i + 1], i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        while at > 1:
            at >>= 1
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != _NONE:
        i = tree[1] & _AT
        j = after[i]
        ids[i] = ranks[ids[i] << 16 | ids[j]][1]
        k = after[j]
        after[i] = k
        ids[j] = -1
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, key(ids[i], ids[k], i))
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            put(h, key(ids[h], ids[i], h))
    return [x for x in ids if x >= 0]


class PairTable:
    """Vectorised lookup of two adjacent 16-bit ids -> rank, by open addressing over packed entries."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        keys = np.fromiter(pairs, dtype=np.uint64, count=len(pairs))
        ranks = np.fromiter((r for r, _ in pairs.values()), dtype=np.uint64, count=len(pairs))
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, np.uint64(_EMPTY))
        self.probes, at, entry = 0, self.slot(keys), keys << np.uint64(32) | ranks
        while len(entry):
            self.probes += 1
            free = self.table[at] == np.uint64(_EMPTY)
            self.table[at[free]] = entry[free]
            lost = self.table[at] != entry
            entry, at = entry[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where there is no such merge."""
        keys = ((left.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(16)) | right.astype(np.uint64) & np.uint64(0xFFFF)
        at = self.slot(keys)
        entry = self.table[at]
        same = entry >> np.uint64(32) == keys
        found = np.where(same, (entry & np.uint64(0xFFFFFFFF)).astype(np.int32), np.int32(-1))
        # only lanes that met another key go on; an empty slot ends the search
        odd = np.flatnonzero(~same & (entry != np.uint64(_EMPTY)))
        at, keys, flat = at.reshape(-1), keys.reshape(-1), found.reshape(-1)
        for step in range(1, self.probes):
            if not len(odd):
                break
            entry = self.table[(at[odd] + step) & ((1 << self.bits) - 1)]
            hit = entry >> np.uint64(32) == keys[odd]
            flat[odd[hit]] = (entry[hit] & np.uint64(0xFFFFFFFF)).astype(np.int32)
            odd = odd[~hit & (entry != np.uint64(_EMPTY))]
        return found


def merge_many(symbols: np.ndarray, lengths: np.ndarray, ranks: PairTable, merged: np.ndarray) -> np.ndarray:
    """``merge_symbols`` for many words at once: one segment tree per column, all moving step by step.

    ``symbols`` is (positions, words), -1 beyond a word's length; the number of positions is a power of two
    plus one. ``merged`` gives the id made by each rank. Symbols that were merged away come back as -1.
    """
    size, count = symbols.shape[0] - 1, symbols.shape[1]
    place = np.arange(size, dtype=np.int32)[:, None]
    rank = ranks(symbols[:-1], symbols[1:])
    tree = np.empty((2 * size, count), dtype=np.int32)
    tree[size:] = np.where((rank >= 0) & (place + 1 < lengths), rank * size + place, _FAR)
    for low in (1 << b for b in range(size.bit_length() - 2, -1, -1)):
        tree[low : 2 * low] = np.minimum(tree[2 * low : 4 * low : 2], tree[2 * low + 1 : 4 * low : 2])
    after = np.repeat(np.arange(1, size + 2, dtype=np.int32)[:, None], count, axis=1)
    before = after - 2
    while len(at := np.flatnonzero(tree[1] != _FAR)):
        root = tree[1, at]
        i = root % size
        j = after[i, at]
        k = after[j, at]
        symbols[i, at], symbols[j, at], after[i, at] = merged[root // size], -1, k
        inside = k < lengths[at]
        before[k[inside], at[inside]] = i[inside]
        h = before[i, at]
        # the leaf of the merged symbol, the leaf that went, the leaf to the left
        own = ranks(symbols[i, at], symbols[np.minimum(k, size), at])
        tree[size + i, at] = np.where(inside & (own >= 0), own * size + i, _FAR)
        gone = j < size
        tree[size + j[gone], at[gone]] = _FAR
        left = h >= 0
        hl, wl = h[left], at[left]
        own = ranks(symbols[hl, wl], symbols[i[left], wl])
        tree[size + hl, wl] = np.where(own >= 0, own * size + hl, _FAR)
        node, word = np.concatenate([size + i, size + j[gone], size + hl]), np.concatenate([at, at[gone], wl])
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[node, word] = np.minimum(tree[2 * node, word], tree[2 * node + 1, word])
    return symbols


class Bpe:
    """A tokenizer read from the JSON of the public tokenizers library (byte-level BPE with word ends)."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int32)
        self.ranks: dict[int, tuple[int, int]] = {}
        self.merged = np.zeros(len(model["merges"]), dtype=np.int32)
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], (rank, vocab[a + b]))
            self.merged[rank] = vocab[a + b]
        self.table = PairTable(self.ranks)
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the vocabulary's split pattern over settled characters, where letters are \w without digits and digits are decimal
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w{_WHITE}]|_)+")
        self.settled = re.compile(_SETTLED)
        self.config, self.library = config, None
        self.known: dict[str, bytes] = {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        return merge_symbols([*self.inner[list(raw[:-1])].tolist(), int(self.last[raw[-1]])], self.ranks)

    def learn(self, chunks: set[str], most: int = 600_000, long: int = 64) -> None:
        """Encode runs without white space that are not known yet. The store is emptied when it grows past a bound."""
        new = list(chunks.difference(self.known))
        if len(self.known) + len(new) > most:
            self.known.clear()
            new = list(chunks)
        words = list(map(self.plain.findall, new))
        by_size: dict[int, list[str]] = {}
        ids: dict[str, bytes] = {}
        for word in {w for some in words for w in some}:
            n = len(word) if word.isascii() else len(word.encode("utf-8"))
            if n > long:
                ids[word] = np.array(self.encode_word(word), dtype="<u4").tobytes()
            else:
                by_size.setdefault((n - 2).bit_length() if n > 2 else 1, []).append(word)
        for bits, some in by_size.items():
            for at in range(0, len(some), 1 << 14):
                part = some[at : at + (1 << 14)]
                ids.update(zip(part, self.encode_words(part, 1 << bits)))
        for chunk, some in zip(new, words):
            self.known[chunk] = ids[some[0]] if len(some) == 1 else b"".join([ids[w] for w in some])

    def encode_words(self, words: list[str], size: int) -> list[bytes]:
        """Ids of words of at most ``size`` + 1 bytes, all at once."""
        raw = np.frombuffer("\n".join([*words, ""]).encode("utf-8"), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10)
        lengths = np.diff(ends, prepend=-1) - 1
        place = np.arange(size + 1)[:, None]
        padded = raw[np.minimum(ends - lengths + place, ends)]
        symbols = np.where(place < lengths - 1, self.inner[padded], np.where(place == lengths - 1, self.last[padded], np.int32(-1)))
        done = merge_many(symbols, lengths.astype(np.int32), self.table, self.merged).T
        keep = done >= 0
        flat, to = done[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *to], to)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; null counts as empty."""
        rows: list[list[str] | bytes] = []
        for text in texts:
            if text and self.settled.fullmatch(text) and not (self.cut and self.cut.search(text)):
                rows.append(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split())
            else:
                rows.append(self.encode_odd(text) if text else b"")
        chunks: set[str] = set()
        for row in rows:
            if isinstance(row, list):
                chunks.update(row)
        self.learn(chunks)
        get = self.known.__getitem__
        return [b"".join(map(get, row)) if isinstance(row, list) else row for row in rows]

    def encode_odd(self, text: str) -> bytes:
        """A text with special tokens or characters beyond the settled range, split by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.config)
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.library.normalizer.normalize_str(part)
                words = [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
                out += [np.array(self.encode_word(w), dtype="<u4").tobytes() for w in words]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's decoding without a decoder: tokens joined by spaces, special tokens kept."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def loaded(config: str) -> Bpe:
    """The tokenizer of this worker process, with the words it has met so far."""
    return per_process(hashlib.md5(config.encode()).hexdigest(), lambda: Bpe(config))


def read_tokenizer(spark: SparkSession, path: str):
    """Broadcast a tokenizer file; its size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def bpe_encode(df: DataFrame, path: str, keys: str, text: str = "text") -> DataFrame:
    """``keys`` (a DDL list of columns to keep) and ``ids`` binary: ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Texts are taken whole; repeated rows stay repeated; other columns are left out.
    """
    spec = read_tokenizer(df.sparkSession, path)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        bpe = loaded(spec.value)
        return lambda *columns: [*columns[:-1], bpe.encode(columns[-1])]

    return map_columns(df, [*names, text], f"{keys}, ids binary", make)


def bpe_decode(df: DataFrame, path: str, keys: str, ids: str = "ids") -> DataFrame:
    """``keys`` and ``decoded``: the text that the ids stand for. Null ids decode to an empty text."""
    spec = read_tokenizer(df.sparkSession, path)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        bpe = loaded(spec.value)
        return lambda *columns: [*columns[:-1], [bpe.decode(i or b"") for i in columns[-1]]]

    return map_columns(df, [*names, ids], f"{keys}, decoded string", make)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, number of ids, digest of the ids and digest of the text decoded from them.

    A null text counts as empty: no ids, and the digests of nothing.
    """
    coded = bpe_encode(docs, path, "doc_id bigint")
    told = coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    back = bpe_decode(told, path, "doc_id bigint, n_tokens bigint, ids_sha256 string")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
