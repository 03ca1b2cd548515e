"""Language identification by cross-parsing.

For every language a suffix automaton is built over labelled text. A document is parsed into phrases, each the
longest match that starts where the last one ended; the language whose automaton needs the fewest phrases, weighed
by the logarithm of its text's size (the cross-parsing estimate of entropy), wins.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.llm.common import hashed_sample, keep_rows, map_columns, per_process
from cadenza.session import small_table

_ASCII_WORDS = re.compile(r"[a-z]+")
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_DENSE = 1 << 23  # moves of an automaton that are kept as a plain table


def letters_only(text: str | None) -> str:
    """Words of letters and the marks on them in lower case, one blank between; digits, number signs and punctuation go."""
    if not text:
        return ""
    low = text.lower()
    return " ".join((_ASCII_WORDS if low.isascii() else _WORDS).findall(low))


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``text``; state 0 is the root."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Dense:
    """Moves as a table of states x symbols. A state is the place of its row; two low bits count the phrases a move ends."""

    kind = np.int32

    def __init__(self, states: list[dict[str, int]], at: dict[str, int], width: int):
        table = np.full((len(states), width), -1, dtype=np.int32)
        for state, moves in enumerate(states):
            for c, to in moves.items():
                table[state, at[c]] = to * width
        # no move: the phrase ends and the next begins with this symbol; a symbol never seen is a phrase of its own
        never = table[0] < 0
        ended = np.where(table < 0, (1 + never).astype(np.int32), np.int32(0))
        ended[0] = never
        self.table = (np.where(table < 0, np.where(never, 0, table[0]), table) << 2 | ended).astype(np.int32).ravel()

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.table[state + symbol]


class Sparse:
    """The same moves as sorted (state, symbol) keys, for alphabets so wide that nearly all of the table would be empty."""

    kind = np.int64

    def __init__(self, states: list[dict[str, int]], at: dict[str, int], width: int):
        keys = np.array([state * width + at[c] for state, moves in enumerate(states) for c in moves], dtype=np.int64)
        to = np.array([t * width for moves in states for t in moves.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.moves = keys[order], to[order] << 2
        root = np.full(width, -1, dtype=np.int64)
        for c, t in states[0].items():
            root[at[c]] = t * width
        never = root < 0
        self.missed = np.where(never, 0, root) << 2 | (1 + never)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state + symbol
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        # at the root no phrase is under way that could end
        return np.where(self.keys[i] == key, self.moves[i], self.missed[symbol] - (state == 0))


class Parser:
    """Automata of all languages; a move's two low bits count the phrases that it ends."""

    def __init__(self, learned: dict[str, tuple[str, int]]):
        samples = {language: text for language, (text, _) in learned.items()}
        rows = sum(n for _, n in learned.values())
        self.prior = np.array([-math.log2(learned[language][1] / rows) for language in sorted(samples)])
        self.languages = sorted(samples)
        alphabet = sorted({c for s in samples.values() for c in s})
        self.width = len(alphabet) + 1  # the last symbol stands for every other letter
        self.symbol = np.full(0x110000, len(alphabet), dtype=np.int32)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        at = {c: i for i, c in enumerate(alphabet)}
        self.moves, self.bits = [], []
        for language in self.languages:
            states = suffix_automaton(samples[language])
            kind = Dense if len(states) * self.width <= _DENSE else Sparse
            self.moves.append(kind(states, at, self.width))
            self.bits.append(math.log2(len(samples[language]) + 2))

    def phrases(self, texts: list[str], stretch: int = 1024) -> np.ndarray:
        """Phrases per text and language. Texts are parsed in stretches of ``stretch`` symbols, side by side; a phrase
        does not cross from one stretch into the next. The blank before a word belongs to the text."""
        owner, parts = [], []
        for i, text in enumerate(texts):
            points = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            for at in range(0, len(points), stretch):
                owner.append(i)
                parts.append(points[at : at + stretch])
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not parts:
            return counts
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        lanes = np.zeros((stretch, len(parts)), dtype=np.int32)
        for lane, i in enumerate(order):
            lanes[: sizes[i], lane] = parts[i]
        owner, sizes = np.array(owner)[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes that have a symbol at each step
        for j, moves in enumerate(self.moves):
            state, ended = np.zeros(len(parts), dtype=moves.kind), np.zeros(len(parts), dtype=np.int32)
            for t in range(sizes[0]):
                n = live[t]
                move = moves(state[:n], lanes[t, :n])
                ended[:n] += move & 3
                state[:n] = move >> 2
            counts[:, j] = np.bincount(owner, weights=ended + (state > 0), minlength=len(texts))
        return counts

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, probability and bits per letter of each text; ``und`` with 0 if it has no letter."""
        clean = [letters_only(t) for t in texts]
        bits = self.phrases(clean) * np.array(self.bits) + self.prior
        out = []
        for text, row in zip(clean, bits):
            if not text or not self.languages:
                out.append(("und", 0.0, 0.0))
                continue
            best = int(np.argmin(row))
            chance = 1.0 / float(np.exp2(np.clip(row[best] - row, -1000, 0)).sum())
            out.append((self.languages[best], chance, float(row[best]) / len(text)))
        return out


def training_samples(docs: DataFrame, learn: Column, label: str = "lang", text: str = "text", rows_each: int = 400, piece: int = 600, most: int = 40_000) -> dict[str, tuple[str, int]]:
    """Per language its normalised labelled text and its number of labelled rows.

    The text is a bounded sample for every language, however many rows it has: the ``rows_each`` distinct texts of
    smallest hash, ``piece`` letters of each from a place set by the same hash, ``most`` in all. The counts cover all rows.
    """
    some = docs.where(learn & F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wanted = [(r["lang"], r["h"]) for r in hashed_sample(some.select("lang", "h").distinct(), "lang", "h", rows_each).collect()]
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - 2 * piece, F.lit(1))).cast("int") + 1
    hit = some.join(small_table(docs.sparkSession, wanted, "lang string, h bigint"), ["lang", "h"])
    rows = hit.groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(2 * piece))).alias("part")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(row["lang"], []).append(letters_only(row["part"])[:piece])
    return {language: (found, counts[language]) for language, parts in samples.items() if (found := " ".join(p for p in parts if p)[:most])}


def _parser(samples: dict[str, tuple[str, int]]) -> Parser:
    """The automata of these samples, built once in a worker process."""
    mark = hashlib.md5(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return per_process(mark, lambda: Parser(samples))


def identify(docs: DataFrame, samples: dict[str, tuple[str, int]], keys: str = "doc_id bigint", text: str = "text") -> DataFrame:
    """Judge by samples from ``training_samples``: fewest phrases, the share of a language among labelled rows decides near-ties.

    Returns ``keys`` with ``lang_pred``, ``score`` (probability, 0 to 1) and ``bits`` (per letter) for every whole text.

    ``und`` and 0 for null texts and texts without a letter, or if nothing was learned. Nothing but the text decides;
    repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        parser = _parser(shared.value)

        def work(*columns):
            found = parser.judge(columns[-1])
            return [*columns[:-1], *[list(c) for c in zip(*found)]] if found else [*columns[:-1], [], [], []]

        return work

    return map_columns(docs, [*names, text], f"{keys}, lang_pred string, score double, bits double", make, rows=2048)


def in_a_language(docs: DataFrame, samples: dict[str, tuple[str, int]], least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has letters and one likeliest language with at least ``least`` probability."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        parser = _parser(shared.value)
        return lambda texts: [language != "und" and chance >= least for language, chance, _ in parser.judge(texts)]

    return keep_rows(docs, text, make)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and judge all of them."""
    fold = F.coalesce(held_out(), F.lit(False))
    samples = training_samples(docs, ~fold)
    judged = identify(docs.withColumn("held_out", fold), samples, "doc_id bigint, held_out boolean")
    return judged.select("doc_id", "held_out", "lang_pred", "score", F.round("bits", 6).alias("bits"))
