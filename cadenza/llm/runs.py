"""Periodic runs of words, found with a dictionary of basic factors.

Every stretch of 1, 2, 4, ... words gets a name, equal stretches of one text the same. Where the next stretch of a name
begins within twice its length, and the next but one as far again, the two steps are an arithmetic progression whose
difference proposes a period. A run of period q and at least 4 q words shows such a progression at its first word for the
least power of two that is q or more, so none is missed. Proposals are extended to both sides by the names (longest
common extension, one comparison per power of two) and those that give the same stretch count once, with the least
period. Many short texts are worked side by side in numpy; names never join two texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import map_columns

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

Run = tuple[int, int, int]  # start, length, period


def words_of(text: str | None) -> list[str]:
    """Maximal stretches without ASCII white space."""
    if not text:
        return []
    # the library's own split also ends words at white space beyond ASCII
    return _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()


def names_of(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, from 0."""
    return np.unique(keys, return_inverse=True)[1]


class Factors:
    """Names of the stretches of 1, 2, 4, ... words of many texts laid end to end.

    Only stretches that occur more than once in their text have a name at a level; all longer ones that begin with, or
    end in, a nameless stretch are unique too. A level holds ascending positions and their names.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """``words``: numbers of the words; ``text``: the number of the text each belongs to, ascending."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(len(words))
        keys = text * (int(words.max(initial=0)) + 1) + words
        while len(at):
            names = names_of(keys)
            often = np.bincount(names)[names] > 1
            at, names = at[often], names[often]
            if not len(at):
                break
            self.levels.append((at.astype(np.int32), names.astype(np.int32)))
            # the stretch twice as long is the pair of names a step apart
            step = 1 << (len(self.levels) - 1)
            next_name = self.look(len(self.levels) - 1, at + step)
            both = next_name >= 0
            both[both] = text[at[both]] == text[at[both] + step]
            keys = names[both] * (int(names.max()) + 1) + next_name[both]
            at = at[both]

    def look(self, level: int, position: np.ndarray) -> np.ndarray:
        """Names of the stretches that begin at these positions, -1 where there is none."""
        at, names = self.levels[level]
        position = position.astype(np.int32)
        i = np.minimum(np.searchsorted(at, position), len(at) - 1)
        return np.where(at[i] == position, names[i], -1)

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First position and difference of each progression of three stretches of a name, at most twice their length apart.

        Of neighbouring positions with one difference only the first is returned.
        """
        at, names = self.levels[level]
        order = np.argsort(names, kind="stable")
        step = np.zeros(len(at), dtype=np.int64)
        follows = names[order[1:]] == names[order[:-1]]
        step[order[:-1][follows]] = (at[order[1:]] - at[order[:-1]])[follows]
        near = np.flatnonzero((step > 0) & (step <= 2 << level))
        then = step[np.searchsorted(at, at[near] + step[near])]
        near = near[then == step[near]]
        first = (np.diff(at[near], prepend=-2) != 1) | (np.diff(step[near], prepend=0) != 0)
        return at[near[first]], step[near[first]]

    def extend(self, left: np.ndarray, gap: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``left`` on (or before it) equal those ``gap`` further on, by halving lengths."""
        far = np.zeros(len(left), dtype=np.int64)
        open_ = np.arange(len(left))
        # the longest stretches may follow one another; each shorter length fits at most once more
        for level in range(len(self.levels) - 1, -1, -1):
            size, rows = 1 << level, open_
            while len(rows):
                a = left[rows] - far[rows] - size if back else left[rows] + far[rows]
                here = self.look(level, a)
                same = (here >= 0) & (here == self.look(level, a + gap[rows]))
                rows = rows[same]
                far[rows] += size
                if level < len(self.levels) - 1:
                    break
        return far

    def runs(self, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and smallest period of every run of at least ``least`` words and ``times`` (4 or more) periods."""
        found = [self.proposals(level) for level in range(len(self.levels))]
        empty = np.zeros(0, dtype=np.int64)
        start, gap = (np.concatenate([empty, *(f[i] for f in found)]) for i in (0, 1))
        start, gap = np.unique(np.stack([start, gap]), axis=1)
        first = start - self.extend(start, gap, back=True)
        length = start + self.extend(start, gap, back=False) + gap - first
        keep = (length >= least) & (length >= times * gap)
        first, length, gap = first[keep], length[keep], gap[keep]
        order = np.lexsort((gap, length, first))
        first, length, gap = first[order], length[order], gap[order]
        # a stretch is found with multiples of its smallest period too
        new = (np.diff(first, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
        first, length, gap = first[new], length[new], gap[new]
        order = np.lexsort((gap, first))
        return first[order], length[order], gap[order]


def find_runs(texts: list[list[int]] | list[np.ndarray], least: int = 6, times: int = 4) -> list[list[Run]]:
    """Runs of each sequence of word numbers, by start, then period."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return [[] for _ in texts]
    begin = np.array([0, *accumulate(sizes)])
    words = np.concatenate([np.asarray(t, dtype=np.int64) for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    start, length, gap = Factors(words, text).runs(least, times)
    of = text[start]
    out: list[list[Run]] = [[] for _ in texts]
    for t, s, n, q in zip(of.tolist(), (start - begin[of]).tolist(), length.tolist(), gap.tolist()):
        out[t].append((s, n, q))
    return out


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words but for those that some run repeats: all of a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a repetition that the id decides: every tenth crc32 gets one. A null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(df: DataFrame, keys: str, words, *, least: int = 6, times: int = 4, batch: int = 1 << 18) -> DataFrame:
    """``keys`` (a DDL list of columns to keep, the first given to ``words``), ``runs`` and ``collapsed`` per row.

    ``words(key, text)`` gives the words of a row; ``runs`` is an array of (start, length, period) by start, then period,
    and ``collapsed`` the text without its repetitions. Texts are taken whole; short ones are worked together, up to
    about ``batch`` words, a longer one alone. No words: no runs and an empty text.
    """
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        def work(*columns):
            split = [words(k, t) for k, t in zip(columns[0], columns[-1])]
            runs: list[list[Run]] = []
            part: list[list[int]] = []
            number: dict[str, int] = {}
            held = 0
            for row in [*split, None]:
                if part and (row is None or held + len(row) > batch):
                    runs += find_runs(part, least, times)
                    part, number, held = [], {}, 0
                if row is not None:
                    part.append([number.setdefault(w, len(number)) for w in row])
                    held += len(row)
            told = [[{"start": s, "length": n, "period": q} for s, n, q in some] for some in runs]
            return [*columns[:-1], told, [" ".join(collapse(w, r)) for w, r in zip(split, runs)]]

        return work

    schema = f"{keys}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_columns(df, [*names, "text"], schema, make, rows=256)


def planted_words(doc_id: int | None, text: str | None) -> list[str]:
    return planted(words_of(text), doc_id)


def run_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``, after the repetition its id plants: number of runs, the longest, digests of runs and rest.

    Null, empty and blank texts have no words and no runs: n_runs 0, nulls for the longest run and digests of nothing.
    Rows are independent, so repeated ids stay repeated; a row without an id gets no repetition.
    """
    found = periodic_runs(docs, "doc_id bigint", planted_words)
    runs = F.col("runs")
    # the longest; of equal length the least start, then period
    keyed = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    told = found.withColumn("_best", F.array_max(keyed))
    best = F.col("_best")
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.transform(runs, lambda r: F.concat(line(r), F.lit("\n")))
    return told.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["before"]).alias("start"),
        best["length"].alias("length"),
        (-best["shorter"]).alias("period"),
        F.expr("1000 * _best.length div -_best.shorter").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
