"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's features are its words and their beginnings, hashed; a feature's value is its share of the words, so
that long texts gather no severity by chance. One weight per feature is shared by all thresholds: P(severity <= j) = sigmoid(threshold_j - weights . features), with thresholds in ascending order. The
expected severity is the sum over j of P(severity > j).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import hashed_sample, keep_rows, map_columns

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str, bits: int) -> list[int]:
    """Hashed features of one word in lower case: the word and its first 3 to 7 letters."""
    raw = [word + "$", *(word[:n] for n in range(3, min(8, len(word) + 1)))]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for f in raw]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def scale(words: int) -> float:
    """Value of one occurrence among so many words; short texts are not all decided by one word."""
    return 100.0 / (words + 20.0)


@dataclass
class Ordinal:
    """A fitted model: hashed feature -> weight, ascending thresholds, bits of the feature hash."""

    weights: dict[int, float]
    thresholds: list[float]
    bits: int

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word, self.bits))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, steps: int = 400, rate: float = 0.1, penalty: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by full-batch Adam on the cumulative-link likelihood with an L2 penalty.

    The sparse matrix is given by ``rows, features, values``. Thresholds are the first one and logarithms of the gaps,
    so that they stay in order.
    """
    n = len(grades)
    theta = np.zeros(n_features + n_grades - 1)
    at_least = np.array([max(np.mean(grades > j), 0.5 / n) for j in range(n_grades - 1)])
    start = np.log1p(-np.minimum(at_least, 1 - 0.5 / n)) - np.log(at_least)
    theta[n_features] = start[0]
    theta[n_features + 1 :] = np.log(np.maximum(np.diff(start), 0.1))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cut = theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=values * w[features], minlength=n)
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        up, down = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        d_score = (d_up - d_down) / n
        d_cut = np.array([-(d_up[grades == j].sum() - d_down[grades == j + 1].sum()) / n for j in range(n_grades - 1)])
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(features, weights=values * d_score[rows], minlength=n_features) + penalty * w
        grad[n_features] = d_cut.sum()
        grad[n_features + 1 :] = [d_cut[j + 1 :].sum() * gaps[j] for j in range(n_grades - 2)]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        theta -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int) -> list[tuple[int, str]]:
    """At most ``each`` toxic and ``each`` clean labelled texts, those of smallest text hash; equal texts count once.

    A text labelled both ways counts as toxic. This bound holds for the fitting alone.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id")
    classes = known.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    chosen = hashed_sample(classes, "toxic", "h", each).select("doc_id", "h", F.col("toxic").alias("mark"))
    spark = docs.sparkSession
    few = spark.createDataFrame(chosen.toArrow(), schema=chosen.schema)  # bounded: 2 x each rows
    hit = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h")).join(few, ["doc_id", "h"])

    def make():
        return lambda mark, texts: [mark, ["\n".join(f"{w} {n}" for w, n in sorted(word_counts(t).items())) for t in texts]]

    words = map_columns(hit.select("mark", "text"), ["mark", "text"], "mark int, words string", make)
    return sorted({(r["mark"], r["words"]) for r in words.toLocalIterator()})


def fit_toxicity(docs: DataFrame, labels: DataFrame, each: int = 2000, grades: int = 4, bits: int = 20, least: int = 4, ratio: float = 8.0) -> Ordinal:
    """Learn severity grades from 0/1 labels.

    Features are kept when at least ``least`` toxic sample texts have them and their rate among toxic texts is at least ``ratio``
    times that among clean ones. Grade 0 is a clean label; a toxic text's grade grows with the words that carry such
    a feature: up to 2 in a hundred words, up to 3, and so on. Without toxic labels the model says 0.
    """
    sample = labelled_sample(docs, labels, each)
    toxic = np.array([mark for mark, _ in sample], dtype=np.int64)
    none = Ordinal({}, [20.0 + j for j in range(grades - 1)], bits)
    if not toxic.sum() or toxic.all():
        return none
    words = [{w: int(n) for w, n in (line.split(" ") for line in text.split("\n"))} if text else {} for _, text in sample]
    ids = {w: word_features(w, bits) for some in words for w in some}
    counts = np.zeros((2, 1 << bits), dtype=np.int32)
    for mark, some in zip(toxic, words):
        counts[mark, list({f for w in some for f in ids[w]})] += 1
    share = (counts + 0.5) / (np.array([[len(toxic) - toxic.sum()], [toxic.sum()]]) + 1.0)
    kept = np.flatnonzero((counts[1] >= least) & (share[1] >= ratio * share[0]))
    if not len(kept):
        return none
    place = np.full(1 << bits, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    rows, features, values, severity = [], [], [], np.zeros(len(sample), dtype=np.int64)
    for i, some in enumerate(words):
        total, marked = sum(some.values()), 0
        for w, n in some.items():
            found = [place[f] for f in ids[w] if place[f] >= 0]
            marked += n * bool(found)
            rows += [i] * len(found)
            features += found
            values += [n * scale(total)] * len(found)
        if toxic[i]:
            severity[i] = 1 + sum(100 * marked > cut * total for cut in range(2, grades))
    weights, cuts = fit_ordinal(np.array(rows, dtype=np.int64), np.array(features, dtype=np.int64), np.array(values), severity, len(kept), grades)
    return Ordinal(dict(zip(kept.tolist(), weights.tolist())), cuts.tolist(), bits)


class Grader:
    """Scores of texts under a model; the weight of each word is worked out once."""

    def __init__(self, model: Ordinal, most: int = 300_000):
        self.model, self.most, self.known = model, most, {}
        self.cuts = np.array(model.thresholds)

    def weight(self, word: str) -> float:
        if word not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = self.model.word_weight(word)
        return self.known[word]

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(severity > j) for every text and threshold j."""
        score = np.zeros(len(texts))
        for i, text in enumerate(texts):
            counts = word_counts(text)
            found = sorted((w, v * n) for w, n in counts.items() if (v := self.weight(w)))
            score[i] = scale(counts.total()) * sum(v for _, v in found)
        return 1.0 - _sigmoid(self.cuts[None, :] - score[:, None])


def _shared(docs: DataFrame, model: Ordinal):
    return docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))


def grade(docs: DataFrame, model: Ordinal, keys: str = "doc_id bigint", text: str = "text") -> DataFrame:
    """``keys`` with ``toxic`` (P(severity > 0) of a half or more), ``severity`` (likeliest grade), ``expected_severity`` and ``p_toxic``.

    Every word of the whole text counts. Null and empty texts have no feature; repeated rows get equal answers.
    """
    shared = _shared(docs, model)
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        grader = Grader(Ordinal(*shared.value))

        def work(*columns):
            above = grader.above(columns[-1])
            ones, none = np.ones((len(above), 1)), np.zeros((len(above), 1))
            chance = -np.diff(np.concatenate([ones, above, none], axis=1), axis=1)
            return [*columns[:-1], above[:, 0] >= 0.5, chance.argmax(axis=1).astype(np.int32), above.sum(axis=1), above[:, 0]]

        return work

    return map_columns(docs, [*names, text], f"{keys}, toxic boolean, severity int, expected_severity double, p_toxic double", make)


def without_toxic(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not call toxic."""
    shared = _shared(docs, model)

    def make():
        grader = Grader(Ordinal(*shared.value))
        return lambda texts: (grader.above(texts)[:, 0] < 0.5).tolist()

    return keep_rows(docs, text, make)


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    graded = grade(docs, fit_toxicity(docs, labels))
    return graded.select("doc_id", "toxic", "severity", F.round("expected_severity", 6).alias("expected_severity"), F.round("p_toxic", 6).alias("p_toxic"))
