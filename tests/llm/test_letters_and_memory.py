"""Letters by Unicode category, automata over wide alphabets, and one operator's tables at a time."""

import random
import sys
import tracemalloc

import numpy as np
from test_corpus import DOCS

from cadenza.llm import common, language


def test_only_letters_and_their_marks_count():
    assert language.letters_only("² ½ ① Ⅳ 12 _ !") == ""
    assert language.letters_only("Ab1c d_e x²y") == "ab c d e x y"
    assert language.letters_only("नमस्ते ภาษาไทยก็ é") == "नमस्ते ภาษาไทยก็ é"


def test_texts_without_letters_are_undetermined(spark):
    rows = [(i, "the house and the garden " * 3, "en", "s", 0) for i in range(20)] + [(100 + i, t, None, "s", 0) for i, t in enumerate(["²", "① ½", "Ⅳ", "12 !", "٣"])]
    got = {r["doc_id"]: r for r in language.identify_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in range(100, 105))
    assert all(got[i]["lang_pred"] == "en" for i in range(20))


def plain_phrases(sample, text):
    i = n = 0
    while i < len(text):
        m = 1
        while i + m < len(text) and text[i : i + m + 1] in sample:
            m += 1
        i, n = i + m, n + 1
    return n


def test_sparse_moves_equal_dense_ones_and_a_plain_parse(monkeypatch):
    rng = random.Random(1)
    samples = {"a": ("".join(rng.choices("abcd ", k=400)), 1), "b": ("".join(rng.choices("cdefg ", k=300)), 2)}
    texts = ["".join(rng.choices("abcdefgxyz ", k=rng.randint(0, 90))) for _ in range(200)]
    dense = language.Parser(samples).phrases(texts)
    monkeypatch.setattr(language, "_DENSE", 0)
    sparse = language.Parser(samples)
    assert all(isinstance(m, language.Sparse) for m in sparse.moves)
    assert (sparse.phrases(texts) == dense).all()
    assert [[plain_phrases(samples[k][0], t) for k in ("a", "b")] for t in texts] == dense.tolist()


def test_three_thousand_ideographs_take_little_memory():
    rng = random.Random(2)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    samples = {"zh": ("".join(rng.choices(signs, k=40_000)), 1), "en": ("the house and the garden " * 1600, 1)}
    tracemalloc.start()
    parser = language.Parser(samples)
    found = parser.judge(["".join(rng.choices(signs, k=500)), "the garden and the house"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert [f[0] for f in found] == ["zh", "en"]


def test_one_operators_tables_at_a_time(monkeypatch):
    monkeypatch.setattr(sys, "_cadenza_llm", {}, raising=False)
    first = common.per_process("one", lambda: np.zeros(3))
    assert common.per_process("one", lambda: None) is first
    common.per_process("two", lambda: "x")
    assert list(sys._cadenza_llm) == ["two"]
