"""Byte-level BPE against the library, periodic runs and whitening against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, runs, whitening
from test_corpus import DOCS, documents

# ---- byte-level BPE -------------------------------------------------------------------------


def rank_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(open(rank_file(), encoding="ascii").read())


def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_file(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


ODD = [
    None, "", " ", "\n\n  \t", "Hello world's  don't  'll 're", "  spaced   out  ", "ΑΣ ²½Ⅷ① 한글 🎉\U0001F1E6", "é́ café\x85\xa0b\x1cc d", "the the the",
    "٠١ᲉꟋ\U00010d70 ࢏౜", "<|endoftext|>", "_a_1_", "lll llll lllll", "a" * 3000, "ab" * 1500, "é" * 700, "😀" * 300,
]


def test_ids_equal_the_library_on_odd_and_random_texts(coder):
    rng = random.Random(1)
    pool = list("ab cdée'stvllr  \n\t\r\x0b\x1c\x85\xa0 ²½Ⅷ①한글🎉́١٢ǅ౜࢏中文!!?.9_")
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(0, 70))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefgh", k=20_000)), "".join(rng.choices(pool, k=20_000))]
    lib = library()
    want = [packed(lib.encode_ordinary(t or "")) for t in texts]
    assert [x for i in range(0, len(texts), 97) for x in coder.encode(texts[i : i + 97])] == want
    assert [coder.encode([t])[0] for t in texts[:50]] == want[:50]
    assert [coder.decode(x) for x in want] == [(t or "").encode() for t in texts]


def test_queue_is_least_rank_then_leftmost_even_where_a_lower_rank_comes_up():
    # 'bc' has a higher rank than 'abc', which only 'bc' makes possible here
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cb": 258, b"abcbc": 259, b"aa": 260, b"aaa": 261, b"xx": 262, b"xxxx": 263}

    def plain(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            made = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not made:
                return packed([ranks[p] for p in parts])
            _, i = min(made)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    pieces = ["".join(rng.choices("abcx", k=rng.randint(1, 40))).encode() for _ in range(400)]
    queue = byte_bpe.RankQueue(ranks)
    assert queue.merge(pieces) == [plain(p) for p in pieces]
    assert [queue.merge([p])[0] for p in pieces] == [plain(p) for p in pieces]
    assert queue.top == 0 and not queue.buckets


def test_settled_characters_have_the_library_classes(coder):
    settled = [chr(c) for c in range(128, 0x2070) if byte_bpe._SETTLED.fullmatch(chr(c))]
    classes = byte_bpe.Classes()
    for c in settled:
        seen = "A" if c.isalpha() else "0" if c.isdigit() else "\t" if c.isspace() else "!"
        assert classes[ord(c)] == seen, hex(ord(c))


def test_store_of_known_pieces_is_emptied_at_its_bound(coder):
    small = byte_bpe.ByteBpe(open(rank_file(), encoding="ascii").read())
    for i in range(30):
        pieces = {f" piece{i}x{j}" for j in range(50)}
        small.learn(pieces, most=40_000)
        assert pieces <= set(small.known) and small.held <= 40_000


def test_round_trip_report(spark):
    df = documents(spark, ODD)
    df = df.unionByName(df.where("doc_id = 4")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = byte_bpe.byte_round_trip(df, rank_file()).collect()
    lib = library()
    for r in rows:
        text = ODD[4 if r["doc_id"] is None else r["doc_id"]] or ""
        ids = lib.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == len(ODD) + 2
    assert byte_bpe.byte_round_trip(documents(spark, []), rank_file()).collect() == []


# ---- periodic runs --------------------------------------------------------------------------


def brute_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 80))]
    for _ in range(rng.randint(0, 3)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words = words[:a] + words[a : a + p] * rng.randint(2, 9) + words[a : a + rng.randint(0, 5)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(3)
    texts = [repetitive(rng) for _ in range(3000)]
    got = [r for i in range(0, len(texts), 50) for r in runs.find_runs(texts[i : i + 50])]
    assert got == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 1000
    assert runs.find_runs(texts[:200], least=10, times=5) == [brute_runs(t, 10, 5) for t in texts[:200]]


def test_runs_of_long_sequences():
    rng = random.Random(4)
    unit = [rng.randrange(5) for _ in range(700)]
    assert runs.find_runs([[0] * 50_000]) == [[(0, 50_000, 1)]]
    assert runs.find_runs([unit * 40 + unit[:300]]) == [[(0, 28_300, 700)]]
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert runs.find_runs([b]) == [[]]  # no four repetitions in a row
    assert runs.find_runs([[], [1], [1, 1, 1, 1, 1], []]) == [[], [], [], []]


def test_words_end_at_ascii_white_space_only():
    assert runs.words_of("a\x1cb\xa0c d e\x0bf\n g") == ["a\x1cb\xa0c d", "e", "f", "g"]
    assert runs.words_of(" \t\r\n\x0c") == runs.words_of(None) == runs.words_of("") == []


def test_run_report(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "one", "x " * 900, "a b a b a b a b c", "\x1c \x1c \x1c \x1c \x1c \x1c"]
    texts += [" ".join(f"w{w}" for w in repetitive(rng)) for _ in range(150)]
    df = documents(spark, texts).withColumns({"runs": F.lit(1), "start": F.lit(2), "length": F.lit(3), "collapsed": F.lit("c")})
    df = df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = runs.run_report(df.repartition(5)).collect()
    assert len(rows) == len(texts) + 2
    changed = 0
    for r in rows:
        i = 5 if r["doc_id"] is None else r["doc_id"]
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if r["doc_id"] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        found = brute_runs(words)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda t: (-t[1], t[0], t[2])) if found else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (None if not found else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert changed > 5
    assert runs.run_report(documents(spark, [])).collect() == []


def test_periodic_runs_keep_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "say it say it say it say it now")], "doc_id bigint, text string")
    row = runs.periodic_runs(df, "doc_id bigint", lambda key, text: runs.words_of(text)).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 8, 2)] and row["collapsed"] == "say it now"


# ---- whitening ------------------------------------------------------------------------------


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    off = n * x - total
    centred = (n * fit - total) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return n, (off**2).sum(axis=1), off / n @ vecs[:, :k] / np.sqrt(values[:k]), values / values.sum()


def vector_table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.withColumns({"x": F.lit(1), "index": F.lit(2), "whitened": F.lit(3), "n": F.lit(4), "_index": F.lit(5)})


@pytest.mark.parametrize("rows, columns", [(1024, 1024), (16, 3)])
def test_whitening_against_numpy(spark, monkeypatch, rows, columns):
    monkeypatch.setattr(whitening, "_ROWS", rows)
    monkeypatch.setattr(whitening, "_COLUMNS", columns)
    monkeypatch.setattr(whitening, "_TOGETHER", 2)
    rng = np.random.default_rng(6)
    good = [[float(np.float32(v)) for v in rng.normal(size=7) * np.arange(1, 8)] for _ in range(90)]
    good += [good[0]] * 60 + [good[5]] * 3  # one vector holds a third of the rows
    table = [(i, v, 0) for i, v in enumerate(good)] + [(7, good[7], 1), (None, good[9], 1)]
    odd = [(900, None), (901, []), (902, [1.0] * 6 + [None]), (903, [float("nan")] + [0.0] * 6), (904, [float("-inf")] * 7), (905, [1.0, 2.0])]
    df = vector_table(spark, table + [(i, v, 0) for i, v in odd])
    got = whitening.whitening_report(df.repartition(4), 5).collect()
    n, deviation, white, share = brute_whitening(good, 5)
    assert len(got) == 5 * len(table)
    at = {i: i for i in range(len(good))} | {None: 9}
    signs = {c: np.sign(sum(r["whitened"] * white[at[r["vec_id"]], c - 1] for r in got if r["component"] == c)) for c in range(1, 6)}
    for r in got:
        i, c = at[r["vec_id"]], r["component"]
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["whitened"] * signs[c] - white[i, c - 1]) < 1e-9
        assert abs(r["explained"] / share[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_rows_or_variation(spark):
    assert whitening.whitening_report(vector_table(spark, [])).collect() == []
    assert whitening.whitening_report(vector_table(spark, [(1, None, 0), (2, [], 0)])).collect() == []
    assert whitening.whitening_report(vector_table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []


def test_components_without_variation_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(20)]
    got = whitening.whitening_report(vector_table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20 and abs(got[0]["explained"] - 1) < 1e-9


def test_index_is_gapless(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("v"))
    assert sorted(r["i"] for r in whitening.indexed(df, "i").collect()) == list(range(1000))
