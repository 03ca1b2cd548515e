"""The corpus operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import cadenza.llm.shingle_join as sj
from cadenza.llm import bpe, fingerprints, language, licences, packing, shards, topk, toxicity, urls
from cadenza.llm.queries import word_tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# column names that operators use themselves
CLASH = {"shard": "x", "size": "y", "n": 1, "ids": 2, "chunk": "z", "length": 0, "score": "s", "host": "h", "_key": 1, "k": 3, "h": 4}


def with_clash(df):
    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def documents(spark, texts, lang=None, clash=True):
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS) if rows else spark.createDataFrame([], DOCS)
    return with_clash(df) if clash else df


TEXTS = [
    None, "", " \n\t", "The and the AND", "the and the and", "Hello wörld's 123 ok!! <|endoftext|> next", "a" * 3000, "x² ½ Ⅷ", "ΑΣ Σ. ǅ İx 한글 🎉",
    "word " * 900, "The and the AND", "it's don't we'll I'm", "é café   b\x1cc", "..!!?? --- _a_b 1234",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def library_ids(texts):
    return [e.ids for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_bpe_equals_the_library_and_decodes(spark):
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(documents(spark, TEXTS), word_tokenizer()).collect()}
    tok = library()
    for i, ids in enumerate(library_ids(TEXTS)):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(documents(spark, []), word_tokenizer()).collect() == []


def test_segment_tree_on_one_long_word_and_side_by_side():
    coder = bpe.Bpe(open(word_tokenizer(), encoding="utf-8").read())
    words = ["a", "ab", "the", "international", "zzzzzzzz", "ééé", "x" * 63, "thetheinging"]
    alone = [np.array(coder.encode_word(w), "<u4").tobytes() for w in words]
    assert coder.encode(words) == alone
    long = "theing" * 2000
    assert np.frombuffer(coder.encode([long])[0], "<u4").tolist() == library_ids([long])[0]


def test_packing_keeps_every_token_once(spark):
    rows = packing.pack_documents(documents(spark, TEXTS + TEXTS), word_tokenizer(), capacity=64).collect()
    ids = [x + [0] for x in library_ids(TEXTS + TEXTS)]
    bins = defaultdict(list)
    seen = defaultdict(int)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(seen) == {i: len(x) for i, x in enumerate(ids)}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(map(len, ids)) // 64) + 1
    assert packing.pack_documents(documents(spark, []), word_tokenizer()).collect() == []


def test_local_search_reaches_what_best_fit_misses():
    counts = {6: 2, 5: 1, 4: 1, 3: 2, 2: 1}  # total 29
    bins = packing.best_fit(counts, 10)
    better = packing.local_search(bins, 10)
    assert sum(better.values()) == 3 <= sum(bins.values())
    kept = defaultdict(int)
    for pattern, times in better.items():
        assert sum(pattern) <= 10
        for length in pattern:
            kept[length] += times
    assert dict(kept) == counts


@pytest.mark.parametrize("low, high, n", [(400, 900, 300), (600, 800, 300), (500, 1000, 240)])
def test_local_search_goes_on_when_the_emptiest_bin_is_stuck(low, high, n):
    counts = dict(Counter(np.random.default_rng(0).integers(low, high + 1, n).tolist()))
    first = packing.best_fit(counts, 2048)
    better = packing.local_search(first, 2048)
    kept = Counter()
    for pattern, times in better.items():
        assert sum(pattern) <= 2048
        for length in pattern:
            kept[length] += times
    assert kept == counts and sum(better.values()) < sum(first.values())
    if sum(better.values()) > -(-sum(k * v for k, v in counts.items()) // 2048):
        open_bins = sorted((p for p in better.elements() if sum(p) < 2048), key=sum)
        assert all(packing.exchange(a, b, 2048 - sum(b)) is None for i, a in enumerate(open_bins) for b in open_bins[i + 1 :])


def test_exchange_prefers_the_fullest_outcome():
    assert packing.exchange((3, 2), (6,), 4) == ((3,), ())
    assert packing.exchange((5,), (4, 4), 1) == ((5,), (4,))
    assert packing.exchange((3, 3), (5, 4), 1) in (((3, 3), (5,)), None)
    assert packing.exchange((5,), (5, 4), 0) is None


def brute_winnow(hashes, window):
    window = min(window, len(hashes))
    picked = []
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        at = max(j for j, v in enumerate(part) if v == min(part)) + i
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked


def test_winnowing_takes_the_rightmost_least(spark):
    rng = np.random.default_rng(1)
    for n in (1, 3, 8, 40):
        hashes = rng.integers(0, 5, n).astype(np.uint64)
        got, at = fingerprints.winnow(hashes, 6)
        assert at.tolist() == brute_winnow(hashes.tolist(), 6) and got.tolist() == hashes[at].tolist()


def test_equal_runs_have_equal_hashes_wherever_they_stand():
    powers = fingerprints.Powers()
    run = "a passage that both of these texts share, word for word, and it is long enough"
    one, two = fingerprints.gram_hashes("xyz " + run, 12, powers), fingerprints.gram_hashes("other start " * 9 + run + " end", 12, powers)
    assert set(one[4:].tolist()) <= set(two.tolist())
    a, b = fingerprints.winnow(one, 16)[0], fingerprints.winnow(two, 16)[0]
    assert set(a.tolist()) & set(b.tolist())  # the run is longer than 12 + 16 - 1


def test_edited_report_follows_the_id_order(spark):
    texts = [t if t is None else t * 2 for t in TEXTS] + ["Zusätzlich 🎉 text " * 20]
    df = documents(spark, texts)
    df = df.unionByName(df.where("doc_id = 3"))  # a repeated row counts once
    got = {r["doc_id"]: r for r in fingerprints.edited_report(df.repartition(3), chunks=4).collect()}
    plain = [t or "" for t in texts]
    assert len(got) == len(plain)
    for i, t in enumerate(plain):
        take = len(t) // 4
        edited = t[: len(t) - take] + plain[(i + 1) % len(plain)][:take]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[3]["fingerprint"] == got[10]["fingerprint"]
    assert fingerprints.edited_report(documents(spark, [])).collect() == []
    one = fingerprints.edited_report(documents(spark, ["only one text"])).collect()
    assert one[0]["near_next"] == 1.0


def test_shards_are_near_equal_gapless_and_keep_groups(spark):
    texts = ["copy of one text"] * 60 + [None, ""] + [f"text number {i} " * (i % 9 + 1) for i in range(300)]
    rows = shards.shard_report(documents(spark, texts).repartition(5), 4).collect()
    load, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[t].add(r["shard"])
    assert len(rows) == len(texts) and set(load) == {0, 1, 2, 3}
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(h) - 1 for h in homes.values()) <= 3  # at most one group per border is split
    assert shards.shard_report(documents(spark, [])).collect() == []
    assert [r["slot"] for r in shards.shard_report(documents(spark, ["one"])).collect()] == [0]


def test_one_text_with_most_rows_is_split(spark):
    rows = shards.shard_report(documents(spark, ["hot text here"] * 400 + ["a", "b"]), 4).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in rows]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 28


PAGES = [
    (0, "http://A.B.Example.COM/en/7198#top"), (1, "https://x.com/en/"), (2, "https://com/en/x?y"), (3, "http://example.net/de/8"), (4, "http://s.example.net/de/7"),
    (5, None), (6, "no scheme"), (7, "http://example.org?x=/es/"), (8, "http://www.example.org/es/1"), (8, "http://www.example.org/es/1"), (9, "http://notexample.com.de/en/"), (10, "ftp://host/" + "p" * 5000), (11, "://"),
]


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_against_brute_force(spark):
    from cadenza.llm.queries import URL_RULES

    rules = spark.createDataFrame(URL_RULES + [(None, "/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "path": F.lit(3), "part": F.lit(4)})
    got = sorted(tuple(r) for r in urls.judge_urls(pages, rules).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    want = sorted((i, h, p, r or "-", v) for i, (h, p, r, v) in ((i, brute_url(u, URL_RULES)) for i, u in PAGES))
    assert got == want
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).collect() == []


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(120)]
    vectors[7] = (7, vectors[3][1])
    vectors[8] = (8, vectors[3][1])  # ties
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, []), (205, [0.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<double>").withColumns({"id": F.lit(1), "x": F.lit(2), "block": F.lit(3)})
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0 or vec_id = 3"), 4, block_rows=32, query_rows=2).collect())
    good = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in vectors + [(205, [0.0] * 5)]}
    want = []
    for q in (0, 3, 100):
        best = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0), 4).collect() == []


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("hot", [64, 1])
def test_near_classes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sj, "_HOT", hot)
    monkeypatch.setattr(sj, "_CROWD", hot)
    monkeypatch.setattr(sj, "_CELL", max(2, hot))
    monkeypatch.setattr(sj, "_BLOCK", 400)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, 60)) for _ in range(3)]
    texts = [None, "", "  ", "one", "ONE", "two words", "a b c", "a b d"]
    for b in base:
        for _ in range(18):
            t = list(b)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                t[at] = str(rng.choice(words))
            texts.append(" ".join(t))
    texts += texts[-2:] + [" ".join(base[0] + ["tail"] * 3)]
    df = documents(spark, texts)
    for k, percent in ((3, 90), (5, 80)):
        got = sorted(tuple(r) for r in sj.near_classes(df, k, percent).collect())
        assert got == brute_components(texts, k, percent)


def test_near_classes_of_an_empty_table(spark):
    assert sj.near_classes(documents(spark, []), 3, 90).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in sj.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abracadabra arabic"
    states = language.suffix_automaton(text)

    def accepts(word):
        at = 0
        for c in word:
            if c not in states[at]:
                return False
            at = states[at][c]
        return True

    inside = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(map(accepts, inside)) and not any(accepts(w) for w in ("abrab", "cada ", "z", "aa"))


def test_phrases_equal_a_plain_greedy_parse():
    samples = {"x": ("the cat sat on the mat", 1), "y": ("el gato en la casa", 1)}
    parser = language.Parser(samples)
    text = "the gato sat zz en the mata"
    for j, name in enumerate(parser.languages):
        i = n = 0
        while i < len(text):
            m = 1
            while i + m < len(text) and text[i : i + m + 1] in samples[name][0]:
                m += 1
            i, n = i + m, n + 1
        assert parser.phrases([text])[0, j] == n and parser.phrases([""])[0, j] == 0


def test_language_learns_and_says_und(spark):
    data = {"en": "the house and the garden with the children ", "fr": "la maison et le jardin avec les enfants "}
    rows = [(i, data[l] * (1 + i % 3), l, "s", 0) for i, l in enumerate(["en", "fr"] * 30)]
    rows += [(100, None, "en", "s", 0), (101, "123 !!", "fr", "s", 0), (102, "", None, "s", 0), (103, "THE CHILDREN", None, "s", 0), (103, "THE CHILDREN", None, "s", 0), (None, "les enfants", "fr", "s", 0)]
    got = language.identify_documents(with_clash(spark.createDataFrame(rows, DOCS))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang_pred"] == ["en", "fr"][i % 2] and 0 <= by[i]["score"] <= 1 for i in range(60))
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102)) and by[103]["lang_pred"] == "en"
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    assert language.identify_documents(documents(spark, [])).collect() == []
    assert {r["lang_pred"] for r in language.identify_documents(documents(spark, ["nothing learned"], None)).collect()} == {"und"}


def test_toxicity_finds_marked_words_and_orders_grades(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    texts, marks = [], []
    for i in range(240):
        t = list(rng.choice(words, 60))
        if i % 4 == 0:
            for at in range(1 + i // 4 % 4):
                t[at * 7] = ["nastyx", "vilewordy"][at % 2]
        texts.append(" ".join(t))
        marks.append((i, int(i % 2), int(i % 4 == 0)))
    texts += [None, "", "nastyx vilewordy nastyx vilewordy " * 3]
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade_documents(documents(spark, texts), labels).collect()}
    assert [got[i]["toxic"] for i in range(240)] == [i % 4 == 0 for i in range(240)]
    assert not got[240]["toxic"] and not got[241]["toxic"]
    assert got[242]["expected_severity"] > got[0]["expected_severity"] > got[1]["expected_severity"]
    assert not any(r["toxic"] for r in toxicity.grade_documents(documents(spark, texts), labels.limit(0)).collect())
    assert toxicity.grade_documents(documents(spark, []), labels).collect() == []


def test_ordinal_gradient_descends_to_known_order():
    grades = np.array([0] * 20 + [1] * 20 + [2] * 20)
    values = np.concatenate([np.zeros(20), np.ones(20), 2 * np.ones(20)])
    weights, cuts = toxicity.fit_ordinal(np.arange(60), np.zeros(60, dtype=int), values, grades, 1, 3)
    assert weights[0] > 1 and cuts[0] < cuts[1] and cuts[0] < weights[0] < cuts[1]


GPL = """    This program is free software{mark} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{sep} either version {v} of the License, or
    (at your option) any later version.
"""
WARRANTY = """
    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
APACHE_REST = """You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
MIT_NOTICE = """
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
# one text per rule, in the order of RULES
WRAPPED = [
    APACHE + APACHE_REST, APACHE, BSD + BSD_ENDORSE + AS_IS, BSD + AS_IS,
    GPL.format(mark=":", sep=",", v=3) + WARRANTY, GPL.format(mark=":", sep=",", v=3), GPL.format(mark=";", sep=";", v=2) + WARRANTY, GPL.format(mark=";", sep=";", v=2),
    MIT + MIT_NOTICE, "Released under\nthe MIT License.", MIT, "Licensed under the Apache\nLicense, Version 2.0", "This work is licensed under the GNU General Public License, version\n3.",
    "Licensed under CC\nBY-NC 4.0.", "Licensed under CC BY\n4.0.", "Licensed under\nCC BY-SA 4.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
]


def test_full_wrapped_texts_of_every_rule(spark):
    assert len(WRAPPED) == len(licences.RULES)
    forms = [lambda t: "My project\nCopyright (c) 2020 A B\n" + t, lambda t: "\n".join(f" * {line}" for line in t.split("\n")), lambda t: t.replace("\n", "\r\n"), lambda t: re.sub(r"\s+", "\n", t)]
    known = licences.default_sentences(spark)
    texts = [form(t) for form in forms for t in WRAPPED]
    # each rule alone, so that a shorter one cannot stand in for it
    found = {r["doc_id"]: r["sentence_ids"] for r in licences.scan_licences(documents(spark, texts), known, licences.RULES).collect()}
    for i in range(len(texts)):
        assert licences.rule_patterns(licences.RULES)[i % len(WRAPPED)][1] in found[i], texts[i]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(documents(spark, WRAPPED), known, licences.RULES).collect()}
    assert got == {i: name for i, (name, _) in enumerate(licences.RULES)}
    lettered = re.sub(r"([123])\. ", r"(\1) ", BSD + BSD_ENDORSE)
    assert [r["licences"] for r in licences.scan_licences(documents(spark, [lettered]), known, licences.RULES).collect()] == ["BSD-3-Clause"]


def test_licences_follow_rule_order(spark):
    texts = [
        "Code.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.", "Released under the MIT License.", "none here", None, "",
        "Licensed under CC BY-NC 4.0. Other words. Released under the MIT license!\nreleased under the mit license", "Released under the MIT Licensee.",
        "This program is free software: you can redistribute it", "x. " * 3000 + "This work is licensed under the GNU General Public License, version 3.",
    ]
    df = documents(spark, texts).withColumns({"at": F.lit(1), "sentence": F.lit(2), "seq": F.lit(3)})
    df = df.unionByName(df.where("doc_id = 1"))
    got = {r["doc_id"]: r for r in licences.scan_licences(df, licences.default_sentences(spark), licences.RULES).collect()}
    assert {i: r["licences"] for i, r in got.items()} == {0: "Apache-2.0", 1: "MIT", 5: "CC-BY-NC-4.0 MIT", 8: "GPL-3.0-only"}
    assert got[0]["sentence_ids"] == "<apache_head><apache_comply>" and got[5]["sentence_ids"] == "<cc_by_nc_4>~<mit_release><mit_release>" and got[1]["n_sentences"] == 1
    assert licences.scan_licences(documents(spark, []), licences.default_sentences(spark), licences.RULES).collect() == []
