"""Licence scans by sentence rules.

A text is cut at line breaks and end marks, and the normalised pieces are looked up among known licence sentences. A
sentence may run over several pieces, so it is found however its lines are wrapped. What remains of a document is a
sequence of sentence identifiers with their places; ordered rules over identifiers then name the licences. A rule's sentences must follow one another; the first rules take their sentences before later ones look.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import map_columns, per_process
from cadenza.session import small_table

# Publicly known licence sentences by identifier.
SENTENCES = [
    ("apache_head", "Licensed under the Apache License, Version 2.0"),
    ("apache_head", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache_comply", "you may not use this file except in compliance with the License"),
    ("apache_obtain", "You may obtain a copy of the License at"),
    ("apache_obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_obtain", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_disclaim", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("apache_disclaim", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache_limits", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit_release", "Released under the MIT License"),
    ("mit_release", "Licensed under the MIT License"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl3_work", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl3_either", "either version 3 of the License, or (at your option) any later version"),
    ("gpl2_either", "either version 2 of the License, or (at your option) any later version"),
    ("gpl_warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl_warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("bsd_redistribute", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd_retain", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd_reproduce", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd_endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc_by_nc_4", "Licensed under CC BY-NC 4.0"),
    ("cc_by_4", "Licensed under CC BY 4.0"),
    ("cc_by_sa_4", "Licensed under CC BY-SA 4.0"),
    ("mpl_2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

# Licence names by the sequence of sentences that states them; earlier rules take precedence.
RULES = [
    ("Apache-2.0", ("apache_head", "apache_comply", "apache_obtain", "apache_disclaim", "apache_limits")),
    ("Apache-2.0", ("apache_head", "apache_comply")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_retain", "bsd_reproduce", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_retain", "bsd_reproduce")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_either", "gpl_warranty")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_either")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_either", "gpl_warranty")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_either")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_release",)),
    ("MIT", ("mit_grant",)),
    ("Apache-2.0", ("apache_head",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("MPL-2.0", ("mpl_2",)),
]

# A piece ends at a line break, at . ! ? : ; before white space or the end, at ", either" of a licence grant, or after a
# list marker such as "a)" or "(2)" that begins a line.
BREAK = re.compile(rb"[.!?:;]+(?=\s|\Z)|,[^A-Za-z0-9]+(?=either[^A-Za-z0-9]+version)|^(?:[^A-Za-z0-9\n]*)(?:[0-9]{1,2}|[A-Za-z])\)(?=\s)", re.M)
MARKER = re.compile(rb"[0-9]{1,2}|[a-z]")
_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else ord(chr(c).lower()) if 65 <= c <= 90 else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    """Lower case, runs of anything but letters and digits as one blank."""
    return b" ".join(text.translate(_PLAIN).split())


def pieces(text: str) -> list[bytes]:
    """Normalised pieces with a letter or digit, in order."""
    cut = BREAK.sub(lambda m: m[0] + b"\n", text.encode("utf-8", "surrogatepass")).translate(_PLAIN)
    return [b" ".join(words) for line in cut.split(b"\n") if (words := line.split())]


def sentence_starts(sentences: Sequence[tuple[str | None, str | None]]) -> dict[bytes, str | None]:
    """Every run of first words of a known sentence, with the identifier where the sentence is whole."""
    starts: dict[bytes, str | None] = {}
    for sentence_id, sentence in sentences:
        if sentence_id is None or not (words := normalised((sentence or "").encode()).split()):
            continue
        for n in range(1, len(words) + 1):
            starts.setdefault(b" ".join(words[:n]), None)
        whole = b" ".join(words)
        starts[whole] = min(starts[whole] or sentence_id, sentence_id)
    return starts


def found_sentences(parts: Sequence[bytes], starts: dict[bytes, str | None]) -> Iterator[tuple[int, str]]:
    """Place and identifier of the known sentences that begin and end with a piece; the longest one wins.

    A sentence has one place, however many pieces it has, and list markers between sentences have none.
    """
    at = i = 0
    while i < len(parts):
        run, j, end, best = parts[i], i + 1, i, None
        while run in starts:
            if starts[run] is not None:
                end, best = j, starts[run]
            if j == len(parts):
                break
            run, j = run + b" " + parts[j], j + 1
        if best is not None:
            yield at, best
        at += best is not None or not MARKER.fullmatch(parts[i])
        i = max(end, i + 1)


def known_sentences(df: DataFrame, sentences: DataFrame, keys: str = "doc_id bigint", text: str = "text") -> DataFrame:
    """The ``keys`` (a DDL list), ``at`` and ``sentence_id`` for each known sentence of a whole text.

    ``sentences`` has sentence_id and sentence; the list goes to every worker. ``at`` is the place among the document's
    sentences and pieces that have a letter or digit, so neighbours differ by one.
    """
    told = df.sparkSession.sparkContext.broadcast([tuple(r) for r in sentences.select("sentence_id", "sentence").collect()])
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        starts = per_process(f"licences {hash(tuple(told.value))}", lambda: sentence_starts(told.value))

        def work(*columns):
            out: list[list] = [[] for _ in range(len(names) + 2)]
            for *key, value in zip(*columns):
                for found in found_sentences(pieces(value or ""), starts):
                    for column, v in zip(out, (*key, *found)):
                        column.append(v)
            return out

        return work

    return map_columns(df, [*names, text], f"{keys}, at int, sentence_id string", make)


def rule_patterns(rules: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, str]]:
    """Each rule as the text that its sentences make in a document's sequence."""
    return [(name, "".join(f"<{s}>" for s in sequence)) for name, sequence in rules if sequence]


def scan_licences(df: DataFrame, sentences: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences`` for documents with at least one known licence sentence.

    ``sentence_ids`` is the sequence with ``~`` where other sentences lie between; ``licences`` the names of the rules
    that matched, sorted and each once, joined by blanks; null if sentences were found but no rule matched. Null and
    empty texts, and null ids, have none; rows that share a doc_id are told apart by their text's hash only if it differs.
    """
    rows = df.select("doc_id", F.xxhash64("text").alias("h"), "text").where("doc_id is not null")
    found = known_sentences(rows, sentences, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, h bigint")
    # repeated rows give the same places twice; one of each is kept
    per = found.distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("at", "sentence_id"))).alias("seq"))
    before = lambda i: F.col("seq")[i - 1]["at"]
    step = lambda x, i: F.concat(F.when((i > 0) & (x["at"] > before(i) + 1), "~").otherwise(""), F.lit("<"), x["sentence_id"], F.lit(">"))
    rest = per.select("doc_id", F.size("seq").cast("bigint").alias("n_sentences"), F.array_join(F.transform("seq", step), "").alias("sentence_ids"))
    out, left, names = rest.withColumn("_left", F.col("sentence_ids")), F.col("_left"), []
    for i, (name, pattern) in enumerate(rule_patterns(rules)):
        out = out.withColumn(f"_r{i}", F.when(F.contains(left, F.lit(pattern)), F.lit(name))).withColumn("_left", F.replace(left, F.lit(pattern), F.lit("~")))
        names.append(F.col(f"_r{i}"))
    joined = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), " ")
    return out.select("doc_id", "n_sentences", "sentence_ids", F.nullif(joined, F.lit("")).alias("licences"))


def default_sentences(spark) -> DataFrame:
    return small_table(spark, SENTENCES, "sentence_id string, sentence string")
