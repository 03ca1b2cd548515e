"""Names within two edits, whole and without candidates in vain."""

import random
import re

from pyspark.sql import functions as F

from cadenza.operators import joins, lyrics, retrieval
from conftest import rows


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(n, most, letters, seed):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)})


def test_close_names_equal_brute_force(spark):
    left, right = words(90, 6, "abé", 1), words(90, 6, "ab😀😁", 2)
    for depth in (2, 3):
        want = sorted((a, b, e) for a in left for b in right if (e := edits(a, b)) <= depth)
        got = joins.close_names(spark.createDataFrame([(a,) for a in [*left, None]], "a string"), spark.createDataFrame([(b,) for b in [*right, None]], "b string"), depth)
        assert sorted(map(tuple, got.collect())) == want


def test_near_duplicates_and_components_equal_brute_force(spark):
    names = words(60, 7, "abcdefgh", 3) + ["label #101", "label #102", "lable #101", "label101"]
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    pairs = sorted((a, b, e) for a in names for b in names if a < b and (e := edits(a, b)) <= 2)
    assert sorted(map(tuple, retrieval.near_duplicate_names(df, "name").collect())) == pairs
    root = {n: n for n in names}
    for _ in names:
        for a, b, _e in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = retrieval.resolve_entities(df.where("name is not null"), "name")
    assert rows(got, "name") == sorted(root.items())


def test_numbered_names_meet_only_as_near_duplicates(spark):
    """Numbered names of one length: candidates were the square of all names that share a shortened number."""
    names = spark.range(3000).select(F.format_string("label %06d", "id").alias("a"))
    met = joins.substituted(names, names.withColumnRenamed("a", "b")).where("a < b")
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() == met.distinct().count() == met.where(F.levenshtein("a", "b") == F.col("edits")).count()


def test_long_queries_are_scored_where_a_document_lies(spark):
    """Pairs of query and document are summed in the tasks that hold the document: no exchange by both."""
    docs = spark.range(60).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), (F.col("id") * (i + 3) % 7).cast("string")) for i in range(12)]).alias("text"))
    asked = docs.where("id % 10 = 0").select(F.col("id").alias("q"), "text")
    for got in (lyrics.keyword_search(docs, "id", asked, "q", 3), lyrics.similar_lyrics(docs, "id", asked, "q", 3)):
        assert "hashpartitioning(q#" not in "".join(p for p in re.findall(r"hashpartitioning\([^)]*\)", got._jdf.queryExecution().executedPlan().toString()) if "id#" in p)
        assert [r.id for r in got.where("rank = 1").orderBy("q").collect()] == [r.q - r.q // 7 * 7 for r in asked.orderBy("q").collect()]


def test_words_are_counted_where_their_text_lies(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (None, "a a"), (3, "")], "id bigint, text string")
    got = lyrics.term_frequencies(docs, "id")
    assert "hashpartitioning(id#" in (plan := got._jdf.queryExecution().executedPlan().toString()) or "Exchange" not in plan
    assert not re.search(r"hashpartitioning\(id#\d+L?, term#", plan)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "a", 2)]
