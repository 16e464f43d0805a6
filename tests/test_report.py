import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.operators import report
from pagemill.plans.tables import numbered, ranked

TEXTS = [("f10", 1, "b b a c"), ("f2", 2, "a a d"), ("f2", 1, "e a b. The The"), ("f10", 2, "a"), ("f10", 3, "")]


@pytest.fixture(scope="module")
def counts(spark):
    pages = spark.createDataFrame(TEXTS, "file_path string, page_no int, text string")
    return report.page_counts(pg.with_overall(pages)).cache()


def as_dict(df):
    return {r.word: r.freq for r in df.collect()}


def test_scopes(counts):
    assert as_dict(report.frequency(counts)) == {"a": 5, "b": 3, "c": 1, "d": 1, "e": 1, "the": 2}
    assert {(r.file_path, r.word): r.freq for r in report.frequency(counts, "file").collect()}[("f2", "a")] == 3
    assert {(r.file_path, r.page_no, r.word): r.freq for r in report.frequency(counts, "page").collect()}[("f10", 1, "b")] == 2


def test_last_page_wins(counts):
    assert as_dict(report.last_wins(counts)) == {"a": 1, "b": 2, "c": 1, "d": 1, "e": 1, "the": 2}


def test_orders(counts):
    seen = report.first_seen(counts)
    words = lambda by: [r.word for r in report.ordered(seen, by).orderBy("rank").collect()]
    assert words("alpha") == ["a", "b", "c", "d", "e", "the"]
    assert words("chron") == ["e", "a", "b", "the", "d", "c"]
    assert words("freq") == ["a", "b", "the", "e", "d", "c"]


def test_lists(counts):
    whole = report.frequency(counts)
    assert as_dict(report.only(whole, ["A", "zz"])) == {"a": 5}
    assert "the" not in as_dict(report.ignored(whole, ["The"]))
    assert as_dict(report.ignored(whole, [])) == as_dict(whole)


@pytest.mark.parametrize(("limit", "parsed"), [("70%", ("percent", 70)), ("150%", ("percent", 100)), ("5+", ("least", 5)), ("12", ("top", 12)), ("junk", ("percent", 100)), ("", ("percent", 100))])
def test_parse(limit, parsed):
    assert report.parse_limit(limit) == parsed


@pytest.mark.parametrize("percent", [0, 1, 7, 14, 38, 50, 55, 77, 99, 100])
def test_percentile_is_a_prefix(counts, percent):
    seen = report.first_seen(counts)
    rows = [(r.word, r.freq) for r in report.ordered(seen, "freq").orderBy("rank").collect()]
    total, before, expected = sum(f for _, f in rows), 0, []
    for w, f in rows:
        if before < math.ceil(percent / 100 * total):
            expected.append(w)
        before += f
    assert sorted(as_dict(report.percentile(seen, percent))) == sorted(expected)


def test_top_and_empty(spark, counts):
    seen = report.first_seen(counts)
    assert as_dict(report.top(seen, 2)) == {"a": 5, "b": 3}
    none = seen.limit(0)
    assert report.limited(none, "70%").count() == report.ordered(none).count() == 0


def test_double_arithmetic():
    assert [p for p in range(1, 101) if math.ceil(p / 100 * 100) == p + 1] == [7, 14, 28, 55, 56]


def test_ranked_and_numbered(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 3 == 0).cast("string").alias("k")).repartition(7)
    assert [r.rank for r in ranked(df, ["x"]).orderBy("x").collect()] == list(range(1, 1001))
    got = {(r.k, r.x): r.n for r in numbered(df, "k", "x", "n", rows_per_group=50).collect()}
    seen = Counter()
    for x in range(1000):
        k = str(x % 3 == 0).lower()
        seen[k] += 1
        assert got[(k, x)] == seen[k]


def test_numbered_rows_move_once_where_counts_are_few(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else str(i % 3)) for i in range(300)], "x long, k string")
    out = numbered(df, "k", "x", "n", rows_per_group=50)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.x: r.n for r in out.collect()}
    keys = {r.x: r.k for r in df.collect()}
    assert got == {x: sum(keys[y] == keys[x] for y in range(x + 1)) for x in range(300)}


def test_limits_within_scopes_against_sorting(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "hot", "hot"]), f"w{i}", rng.choice([1, 1, 1, 2, 3, 9]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "file_path string, word string, freq long, first_seen int")
    for limit in ("7%", "70%", "0%", "100%", "3", "1000", "0", "2+"):
        got = {(r.file_path, r.word) for r in report.limited_within(df, ["file_path"], limit).collect()}
        kind, n = report.parse_limit(limit)
        expected = set()
        for f in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[3]))
            total, before = sum(r[2] for r in mine), 0
            for k, r in enumerate(mine):
                if {"percent": before < math.ceil(n / 100 * total), "top": k < n, "least": r[2] >= n}[kind]:
                    expected.add((f, r[1]))
                before += r[2]
        assert got == expected
    assert report.limited_within(df.limit(0), ["file_path"], "7%").collect() == []


def test_one_file_with_all_pages(spark):
    from pagemill.sources.adapters import pages_from_documents

    docs = spark.range(300).selectExpr("id * 7 as doc_id", "'hot' as source", "concat('t', id) as text")
    pages = pages_from_documents(docs)
    assert [r.page_no_overall for r in pg.with_overall(pages).orderBy("page_no").collect()] == list(range(1, 301))
    some = pg.with_overall(pg.selected(pages, "2 5-6"))
    assert [(r.page_no, r.page_no_overall) for r in some.orderBy("page_no").collect()] == [(2, 1), (5, 2), (6, 3)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_counted_where_they_are(spark):
    pages = spark.createDataFrame(TEXTS, "file_path string, page_no int, text string")
    counts = report.page_counts(pages)
    assert "Exchange" not in plan(counts) and "Exchange" not in plan(report.frequency(counts, "page", first=True))
    assert {(r.word, r.freq, r.first_no) for r in counts.where("file_path = 'f2' and page_no = 1").collect()} == {("e", 1, 0), ("a", 1, 1), ("b", 1, 2), ("the", 2, 3)}
    whole = report.page_counts(pages.withColumn("page_no_overall", F.col("page_no").cast("long")))
    # structs as buffers are no words of memory, and make Spark sort all rows
    assert "SortAggregate" not in plan(report.first_seen(whole)) + plan(report.frequency(whole, "file", first=True))


@pytest.mark.parametrize("limit", ["7%", "28%", "70%", "0%", "100%", "3", "1000", "0", "2+", ""])
def test_limits_of_pages_equal_those_within_scopes(spark, limit):
    pages = spark.createDataFrame([*TEXTS, (None, 1, "x y z x y q"), ("n", 7, None), ("n", 8, "c c b b a a a d e f g h i j k l")], "file_path string, page_no int, text string")
    found = report.frequency(report.page_counts(pages), "page", first=True)
    expected = {tuple(r) for r in report.limited_within(found, ["file_path", "page_no"], limit).drop("first_seen").collect()}
    assert {tuple(r) for r in report.frequency(report.page_counts(pages, limit), "page").collect()} == expected


def test_more_texts_than_are_counted_at_once(spark):
    pages = spark.range(1201).selectExpr("'f' as file_path", "id as page_no", "concat('w', id % 7, ' w', id % 7) as text").coalesce(1)
    assert as_dict(report.frequency(report.page_counts(pages))) == {f"w{k}": 2 * len(range(k, 1201, 7)) for k in range(7)}


def test_corpus_counts_send_on_what_they_hold(spark):
    texts = spark.createDataFrame([("b b a c.",), (None,), ("",), ("A a d",)], "text string").coalesce(1)
    assert as_dict(report.corpus_counts(texts)) == {"a": 3, "b": 2, "c": 1, "d": 1}
    many = spark.range(310_000).selectExpr("concat('w', id, ' w', id, ' x') as text").coalesce(1)
    got = report.corpus_counts(many)
    assert got.count() == 310_001 and as_dict(got.where("freq <> 2")) == {"x": 310_000}
