from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docfathom.operators import site_search
from docfathom.operators import evaluation, joins, selection


def test_prose_lines(spark):
    lines = ["这是一段说明文字。", "import 模块名称", "short 中", "no letters of that kind", "  返回值是一个列表 ", "# 标题文字很长的一行", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", F.coalesce(selection.is_prose(F.col("line")), F.lit(False)).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [True, False, True, False, True, False, False]


def test_retried_queries_match(spark):
    df = spark.createDataFrame([(["What is  X 相关内容"],), (["what is x"],), (["what is xy"],), ([],)], "m array<string>")
    assert [r[0] for r in df.select(selection.matches_subquery(F.col("m"), F.lit("What is X"))).collect()] == [True, True, False, False]


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("a", 6, 9.0)], "k string, t int, v double")
    got = {r["id"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", "v").collect()}
    assert got == {10: None, 11: 3.0, 12: None}


def test_spans_of_several_buckets_meet_once(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 9.5), (3, 10.0), (4, -3.0)], "id int, at double")
    spans = spark.createDataFrame([(7, -5.0, 10.0)], "s int, a double, b double")
    assert sorted(r["id"] for r in joins.within(points, spans, "at", "a", "b", 2.0).collect()) == [1, 2, 4]


def test_a_step_without_a_post_is_an_error(spark):
    steps = spark.createDataFrame([("x",), ("y",)], "slug string")
    posts = spark.createDataFrame([("x", 3), ("x", 2)], "slug string, post int")
    assert joins.steps_to_posts(steps.filter("slug = 'x'"), posts, "slug", "post").collect()[0]["post"] == 2
    with pytest.raises(Exception, match="no post for step y"):
        joins.steps_to_posts(steps, posts, "slug", "post").collect()


def test_rates_of_nothing_are_null_and_costs_need_a_rate(spark):
    none = spark.createDataFrame([(True, False, False, False, True, 5.0)], "ok boolean, answerable boolean, covered boolean, unsafe boolean, passed boolean, ms double")
    row = evaluation.production_summary(none).collect()[0]
    assert row["coverage"] is None and row["success_rate"] == 1.0 and row["p95"] == 5.0
    got = spark.range(1).select(evaluation.cost(F.lit(1234), F.lit(0.5)).alias("a"), evaluation.cost(F.lit(1234), F.lit(None).cast("double")).alias("b")).collect()[0]
    assert (got["a"], got["b"]) == (0.000617, None)


def test_unknown_checks_fail(spark):
    rows = spark.createDataFrame([(1, None), (2, 3)], "id int, n int")
    assert [r["passed"] for r in evaluation.checked_cases(rows, {"big": F.col("n") > 2}).orderBy("id").collect()] == [False, True]


def test_a_latest_null_is_the_value(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 3), (3, "b", 10)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 5, None)], "k string, t int, v double")
    assert {r["id"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", "v").collect()} == {1: None, 2: 1.0, 3: None}


def test_wide_spans_go_to_few_buckets(spark):
    spans = [(i, float(a), float(a + n)) for i, (a, n) in enumerate([(0, 1), (0, 0), (3, 9), (-50, 1000), (7, 100000), (8, 8), (16, 64)])]
    points = [(i, x / 2) for i, x in enumerate(range(-200, 400))] + [(1000, 99999.0), (1001, 100007.0)]
    got = joins.within(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, a double, b double"), "at", "a", "b", 1.0)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if a <= x < b)


def test_search_words_are_literal(spark):
    items = spark.createDataFrame([(1, "It's what it's"), (2, "a\\b"), (3, "none")], "id long, content string")
    got = {r["id"]: (r["hit_words"], r["hits"]) for r in site_search.search(items, ["it's", "\\", "a"], 10).collect()}
    assert got == {1: (2, 3), 2: (2, 2)}


def test_slices_show_hits_that_do_not_overlap():
    n, shown = site_search.hits("aaa b xaaa", site_search.keywords("AA-b"))
    assert (n, shown) == (3, [(0, "aa"), (4, "b"), (7, "aa")])
    n, shown = site_search.hits("aaa b", site_search.keywords("aa b"))
    assert (n, shown) == (3, [(0, "aa"), (4, "b")])  # the whole search overlaps a hit before it
    text = "k" + "." * 100 + "k k" + "." * 76 + "kk"
    _, shown = site_search.hits(text, ["k"])
    assert site_search.slices(shown, len(text), "k") == [(81, 181, 3, [(101, 102), (103, 104), (180, 181)]), (0, 80, 1, [(0, 1)]), (161, 182, 1, [(181, 182)])]


def test_search_over_titles_and_contents(spark):
    items = spark.createDataFrame([(1, "Deep work", "a b"), (2, None, "deep work, deep"), (3, "x", None), (4, "", "Deep"), (5, "Work", "deep"), (5, "Work", "deep")], "id long, title string, content string").withColumn("hits", F.lit(0))
    searches = spark.createDataFrame([(1, " Deep Work "), (2, None), (3, ""), (4, "none")], "search_id int, search string")
    got = [(r["id"], r["place"], r["hits"], r["whole_hits"], len(r["title_hits"]), len(r["slices"])) for r in site_search.ranked(items, searches, 10).orderBy("place").collect()]
    assert got == [(2, 1, 4, 1, 0, 1), (1, 2, 3, 1, 1, 0), (5, 3, 2, 0, 1, 1), (5, 4, 2, 0, 1, 1), (4, 5, 1, 0, 0, 1)]
    assert site_search.ranked(items.limit(0), searches, 10).count() == 0 and site_search.ranked(items, searches.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        site_search.ranked(items, spark.range(2001).select(F.col("id").alias("search_id"), F.lit("a").alias("search")), 10)


def test_a_task_sends_the_best_of_each_search_only():
    arrow = pa.schema([("id", pa.int64()), ("search_id", pa.int64()), ("hits", pa.int64()), ("whole_hits", pa.int64()), ("title_hits", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("slices", pa.list_(pa.struct([("start", pa.int64())])))])
    texts = [("", "a " * (i % 7) + "a b" * (i % 3 == 0)) for i in range(50)]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "title": t, "content": c} for i, (t, c) in enumerate(texts)][k::2]) for k in range(2)]
    known = [(s, w, site_search.keywords(w)) for s, w in enumerate(["a b", "a", "none", "aa"])]
    rows = [r for b in site_search.best(known, 3, 1, arrow)(iter(batches)) for r in b.to_pylist()]
    want = []
    for s, whole, words in known:
        each = [(sum(w == whole for _, w in site_search.hits(c, words)[1]), site_search.hits(c, words)[0], i) for i, (_, c) in enumerate(texts)]
        want += [(s, *x) for x in sorted((x for x in each if x[1]), reverse=True)[:3]]
    assert sorted((r["search_id"], r["whole_hits"], r["hits"], r["id"]) for r in rows) == sorted(want) and len(rows) == 6


def test_hash_embedding_equals_a_plain_sum_of_features():
    from docfathom.operators import embedding as E

    provider = E.LocalProvider(16, {"c": ["ab"]})
    text = "ab ab ab a.b 你好吗 ab"
    v = [0.0] * 16
    for feature, weight in provider.features(text).items():
        place, sign = E._place(feature)
        v[place % 16] += sign * weight
    norm = sum(x * x for x in v) ** 0.5
    assert provider.embed_documents([text, ""]) == [pytest.approx([x / norm for x in v], abs=1e-8), [0.0] * 16]
    assert provider.features("ab ab ab")["term:ab"] == 0.0 + E.TERM_WEIGHT + E.TERM_WEIGHT + E.TERM_WEIGHT
