"""Best of a batch by one reading: equal to the ranking of all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.functions.vectors import dot
from docfathom.operators import products, scan
from docfathom.operators import retrieval as R

WORDS = ["alpha", "beta", "al", "c++", "noñe", "什么是搜索", "搜索引擎", "eta.x", "的", "Beta", "gamma,", "e"]


def test_lexical_best_equals_the_ranking_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(f"d{i}", i, text(2), f"/p/{i % 9}/", [text(1)], [text(1)], str(rng.choice(["定义", "x"])), text(int(rng.integers(1, 12))) + str(rng.choice([" 是一种", ""]))) for i in range(90)]
    rows += [(f"e{i}", 100 + i, "alpha", "/p/1/", ["al"], [], "", "alpha beta") for i in range(30)]  # ties
    chunks = spark.createDataFrame(rows, "id string, position long, title string, url string, tags array<string>, categories array<string>, section string, content string")
    asked = [(1, "alpha beta", "site", ""), (2, "什么是搜索引擎", "page_summary", "/p/3/"), (3, "", "site", ""), (4, "c++ e eta.x", "page", "/p/1/"), (5, "alpha", "site", None)]
    questions = spark.createDataFrame(asked, "query_id long, question string, mode string, page_url string")
    want = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 7)) for r in R.ranked(R.bm25(chunks, questions)).collect()}
    monkeypatch.setattr(scan, "CELLS", 200)  # several pieces and cuts
    got = R.bm25_best(chunks, questions)
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 7)) for r in got.collect()} == want
    texts = chunks.select("id", "position", X.normalized(F.col("content")).alias("b"))
    pairs = texts.crossJoin(questions).select("query_id", "id", "position", X.coverage(X.question_terms(F.col("question")), F.col("b")).alias("score")).filter("score > 0")
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    assert key(R.covered(chunks, questions)) == key(pairs)
    assert key(R.ranked(R.covered(chunks, questions, k=4, floor=0.4), 4)) == key(R.ranked(pairs.filter("score >= 0.4"), 4))


def test_products_equal_all_pairs_with_copies_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = [x.tolist() for x in rng.normal(size=(120, 5)).astype(np.float32)]
    v += [v[0]] * 40 + [[1e30] * 5, [float("nan")] * 5, [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], None, [0.0] * 5]
    rows = spark.createDataFrame([(f"v{i}", i, x) for i, x in enumerate(v)], "id string, position long, values array<float>")
    queries = rows.select(F.col("position").alias("query_id"), "values")
    for name, value in (("ROWS", 40), ("LEAST", 10), ("ASKED", 7), ("TILE", 16), ("PAIRS", 30)):
        monkeypatch.setattr(products, name, value)
    for floor in (-2.0, 0.17):
        pairs = rows.crossJoin(queries.select("query_id", F.col("values").alias("q"))).select("query_id", "id", "position", dot(F.col("values"), F.col("q")).alias("score")).filter(F.col("score") >= floor)
        key = lambda df: sorted((r["query_id"], r["rank"], r["id"], repr(r["score"])) for r in df.collect())
        plan = R.dense(rows, queries, 6, floor)
        assert key(plan) == key(R.ranked(pairs, 6))
    regular = R.dense(rows.limit(100), queries.limit(100), 6)
    assert "NestedLoopJoin" not in regular._jdf.queryExecution().toString()  # no product of all rows
