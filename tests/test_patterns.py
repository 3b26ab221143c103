"""Many patterns in many texts, against plain searches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docfathom.operators import evidence, patterns


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    out = [(i, "".join(rng.choice("ab中é😀 ") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    return [*out, (100, None), (100, ""), (101, "aaaa"), (101, "aaaa"), (None, "abab")]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(8)
    return ["", "a", "aa", "ab", "aba", "中é", "😀", "zz", "aa", *("".join(rng.choice("ab中é😀 ") for _ in range(rng.randint(2, 4))) for _ in range(60))]


def places(text: str | None, p: str) -> list[int]:
    return [i for i in range(len(text or "")) if p and (text or "").startswith(p, i)]


@pytest.mark.parametrize("block", [10**6, 7])
def test_every_place(spark, texts, names, block, monkeypatch):
    monkeypatch.setattr(patterns, "PATTERNS", block)
    rows, wanted = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(n,) for n in names], "p string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted((tuple(r) for r in patterns.occurrences(rows, "t", ["k"], wanted, "p").collect()), key=key)
    assert got == sorted(((k, p, i) for k, t in texts for p in set(names) for i in places(t, p)), key=key)
    first = sorted((tuple(r) for r in patterns.occurrences(rows, "t", ["k"], wanted, "p", first=True).collect()), key=key)
    assert first == sorted(((k, p, places(t, p)[0]) for k, t in texts for p in set(names) if places(t, p)), key=key)


def test_titles_in_turn_longest_first(spark):
    rows = spark.createDataFrame([(1, "比较 spark sql 与 spark，以及 spark sql 入门"), (2, "aaaaa"), (3, "none")], "k long, t string")
    titles = spark.createDataFrame([("spark",), ("spark sql",), ("spark sql 入门",), ("aa",), ("sql",)], "title string")
    got = {(r["k"], r["place"]): (r["title"], r["start"]) for r in evidence.separate_mentions(rows, titles, "t", ["k"]).collect()}
    assert got == {(1, 0): ("spark sql", 3), (1, 1): ("spark", 15), (1, 2): ("spark sql 入门", 24), (2, 0): ("aa", 0), (2, 1): ("aa", 2)}
    once = {(r["k"], r["nth"]): r["title"] for r in evidence.mentioned_titles(rows, titles, "t", ["k"]).collect()}
    assert once == {(1, 0): "spark sql", (1, 1): "spark", (1, 2): "spark sql 入门", (2, 0): "aa"}


def test_known_titles_are_removed(spark):
    rows = spark.createDataFrame([(1, "决策树 和 决策 树林"), (2, "x  y"), (3, None)], "k long, t string")
    known = spark.createDataFrame([(1, "决策"), (1, "决策树"), (2, ""), (4, "x")], "k long, p string")
    assert {r["k"]: r["rest"] for r in patterns.without(rows, "t", ["k"], known, "p").collect()} == {1: "和 树林", 2: "x y", 3: ""}


def test_comparison_targets(spark):
    said = ["请比较一下决策树", "《随机森林》有什么区别？", "对比 SVM 的优缺点", "支持向量机哪个更适合小数据？", "，线性回归。", None]
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", patterns.comparison_target(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == ["决策树", "随机森林", "SVM 的优缺点", "支持向量机", "线性回归", ""]


def test_no_patterns_and_no_nested_loop(spark, texts):
    rows = spark.createDataFrame(texts, "k long, t string")
    none = spark.createDataFrame([], "p string")
    assert patterns.occurrences(rows, "t", ["k"], none, "p").count() == 0
    found = patterns.occurrences(rows, "t", ["k"], rows.filter("k < 9").select(F.col("t").alias("p")), "p")
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
