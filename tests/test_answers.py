from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docfathom.functions.hashing import hmac_sha256
from docfathom.operators import agent as A
from docfathom.operators import claims as C
from docfathom.operators import tools as T
from docfathom.operators.embedding import LocalProvider, RetryingProvider, ServiceError
from docfathom.sources import connectors as K

CHUNKS = [("c1", "T1", "alpha holds 3 parts and no more"), ("c2", "T2", "beta is a second thing")]
CLAIM = "answer_id string, position int, source_id string, subquestion_id string, text string, quote string, citation_ids array<string>"


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id string, title string, content string")


def test_extractive_claims(spark):
    rows = [
        ("ok", 1, "a", "s", "alpha holds 3 parts", "alpha holds 3 parts", ["c1"]), ("rule", 1, "a", "s", "《T1》：alpha holds", "alpha holds", ["c1"]),
        ("bad", 1, "a", "s", "alpha holds 4 parts", "alpha holds 3 parts", ["c1"]), ("bad", 2, "b", "s", "beta is a", "beta is a", ["c9"]), ("two", 1, "a", "s", "beta is a", "beta is a", ["c1", "c2"]), ("short", 1, "a", "s", "beta", "beta", ["c2"]),
    ]
    df = spark.createDataFrame(rows, CLAIM)
    got = {(r["answer_id"], r["position"]): (r["reason"], r["answer_valid"]) for r in C.extractive(df, chunks(spark)).collect()}
    assert got == {("ok", 1): (None, True), ("rule", 1): ("claim_not_extractive", False), ("bad", 1): ("claim_not_extractive", False), ("bad", 2): ("unknown_or_unselected_citation", False), ("two", 1): ("claim_requires_one_citation", False), ("short", 1): ("invalid_evidence_quote", False)}
    assert {r["answer_id"]: r["answer_valid"] for r in C.extractive(df.filter("answer_id = 'rule'"), chunks(spark), True).collect()} == {"rule": True}


def test_grounded_claims_in_order(spark):
    rows = [
        ("x", 1, "a", "s1", "alpha holds 3 parts", "alpha holds 3 parts", ["c1"]),  # not supported
        ("x", 2, "b", "s1", "alpha holds 3 parts", "alpha holds 3 parts", ["c1"]),  # the same after a rejected one: accepted
        ("x", 3, "c", "s1", "alpha holds 3 parts", "holds 3 parts and", ["c1"]),  # a duplicate of an accepted text
        ("x", 4, "d", "s1", "alpha holds 5 parts", "alpha holds 3 parts", ["c1"]), ("x", 5, "e", "s1", "alpha is not beta", "beta is a second", ["c2"]), ("x", 6, "f", "s9", "beta is a second", "beta is a second", ["c2"]),
        ("y", 1, "a", "s1", "beta is a second", "beta is a second", ["c2"]),
    ]
    assigned = spark.createDataFrame([("x", "s1", "c1"), ("x", "s1", "c2"), ("y", "s1", "c1")], "answer_id string, subquestion_id string, chunk_id string")
    said = spark.createDataFrame([("x", s, s != "a", True, "supported" if s != "a" else "not_entailed") for s in "abcdef"], "answer_id string, source_id string, supported boolean, direct boolean, code string")
    covered = spark.createDataFrame([("x", "s1", True), ("y", "s1", True)], "answer_id string, subquestion_id string, covered boolean")
    out = C.grounded(spark.createDataFrame(rows, CLAIM), chunks(spark), assigned, said, covered)
    got = {(r["answer_id"], r["position"]): r["reason"] for r in out.collect()}
    assert got == {("x", 1): "not_entailed", ("x", 2): None, ("x", 3): "duplicate", ("x", 4): "scope_expansion", ("x", 5): "negation_mismatch", ("x", 6): "unknown_subquestion", ("y", 1): "citation_not_assigned"}
    assert C.answers(out.filter("reason is null")).first()["answer"] == "alpha holds 3 parts [1]"


def test_routes_and_parts(spark):
    rows = [("你好！", False, "direct"), ("A 和 B 的区别", False, "article_compare"), ("解释这段代码", True, "code_explanation"), ("解释这段代码", False, "site_qa"), ("学习路径", False, "learning_path"), ("总结一下", True, "page_summary"), ("推荐几篇文章", False, "related_articles"), ("这篇讲了什么", True, "page_qa"), ("什么是 BM25", False, "site_qa")]
    df = spark.createDataFrame(rows, "q string, page boolean, want string")
    out = A.planned(df.withColumn("route", A.route(F.col("q"), F.col("page"), F.lit(0), F.lit("site"))))
    assert all(r["route"] == r["want"] for r in out.collect())
    parts = A.subquestions(spark.createDataFrame([(1, "a；b;a？c?d"), (2, "one")], "k long, q string"), "k", "q").orderBy("k", "subquestion_id").collect()
    assert [(r["k"], r["part"]) for r in parts] == [(1, "a"), (1, "b"), (1, "a；c；d"), (2, "one")]


@pytest.mark.parametrize(("q", "titles", "page", "want"), [
    ("第二篇讲了什么", ["X", "Y"], None, ("《Y》讲了什么", False)), ("第三篇呢", ["X"], None, ("第三篇呢", True)), ("前者和后者", ["X", "Y"], None, ("《X》和《Y》", False)), ("两者区别", ["X"], None, ("两者区别", True)),
    ("这篇的重点", [], "P", ("《P》的重点", False)), ("它的缺点", ["X"], None, ("《X》的缺点", False)), ("什么是注意力", ["X"], "P", ("什么是注意力", False)),
])
def test_rewrites(q, titles, page, want):
    assert A.rewrite(q, titles, page) == want


def test_tools(spark):
    rows = [("1", 0, "Spark joins", "/a/", ["spark"], ["db"], "s", "broadcast join text"), ("2", 1, "Other", "/b/", ["x"], ["db"], "s", "spark text here")]
    registry = T.Registry(spark.createDataFrame(rows, "id string, position long, title string, url string, tags array<string>, categories array<string>, section string, content string"))
    assert [r["id"] for r in registry.execute("search_blog", {"query": "spark join"}).orderBy("rank").collect()] == ["1", "2"]
    assert [r["id"] for r in registry.execute("search_blog", {"query": "spark", "tags": ["X"]}).collect()] == ["2"]
    assert registry.execute("get_article", {"url": "/a"}).count() == 1
    assert [r["url"] for r in registry.execute("get_related_articles", {"url": "/a/"}).collect()] == ["/b/"]
    assert registry.execute("compare_articles", {"urls": ["/a/", "/b/"], "dimensions": ["broadcast"]}).filter("status = 'evidence_incomplete'").count() == 1
    for name, args in (("none", {}), ("search_blog", {}), ("search_blog", {"query": "x", "z": 1}), ("search_blog", {"query": "x", "top_k": 21}), ("get_related_articles", {"url": "/a", "post_id": "b"})):
        with pytest.raises(T.ToolError):
            T.validated(name, args)


def test_connectors_and_hashes(spark):
    assert K.verify_token(["new", "old"], K.issue_token("old", "me", 100), 50) == "me" and K.verify_token(["new"], K.issue_token("old", "me", 100), 50) is None and K.verify_token(["old"], K.issue_token("old", "me", 100), 100) is None
    with pytest.raises(ValueError):
        K.webhook_sink("http://x", "s", lambda *_: 200)
    got = spark.createDataFrame([("key", "message"), ("k" * 80, "ü")], "k string, m string").select("k", "m", hmac_sha256(F.col("k"), F.col("m")).alias("h")).collect()
    assert all(r["h"] == hmac.new(r["k"].encode(), r["m"].encode(), hashlib.sha256).hexdigest() for r in got)
    calls = []

    def client(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ServiceError(429)
        return [(i, [3.0, 4.0]) for i in reversed(range(len(texts)))]

    inner = LocalProvider(2)
    assert RetryingProvider(inner, client, batch=2, sleep=lambda s: None).embed_documents(["a", "b", "c"]) == [[0.6, 0.8]] * 3 and calls == [2, 2, 1]
    with pytest.raises(ServiceError):
        RetryingProvider(inner, lambda t: (_ for _ in ()).throw(ServiceError(400)), sleep=lambda s: None).embed_documents(["a"])
