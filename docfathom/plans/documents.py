"""Queries of Markdown documents, claims, questions and tools, on tables where SQL can follow and on literals elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.functions import tokens as K
from docfathom.operators import agent as A
from docfathom.operators import claims as C
from docfathom.operators import embedding as E
from docfathom.operators import model_json as J
from docfathom.operators import tools as T
from docfathom.sources import markdown as S

from .base import ORIGIN, chunks, query, questions, spread, table

REGISTRY = {"default": "generic-article", "documents": {"doc-3.md": "tutorial"}, "paths": [{"glob": "fr/**/*.md", "profile": "math-note"}, {"glob": "de/*.md", "profile": "faq-reference"}]}


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown posts: two headings, the text, a list and a code block."""
    body = F.concat(
        F.lit("---\ntitle: Post "), F.col("doc_id"), F.lit("\ntags: ["), F.col("lang"), F.lit("]\ncategories: ["), F.col("source"), F.lit("]\n---\n# Text\n\n"), F.regexp_replace("text", r"[#>`|$-]", " "),
        F.lit("\n\n## More\n\n- one\n- two\n\n```python\nx = "), F.col("doc_id"), F.lit("\n```\n\n[next](/post-"), F.col("doc_id") + 1, F.lit("/#top)\n"),
    )
    return table(spark, sf, "documents").select(F.concat(F.col("lang"), F.lit("/doc-"), F.col("doc_id"), F.lit(".md")).alias("path"), body.alias("text"))


@query()
def markdown_posts(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus(_posts(spark, sf), ORIGIN, REGISTRY)["posts"].select("id", "url", "profile", "profileSource", F.array_join("tags", ",").alias("tags"), "bodyLine")


@query()
def chunk_v2(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus(_posts(spark, sf), ORIGIN, REGISTRY)["chunks"].select("id", "postId", "parentId", "chunkIndex", "childOrdinal", "chunkType", "tokenCount", "overflowReason")


@query("SELECT 'Post '||doc_id AS \"postId\", 1 AS ordinal, 'python' AS language, 'x = '||doc_id AS code FROM documents")
def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus(_posts(spark, sf), ORIGIN, REGISTRY)["code_blocks"].select("postId", "ordinal", "language", "code")


@query("SELECT 'Post '||doc_id AS \"sourcePostId\", '/post-'||(doc_id+1)||'/' AS target, 'top' AS anchor, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id=documents.doc_id+1) AS resolved FROM documents")
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    from docfathom.operators.graph import resolved_links

    got = S.corpus(_posts(spark, sf), ORIGIN, REGISTRY)
    posts = got["posts"].select("id", F.lit("").alias("path"), F.expr(f"substring(url, {len(ORIGIN) + 1})").alias("url"))
    links = got["links"].select("sourcePostId", F.lit("").alias("target_path"), F.col("target").alias("target_url"), "anchor")
    return resolved_links(links, posts).select("sourcePostId", F.col("target_url").alias("target"), "anchor", "resolved")


@query("SELECT 'Post '||doc_id AS id, CASE WHEN lang='fr' THEN 'math-note' WHEN lang='de' THEN 'faq-reference' ELSE 'generic-article' END AS profile, CASE WHEN lang IN ('fr','de') THEN 'path-rule' ELSE 'migration-fallback' END AS source FROM documents")
def profile_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus(_posts(spark, sf), ORIGIN, REGISTRY)["posts"].select("id", "profile", F.col("profileSource").alias("source"))


@query()
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", K.token_estimate("text").alias("estimate"), K.code_points(F.col("text")).alias("code_points"))


@query()
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", E.LocalProvider())
    return rows.select("doc_id", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"), F.size("values").alias("dimensions"))


@query()
def slug_assign(spark: SparkSession, sf: str) -> DataFrame:
    names = [(f"p{i}", n) for i, n in enumerate(["Größe", "Grosse", "A b", "a-b", "注意力", "a b 2", "A B"])]
    return spark.createDataFrame(sorted(K.assign_slugs(names).items()), "path string, slug string")


@query()
def front_matter_parse(spark: SparkSession, sf: str) -> DataFrame:
    from docfathom.operators.markdown import front_matter

    rows = [(i, str(front_matter(t)[0]), front_matter(t)[2]) for i, t in enumerate(["---\na: 1\n---\nx", "﻿---\nd: 2024-01-02\n...\nx", "no header", "---\n---\n"])]
    return spark.createDataFrame(rows, "i int, fields string, line int")


_CLAIMS = r"""WITH s AS (SELECT doc_id, 'doc_'||doc_id AS chunk, trim(regexp_replace(substring(text,1,40),'\s+',' ','g')) AS quote, trim(regexp_replace(text,'\s+',' ','g')) AS content FROM documents),
c AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN quote||' 9' ELSE quote END AS claim, quote, CASE WHEN doc_id%5=0 THEN 'doc_x' ELSE chunk END AS chunk, content FROM s)
SELECT doc_id::VARCHAR AS answer_id, CASE WHEN claim='' THEN 'invalid_claim_text' WHEN length(quote)<6 THEN 'invalid_evidence_quote' WHEN chunk='doc_x' THEN 'unknown_or_unselected_citation' WHEN NOT contains(content,quote) THEN 'quote_not_in_cited_chunk' WHEN claim<>quote THEN 'claim_not_extractive' END AS reason FROM c"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    quote = X.condensed(F.substring("text", 1, 40))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("answer_id"), F.lit(1).alias("position"), F.lit("a").alias("source_id"), F.lit("sq_1").alias("subquestion_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(quote, F.lit(" 9"))).otherwise(quote).alias("text"),
        quote.alias("quote"), F.array(F.when(F.col("doc_id") % 5 == 0, "doc_x").otherwise(F.concat(F.lit("doc_"), "doc_id"))).alias("citation_ids"),
    )


@query(_CLAIMS)
def verify_claims_extractive(spark: SparkSession, sf: str) -> DataFrame:
    return C.extractive(_claims(spark, sf), chunks(spark, sf)).select("answer_id", "reason")


@query()
def verify_claims_v2(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claims(spark, sf)
    assigned = rows.select("answer_id", "subquestion_id", F.element_at("citation_ids", 1).alias("chunk_id"))
    said = rows.select("answer_id", "source_id", F.lit(True).alias("supported"), F.lit(True).alias("direct"), F.lit("supported").alias("code"))
    covered = rows.select("answer_id", "subquestion_id", F.lit(True).alias("covered"))
    return C.grounded(rows, chunks(spark, sf), assigned, said, covered).select("answer_id", "position", "reason")


@query("SELECT o_custkey AS answer_id, o_orderstatus AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey), o_orderstatus) AS number FROM orders GROUP BY 1,2")
def citation_numbering(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderstatus").alias("chunk_id"), F.col("o_orderkey").alias("position"))
    return C.numbered(rows).withColumn("number", F.col("number").cast("long"))


@query(r"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text,'; ',';'),';'), lambda x: trim(x)), lambda x: x<>'') AS parts, text FROM (SELECT conv_id, turn, replace(replace(text,'?',' '),',',';') AS text FROM conversations)),
k AS (SELECT conv_id, turn, CASE WHEN len(parts)>3 THEN list_concat(parts[1:2],[array_to_string(parts[3:],'；')]) WHEN len(parts)>1 THEN parts ELSE [trim(text)] END AS kept FROM p),
u AS (SELECT conv_id, turn, i, substring(kept[i],1,500) AS part FROM k, range(1,4) r(i) WHERE i<=len(kept))
SELECT conv_id, turn, part FROM u WHERE trim(part)<>'' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, trim(regexp_replace(lower(part),'\s+',' ','g')) ORDER BY i)=1""")
def split_subqueries(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("k"), F.translate("text", "?,", " ;").alias("q"))
    return A.subquestions(rows, "k", "q").select("k.conv_id", "k.turn", "part")


@query()
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = ["你好", "A 和 B 的区别", "学习路径", "推荐几篇文章", "这篇讲了什么", "总结一下", "什么是 BM25"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i long, q string").crossJoin(spark.createDataFrame([(True,), (False,)], "page boolean"))
    return A.planned(rows.withColumn("route", A.route(F.col("q"), F.col("page"), F.lit(0), F.lit("site"))))


@query()
def rewrite_followups(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "第二篇讲了什么", ["X", "Y"], None), (2, "它的缺点", [], None), (3, "这篇的重点", [], "P")], "i long, q string, titles array<string>, page string")
    return rows.select("i", A.rewritten("q", "titles", "page").alias("standalone"))


@query()
def tool_registry_validate(spark: SparkSession, sf: str) -> DataFrame:
    cases = [("search_blog", {"query": "x"}), ("search_blog", {}), ("none", {}), ("get_article", {"url": "/a/", "top_k": 99})]
    out = []
    for i, (name, args) in enumerate(cases):
        try:
            out.append((i, name, "ok", T.validated(name, args)["top_k"]))
        except T.ToolError as e:
            out.append((i, name, str(e), None))
    return spark.createDataFrame(out, "i int, tool string, outcome string, top_k int")


@query()
def tool_search(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf).orderBy("query_id").first()["question"]
    return T.Registry(chunks(spark, sf), ORIGIN).execute("search_blog", {"query": asked, "tags": ["en"], "top_k": 10}).select("id", "rank", F.round("score", 6).alias("score"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a model's answer of one claim, by doc_id modulo 7 fenced, amid prose, torn or of a wrong shape."""
    text = F.coalesce("text", F.lit(""))
    said = F.expr("substring(j, 2, length(j) - 2)")
    case = F.col("doc_id") % 7
    question = F.when(case == 6, "").otherwise('"subquestionId":"sq_1",')
    claim = F.concat(F.lit('{"id":"c1",'), question, F.lit('"text":'), said, F.lit(',"quote":'), F.when(case == 1, "null").otherwise(said), F.lit(',"citationIds":["a",'), F.when(case == 2, "2").otherwise('"b"'), F.lit("]}"))
    listed = F.when(case == 3, F.concat_ws(",", *[claim] * 4)).otherwise(claim)
    whole = F.concat(F.lit('{"claims":['), listed, F.lit("]"), F.when(case == 6, ',"unansweredSubquestions":{}').otherwise(""), F.when(case == 5, "").otherwise("}"))
    around = F.when(case == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(case == 4, F.concat(F.lit('So "it" is: '), whole, F.lit(' {"claims":[]}'))).otherwise(whole)
    return spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.to_json(F.array(text)).alias("j")).select("doc_id", J.parsed(around).alias("v"))


@query("""SELECT doc_id, path, rule FROM documents JOIN (VALUES (1,'$.claims[0].quote','not_string'),(2,'$.claims[0].citationIds[1]','not_string'),(3,'$.claims','too_many'),(5,'$','invalid_json'),
 (6,'$.claims[0].subquestionId','missing'),(6,'$.unansweredSubquestions','not_array')) v(m,path,rule) ON doc_id%7=m""")
def answer_violations(spark: SparkSession, sf: str) -> DataFrame:
    return J.violations(_answers(spark, sf), "doc_id", "v", J.GROUNDED)


@query("SELECT doc_id, 0::BIGINT AS place, 'sq_1' AS subquestion_id, md5(coalesce(text,'')) AS text_md5, 'a,b' AS citations FROM documents WHERE doc_id%7 IN (0,4)")
def answer_claims(spark: SparkSession, sf: str) -> DataFrame:
    got = J.claims(_answers(spark, sf), "doc_id", "v")
    return got.select("doc_id", "place", "subquestion_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("citation_ids", ",").alias("citations"))


@query(r"""SELECT event_id, CASE WHEN event_id%5=3 THEN NULL ELSE (props->>'k')::BIGINT END AS k, CASE WHEN event_id%5=3 THEN 'invalid_json' WHEN (props->>'k')::BIGINT IS NULL THEN 'no number' ELSE 'number' END AS outcome FROM events""")
def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events as VARIANT, as they come: plain, fenced, amid prose, torn, beside braces in strings."""
    p, case = F.col("props"), F.col("event_id") % 5
    seen = (
        F.when(case == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(case == 2, F.concat(F.lit("Props: "), p, F.lit(" and {more}")))
        .when(case == 3, F.expr("substring(props, 1, length(props) - 1)")).when(case == 4, F.concat(F.lit("x "), F.expr("substring(props, 1, length(props) - 1)"), F.lit(r',"s":"} \" {"} y'))).otherwise(p)
    )
    rows = table(spark, sf, "events").select("event_id", J.parsed(seen).alias("v"))
    k = F.try_variant_get("v", "$.k", "variant")
    outcome = F.when(F.col("v").isNull(), "invalid_json").when(J.kind(k) == "number", "number").otherwise("no number")
    return rows.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), outcome.alias("outcome"))
