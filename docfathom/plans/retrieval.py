"""Queries of text functions and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfathom.functions import hashing as H
from docfathom.functions import text as X
from docfathom.functions.vectors import dot
from docfathom.operators import evidence, metrics
from docfathom.operators import retrieval as R
from docfathom.operators.patterns import without

from .base import ASKED, BM25, DOCS, ORIGIN, TERM, chunks, query, questions, stored_index, table

WITH = f"WITH {DOCS}, {ASKED}, {BM25} "


@query(r"SELECT doc_id, trim(regexp_replace(lower(text),'\s+',' ','g')) AS normal FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalized(F.col("text")).alias("normal"))


@query(r"SELECT doc_id, CASE WHEN length(t)<=160 THEN t ELSE trim(substring(t,1,160))||'...' END AS cut FROM (SELECT doc_id, trim(regexp_replace(text,'\s+',' ','g')) AS t FROM documents)")
def snippet_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text"), 160).alias("cut"))


@query(r"""SELECT page_id, CASE WHEN ok THEN 'https://example.org'||regexp_replace(regexp_replace(path,'[?#].*$',''),'/+$','')||'/' ELSE '' END AS canonical, ok AS allowed FROM (
SELECT page_id, CASE WHEN path LIKE '/%' THEN path NOT LIKE '//%' AND NOT contains(path,'\') ELSE false END AS ok, path FROM (
SELECT page_id, regexp_replace(url,'^[a-z]+://[^/?#]*','') AS path FROM pages))""")
def url_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    return table(spark, sf, "pages").select("page_id", X.normal_url(path, ORIGIN).alias("canonical"), X.allowed_url(path, ORIGIN).alias("allowed"))


@query(rf"WITH {DOCS} SELECT id, array_to_string(regexp_extract_all(body,'{TERM}'),' ') AS terms FROM d")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.indexable(chunks(spark, sf), ORIGIN).select("id", F.array_join(X.terms(F.col("content")), " ").alias("terms"))


@query(rf"WITH {DOCS} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(body,'{TERM}')) AS term FROM d) GROUP BY 1,2")
def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(R.indexable(chunks(spark, sf), ORIGIN))


@query(rf"WITH {DOCS} SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(regexp_extract_all(body,'{TERM}')) AS term FROM d) GROUP BY 1")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return R.document_frequency(R.postings(R.indexable(chunks(spark, sf), ORIGIN)))


@query(rf"WITH {DOCS} SELECT count(*) AS n, sum(length)::BIGINT AS total, round(avg(length),6) AS average FROM (SELECT greatest(len(regexp_extract_all(body,'{TERM}')),1) AS length FROM d)")
def doc_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.lengths(R.indexable(chunks(spark, sf), ORIGIN)).agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.round(F.avg("length"), 6).alias("average"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(WITH + "SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20 AND query_id=(SELECT min(query_id) FROM q)")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    first = asked.join(asked.agg(F.min("query_id").alias("query_id")), "query_id", "left_semi")
    return _shown(R.bm25_best(chunks(spark, sf), first, ORIGIN))


@query(WITH + "SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20")
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.bm25_best(chunks(spark, sf), questions(spark, sf), ORIGIN))


@query(WITH + "SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20")
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the stored index."""
    return _shown(stored_index(spark, sf).search(questions(spark, sf)))


@query(rf"WITH {DOCS} SELECT term, count(*) AS df, max(tf) AS top_tf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(body,'{TERM}')) AS term FROM d) GROUP BY 1,2) GROUP BY 1")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Each term's chunks and largest frequency, from the stored index's rows without their postings."""
    return stored_index(spark, sf).postings().groupBy("term").agg(F.sum("n").alias("df"), F.max("top_tf").alias("top_tf"))


@query(f"WITH d AS (SELECT * FROM ({DOCS[5:].strip().removeprefix('(').removesuffix(')')}) WHERE lang='en' AND source IN ('src1','src2','src3')), {ASKED}, {BM25} SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20")
def bm25_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Tags and categories filter before any statistic."""
    wanted = F.array(F.lit("en"))
    kept = chunks(spark, sf).filter((F.size(F.array_except(wanted, F.transform("tags", X.normalized))) == 0) & F.col("source").isin("src1", "src2", "src3"))
    return _shown(R.bm25_best(kept, questions(spark, sf), ORIGIN))


@query("SELECT 'doc_'||doc_id AS id, doc_id AS position, 1::BIGINT AS rank FROM documents WHERE doc_id=7")
def page_summary_order(spark: SparkSession, sf: str) -> DataFrame:
    return R.summary_order(chunks(spark, sf), "/d/7", ORIGIN).select("id", "position", F.col("rank").cast("long").alias("rank"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("vec_id").alias("position"), F.col("embedding").alias("values"), "label")


def _asked_vectors(spark: SparkSession, sf: str, which: str = "vec_id < 20") -> DataFrame:
    return table(spark, sf, "embeddings").filter(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("values"))


_DENSE = """WITH s AS (SELECT a.vec_id AS query_id, 'v'||b.vec_id AS id, b.vec_id AS position, b.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id<20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, position) AS rank FROM s WHERE score>={}) """


@query(_DENSE.format("-2") + "SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.dense(_vectors(spark, sf), _asked_vectors(spark, sf), floor=-2.0))


@query(_DENSE.format("0.17") + "SELECT query_id, id, rank, round(score,6) AS score FROM r WHERE rank<=20")
def dense_topk_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.dense(_vectors(spark, sf), _asked_vectors(spark, sf)))


@query()
def dense_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is a query; their SQL twins keep the queries above to 20."""
    return _shown(R.dense(_vectors(spark, sf), _asked_vectors(spark, sf, "true"), floor=-2.0))


@query()
def dense_topk_floor_all(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(R.dense(_vectors(spark, sf), _asked_vectors(spark, sf, "true")))


#: A second list that SQL can compute: the share of the question's terms that the text contains.
_PROXY = r"""p AS (SELECT query_id, d.id, d.position, len(list_filter(terms, lambda x: contains(body,x)))::DOUBLE/greatest(len(terms),1) AS score FROM d CROSS JOIN qq),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, position) AS rank FROM p WHERE score>=0.17) WHERE rank<=20),
f AS (SELECT query_id, id, min(position) AS position, max(br) AS bm25_rank, max(vr) AS vector_rank, coalesce(max(vs),0) AS vector_score, sum(1.0/(60+coalesce(br,vr))) AS rrf FROM (
 SELECT query_id,id,position,rank AS br,NULL AS vr,NULL AS vs FROM r WHERE rank<=20 UNION ALL SELECT query_id,id,position,NULL,rank,score FROM v) GROUP BY 1,2)"""


def _proxy(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(R.covered(chunks(spark, sf), questions(spark, sf), ORIGIN, R.TOP_K, R.DENSE_FLOOR))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return R.reciprocal_rank_fusion(R.bm25_best(chunks(spark, sf), questions(spark, sf), ORIGIN), _proxy(spark, sf))


@query(WITH + "," + _PROXY + " SELECT query_id, id, bm25_rank, vector_rank, round(rrf,6) AS rrf FROM f")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "id", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("rrf", 6).alias("rrf"))


_COVER = r"""c AS (SELECT f.*, len(list_filter(terms, lambda x: contains(trim(regexp_replace(lower(title||' '||lang||' '||source||'  '||content),'\s+',' ','g')),x)))::DOUBLE/greatest(len(terms),1) AS lc,
 len(list_filter(terms, lambda x: contains(body,x)))::DOUBLE/greatest(len(terms),1) AS pc, trim(regexp_replace(lower(title),'\s+',' ','g')) AS t, question FROM f JOIN d USING(id) JOIN qq USING(query_id)),
e AS (SELECT *, rrf+0.008*lc+(CASE WHEN t=question OR (length(question)>=3 AND (contains(t,question) OR contains(question,t))) THEN 0.12*pc+0.025 ELSE 0 END)+0.008*greatest(0,vector_score) AS rr FROM c)"""


@query(WITH + "," + _PROXY + "," + _COVER + " SELECT query_id, id, round(lc,6) AS lexical_coverage, round(pc,6) AS passage_coverage, round(rr,6) AS rerank_score FROM e")
def rrf_rerank(spark: SparkSession, sf: str) -> DataFrame:
    out = R.rerank(_fused(spark, sf), chunks(spark, sf), questions(spark, sf), ORIGIN)
    return out.select("query_id", "id", F.round("lexical_coverage", 6).alias("lexical_coverage"), F.round("passage_coverage", 6).alias("passage_coverage"), F.round("rerank_score", 6).alias("rerank_score"))


@query()
def diversify_quota(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf).withColumn("url", F.concat(F.lit("/s/"), "source", F.lit("/")))
    return R.diversified(R.rerank(_fused(spark, sf), docs, questions(spark, sf), ORIGIN), ORIGIN).select("query_id", "id", "rank", F.round("rerank_score", 6).alias("score"))


@query()
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Hash embeddings of documents and questions, fused with BM25."""
    from docfathom.operators.embedding import LocalProvider, embed

    provider = LocalProvider()
    docs, asked = chunks(spark, sf), questions(spark, sf)
    vectors = embed(docs.select("id", "position", "content"), "content", provider)
    return R.hybrid(docs, asked, vectors, embed(asked, "question", provider), ORIGIN, embedded=True).select("query_id", "id", "rank", "strategy", F.round("rerank_score", 6).alias("score"))


@query()
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf)
    top = R.bm25_best(docs, questions(spark, sf), ORIGIN).join(docs.select("id", "url", "content"), "id")
    return evidence.packed(top).select("query_id", "id", "place", "characters")


@query(r"""WITH n AS (SELECT conv_id, turn, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'c'||conv_id||'_'||turn AS id, -1 AS side, 'c'||conv_id||'_'||b AS neighbour FROM n WHERE b IS NOT NULL UNION ALL SELECT 'c'||conv_id||'_'||turn, 1, 'c'||conv_id||'_'||a FROM n WHERE a IS NOT NULL""")
def neighbor_expand(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("id"), F.col("conv_id").cast("string").alias("parent_id"), F.col("turn").alias("child_ordinal"))
    return R.neighbours(turns)


@query()
def parent_expansion(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf).withColumn("parent_id", F.col("source")).withColumn("child_ordinal", F.col("position"))
    return R.expanded(R.bm25_best(docs, questions(spark, sf), ORIGIN), docs).select("query_id", "id", "rank", "expanded_from")


@query(WITH + "SELECT query_id, d.id, round(len(list_filter(terms, lambda x: contains(body,x)))::DOUBLE/greatest(len(terms),1),6) AS coverage FROM d CROSS JOIN qq WHERE len(list_filter(terms, lambda x: contains(body,x)))>0")
def lexical_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.covered(chunks(spark, sf), questions(spark, sf), ORIGIN).select("query_id", "id", F.round("score", 6).alias("coverage")).filter("coverage > 0")


@query(WITH + "SELECT query_id, round(max(c),6) AS best, max(c)>=0.30 AS sufficient FROM (SELECT query_id, len(list_filter(terms, lambda x: contains(trim(regexp_replace(lower(title||'  '||lang||' '||source||' '||content),'\\s+',' ','g')),x)))::DOUBLE/greatest(len(terms),1) AS c FROM r JOIN d USING(id) JOIN qq USING(query_id) WHERE rank<=20) GROUP BY 1".replace("\\\\", "\\"))
def evidence_grade_site(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf)
    top = R.bm25_best(docs, questions(spark, sf), ORIGIN).join(docs, "id").drop(docs["position"]).join(questions(spark, sf), "query_id")
    return evidence.graded(top).select("query_id", F.round("best", 6).alias("best"), "sufficient")


_TWO = f"WITH {DOCS}, q AS (SELECT item_id*10+k AS query_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(text),'\\s+',' ','g')),' '),1+k*3,6+k*3),' ') AS question FROM benchmark, (VALUES (0),(1)) v(k)), {BM25} "


@query(_TWO + "SELECT request_id, id, n_matched, round(score,6) AS score, best_rank, row_number() OVER (PARTITION BY request_id ORDER BY n_matched DESC, best_rank, round(score,9) DESC, position) AS \"order\" FROM (SELECT query_id//10 AS request_id, id, count(DISTINCT query_id) AS n_matched, max(score) AS score, min(rank) AS best_rank, min(position) AS position FROM r WHERE rank<=20 GROUP BY 1,2)")
def candidate_merge(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(X.normalized(F.col("text")), " ")
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), words.alias("w"))
    asked = asked.select((F.col("item_id") * 10 + F.col("k")).alias("query_id"), F.array_join(F.slice("w", 1 + F.col("k") * 3, F.lit(6)), " ").alias("question"))
    top = R.bm25_best(chunks(spark, sf), asked, ORIGIN).withColumn("request_id", F.expr("query_id div 10")).withColumn("query", F.col("query_id").cast("string"))
    return R.merged_candidates(top).select("request_id", "id", F.size("matched").cast("long").alias("n_matched"), F.round("score", 6).alias("score"), F.col("best_rank").cast("long").alias("best_rank"), F.col("order").cast("long").alias("order"))


@query(WITH + "SELECT query_id, url, related_rank FROM (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS related_rank FROM (SELECT query_id, '/s/'||source||'/' AS url, min(rank) AS rank FROM r JOIN d USING(id) WHERE rank<=20 GROUP BY 1,2) WHERE url<>'/s/src1/')")
def related_distinct_url(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf)
    top = R.bm25_best(docs, questions(spark, sf), ORIGIN).join(docs.select("id", F.concat(F.lit("/s/"), "source", F.lit("/")).alias("url")), "id")
    return R.related(top, F.lit("/s/src1/")).select("query_id", "url", F.col("related_rank").cast("long").alias("related_rank"))


@query(WITH + "SELECT query_id, id, n FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r) WHERE n<=3")
def unique_citations(spark: SparkSession, sf: str) -> DataFrame:
    top = R.bm25_best(chunks(spark, sf), questions(spark, sf), ORIGIN)
    again = top.unionByName(top)  # citations may repeat: the first of each id counts
    first = again.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).filter("n <= 3").select("query_id", "id", "n")


@query(r"""SELECT page_id, trim(regexp_extract(html,'<title>([^<]*)</title>',1)) AS title, trim(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),'\s+',' ','g')) AS body FROM pages""")
def html_strip_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), X.condensed(X.html_text(F.col("html"))).alias("body"))


@query(r"""WITH k AS (SELECT unnest(['the','and','of']) AS w), p AS (SELECT doc_id, lower(text) AS t FROM documents), h AS (SELECT doc_id, count(*) FILTER (WHERE n>0) AS hit_words, sum(n)::BIGINT AS hits FROM (SELECT doc_id, w, (length(t)-length(replace(t,w,'')))//length(w) AS n FROM p,k) GROUP BY 1)
SELECT doc_id, hit_words, hits, row_number() OVER (ORDER BY hit_words DESC, hits DESC, doc_id DESC) AS place FROM h WHERE hits>0 QUALIFY place<=50""")
def site_search_rank(spark: SparkSession, sf: str) -> DataFrame:
    from docfathom.operators.site_search import search

    return search(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), ["the", "and", "of"], 50).select(F.col("id").alias("doc_id"), "hit_words", "hits", "place")


#: Hits of each word in turn; of those from left to right, the longest first, the ones that are shown, by a walk that also cuts the slices.
_SLICES = r"""WITH RECURSIVE s AS (SELECT item_id, lower(split_part(t,' ',1)||' '||split_part(t,' ',2)) AS whole FROM (SELECT item_id, trim(regexp_replace(text,'[-\s]+',' ','g')) AS t FROM benchmark)),
k AS (SELECT item_id, whole, unnest([split_part(whole,' ',1),split_part(whole,' ',2),whole]) AS w, unnest([1,2,3]) AS nth FROM s),
x AS (SELECT DISTINCT w FROM k WHERE w<>''),
t AS (SELECT doc_id, 'content' AS field, lower(text) AS t FROM documents UNION ALL SELECT doc_id, 'title', lower(CASE WHEN trim(regexp_extract(text,'^[^.\n]*'))='' THEN 'untitled' ELSE trim(regexp_extract(text,'^[^.\n]*')) END) FROM documents),
p AS (SELECT doc_id, field, w, unnest(string_split(t,w)) AS part, generate_subscripts(string_split(t,w),1) AS i, len(string_split(t,w)) AS n FROM t JOIN x ON contains(t,w)),
o AS (SELECT doc_id, field, w, start FROM (SELECT *, (sum(length(part)) OVER (PARTITION BY doc_id, field, w ORDER BY i)+(i-1)*length(w))::BIGINT AS start FROM p) WHERE i<n),
h AS (SELECT item_id, doc_id, field, start, length(w)::BIGINT AS size, (w=whole) AS whole FROM o JOIN k USING(w)),
c AS (SELECT item_id, doc_id, count(*) AS hits FROM h GROUP BY 1,2),
f AS (SELECT item_id, doc_id, field, start, max(size) AS size, arg_max(whole,size) AS whole FROM h GROUP BY 1,2,3,4),
e AS (SELECT f.*, start+size AS stop, length(t)::BIGINT AS len FROM f JOIN t USING(doc_id, field)),
g AS (SELECT e.*, n.start AS next FROM e ASOF LEFT JOIN f n ON e.item_id=n.item_id AND e.doc_id=n.doc_id AND e.field=n.field AND e.stop<=n.start),
r(item_id, doc_id, field, start, stop, whole, next, lo, hi) AS (
 SELECT item_id, doc_id, field, start, stop, whole, next, greatest(0,start-20), least(greatest(start+80,stop),len) FROM g QUALIFY row_number() OVER (PARTITION BY item_id, doc_id, field ORDER BY start)=1
 UNION ALL SELECT g.item_id, g.doc_id, g.field, g.start, g.stop, g.whole, g.next, CASE WHEN g.stop<=r.hi THEN r.lo ELSE greatest(0,g.start-20) END, CASE WHEN g.stop<=r.hi THEN r.hi ELSE least(greatest(g.start+80,g.stop),g.len) END
 FROM r JOIN g ON g.item_id=r.item_id AND g.doc_id=r.doc_id AND g.field=r.field AND g.start=r.next),
v AS (SELECT item_id, doc_id, lo, hi, count(*) FILTER (WHERE whole) AS whole, count(*) AS n, string_agg(start||'-'||stop, ' ' ORDER BY start) AS marks FROM r WHERE field='content' GROUP BY 1,2,3,4),
b AS (SELECT item_id, doc_id, string_agg(lo||'-'||hi||': '||marks, '; ' ORDER BY place) AS slices FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY whole DESC, n DESC, lo) AS place FROM v) WHERE place<=3 GROUP BY 1,2),
u AS (SELECT item_id, doc_id, count(*) FILTER (WHERE whole) AS whole_hits, count(*) FILTER (WHERE field='title') AS in_title FROM r GROUP BY 1,2)
SELECT item_id, doc_id, hits, whole_hits, in_title, coalesce(slices,'') AS slices, row_number() OVER (PARTITION BY item_id ORDER BY whole_hits DESC, hits DESC, doc_id DESC) AS place FROM c JOIN u USING(item_id, doc_id) LEFT JOIN b USING(item_id, doc_id) QUALIFY place<=20"""


@query(_SLICES)
def site_search_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The first two words of each benchmark item as a search over all documents: the 20 best, three slices each."""
    from docfathom.operators.site_search import ranked

    word = lambda n: F.split_part(F.trim(F.regexp_replace("text", r"[-\s]+", " ")), F.lit(" "), F.lit(n))
    searches = table(spark, sf, "benchmark").select(F.col("item_id").alias("search_id"), F.concat_ws(" ", word(1), word(2)).alias("search"))
    got = ranked(chunks(spark, sf).select(F.col("position").alias("id"), "title", "content"), searches, 20, 3)
    marks = lambda hits: F.array_join(F.transform(hits, lambda h: F.concat_ws("-", h["start"], h["stop"])), " ")
    shown = F.array_join(F.transform("slices", lambda s: F.concat(s["start"], F.lit("-"), s["stop"], F.lit(": "), marks(s["hits"]))), "; ")
    return got.select(F.col("search_id").alias("item_id"), F.col("id").alias("doc_id"), "hits", "whole_hits", F.size("title_hits").cast("long").alias("in_title"), shown.alias("slices"), "place")


@query(r"""WITH a AS (SELECT 'doc_'||doc_id AS id, doc_id, source, lower(text) AS t FROM documents WHERE source IN ('src1','src2')), dim AS (SELECT * FROM (VALUES ('core',''),('time','time'),('tion','tion')) v(dimension,term))
SELECT source, dimension, id, n FROM (SELECT source, dimension, id, doc_id, CASE WHEN term='' THEN 0 ELSE (length(t)-length(replace(t,term,'')))//length(nullif(term,'')) END AS n, row_number() OVER (PARTITION BY source, dimension ORDER BY CASE WHEN term='' THEN 0 ELSE (length(t)-length(replace(t,term,'')))//length(nullif(term,'')) END DESC, doc_id) AS k FROM a, dim WHERE term='' OR contains(t,term)) WHERE k=1""")
def compare_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Articles by dimensions: the best evidence of each cell; ``core`` needs none."""
    dims = spark.createDataFrame([("core", ""), ("time", "time"), ("tion", "tion")], "dimension string, term string")
    rows = table(spark, sf, "documents").filter(F.col("source").isin("src1", "src2")).withColumn("t", F.lower("text"))
    n = F.when(F.col("term") == "", 0).otherwise(F.expr("(length(t) - length(replace(t, term, ''))) div greatest(length(term), 1)"))
    cells = rows.crossJoin(F.broadcast(dims)).filter((F.col("term") == "") | F.col("t").contains(F.col("term"))).withColumn("n", n.cast("long"))
    best = cells.withColumn("k", F.row_number().over(Window.partitionBy("source", "dimension").orderBy(F.desc("n"), "doc_id"))).filter("k = 1")
    return best.select("source", "dimension", F.concat(F.lit("doc_"), "doc_id").alias("id"), "n")


@query(r"""WITH t AS (SELECT item_id, string_split(trim(regexp_replace(lower(text),'\s+',' ','g')),' ')[1] AS title FROM benchmark), c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text),'\s+',' ','g')) AS t FROM conversations)
SELECT conv_id, turn, title, strpos(t,title)-1 AS at FROM c JOIN (SELECT DISTINCT title FROM t WHERE length(title)>=2) ON contains(t,title)""")
def title_mentions(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "benchmark").select(F.element_at(F.split(X.normalized(F.col("text")), " "), 1).alias("title")).filter(F.length("title") >= 2).distinct()
    return evidence.mentions(table(spark, sf, "conversations").withColumn("t", X.normalized(F.col("text"))), titles, "t", ["conv_id", "turn"])


#: Places of each title in turn (a search goes on behind each hit), then the longest first by a recursive choice.
_SEPARATE = r"""WITH RECURSIVE t AS (SELECT DISTINCT string_split(trim(regexp_replace(lower(text),'\s+',' ','g')),' ')[1] AS title FROM benchmark), n AS (SELECT title FROM t WHERE length(title)>=2),
c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text),'\s+',' ','g')) AS t FROM conversations),
o AS (SELECT conv_id, turn, title, list_sum(list_transform(parts[1:i], lambda p: length(p)))+(i-1)*length(title) AS start FROM (SELECT conv_id, turn, title, string_split(t,title) AS parts, unnest(range(1,len(string_split(t,title)))) AS i FROM c JOIN n ON contains(t,title))),
l AS (SELECT conv_id, turn, title, start::BIGINT AS start, (start+length(title))::BIGINT AS stop, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(title) DESC, start) AS k FROM o),
r AS (SELECT conv_id, turn, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT, title VARCHAR)[] AS taken FROM (SELECT DISTINCT conv_id, turn FROM l)
 UNION ALL SELECT r.conv_id, r.turn, l.k, CASE WHEN len(list_filter(taken, lambda x: x.a<l.stop AND l.start<x.b))>0 THEN taken ELSE list_append(taken, {'a': l.start, 'b': l.stop, 'title': l.title}) END FROM r JOIN l ON l.conv_id=r.conv_id AND l.turn=r.turn AND l.k=r.k+1),
z AS (SELECT conv_id, turn, unnest(taken) AS one FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY k DESC)=1),
s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY one.a)-1 AS place, one.title AS title, one.a AS start FROM z) """


@query(_SEPARATE + "SELECT conv_id, turn, place, title, start FROM s")
def title_mentions_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "benchmark").select(F.element_at(F.split(X.normalized(F.col("text")), " "), 1).alias("title")).filter(F.length("title") >= 2).distinct()
    turns = table(spark, sf, "conversations").withColumn("t", X.normalized(F.col("text")))
    return evidence.separate_mentions(turns, titles, "t", ["conv_id", "turn"]).withColumn("place", F.col("place").cast("long"))


@query(_SEPARATE + "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(place))-1 AS nth, title FROM s GROUP BY conv_id, turn, title")
def comparison_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The titles that a turn names, each once, in order of their first separate mention."""
    titles = table(spark, sf, "benchmark").select(F.element_at(F.split(X.normalized(F.col("text")), " "), 1).alias("title")).filter(F.length("title") >= 2).distinct()
    turns = table(spark, sf, "conversations").withColumn("t", X.normalized(F.col("text")))
    return evidence.mentioned_titles(turns, titles, "t", ["conv_id", "turn"]).withColumn("nth", F.col("nth").cast("long"))


@query(r"""WITH RECURSIVE k AS (SELECT conv_id, turn, trim(regexp_replace(lower(text),'\s+',' ','g')) AS t FROM conversations), n AS (SELECT DISTINCT conv_id, string_split(t,' ')[1] AS title FROM k WHERE length(string_split(t,' ')[1])>=2),
o AS (SELECT conv_id, list(title ORDER BY length(title) DESC, title) AS own FROM n GROUP BY 1),
r AS (SELECT conv_id, turn, 0 AS i, t AS rest FROM k UNION ALL SELECT r.conv_id, turn, i+1, replace(rest, own[i+1], ' ') FROM r JOIN o USING(conv_id) WHERE i<len(own))
SELECT conv_id, turn, trim(regexp_replace(rest,'\s+',' ','g')) AS rest FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC)=1""")
def titles_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Turns without the titles known to their conversation (the first words of its turns), long ones first."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", X.normalized(F.col("text")).alias("t"))
    known = turns.select("conv_id", F.element_at(F.split("t", " "), 1).alias("title")).filter(F.length("title") >= 2)
    return without(turns, "t", ["conv_id"], known, "title").select("conv_id", "turn", "rest")


_RANKS = _DENSE.format("-2") + ", k AS (SELECT query_id, q.label, rank FROM r JOIN (SELECT vec_id, label FROM embeddings) q ON q.vec_id=query_id WHERE r.label=q.label AND r.position<>query_id), n AS (SELECT a.vec_id AS query_id, a.label, count(*) AS relevant FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<>b.vec_id WHERE a.vec_id<20 GROUP BY 1,2), m AS (SELECT n.query_id, n.label, relevant, count(*) FILTER (WHERE rank<=5)/relevant AS r5, count(*) FILTER (WHERE rank<=20)/relevant AS r20, coalesce(1.0/min(rank) FILTER (WHERE rank<=20),0) AS rr, coalesce(sum(1/log2(rank+1)) FILTER (WHERE rank<=20),0)/list_sum(list_transform(range(1,least(relevant,20)+1), lambda i: 1/log2(i+1))) AS nd FROM n LEFT JOIN k USING(query_id) GROUP BY n.query_id, n.label, relevant) "


def _metrics(spark: SparkSession, sf: str, which: str = "vec_id < 20", k: int = 20) -> DataFrame:
    from_label = table(spark, sf, "embeddings").filter(which).select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    ranking = R.dense(_vectors(spark, sf), _asked_vectors(spark, sf, which), k=k, floor=-2.0).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), "label"), "position")
    hits = ranking.join(from_label if which == "true" else F.broadcast(from_label), "query_id").filter((F.col("label") == F.col("wanted")) & (F.col("position") != F.col("query_id")))
    sizes = table(spark, sf, "embeddings").groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    cases = from_label.join(sizes, from_label["wanted"] == sizes["label"]).filter("relevant > 0").select("query_id", "label", "relevant")
    return metrics.by_case(cases, hits.select("query_id", "rank"))


@query(_RANKS + "SELECT query_id, round(r5,4) AS recall_at_5, round(r20,4) AS recall_at_20, round(rr,4) AS mrr_at_20, round(nd,4) AS ndcg_at_20 FROM m")
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("query_id", *(F.round(c, 4).alias(c) for c in ("recall_at_5", "recall_at_20", "mrr_at_20", "ndcg_at_20")))


@query(_RANKS + "SELECT label, count(*) AS cases, round(avg(r5),4) AS recall_at_5, round(avg(r20),4) AS recall_at_20, round(avg(rr),4) AS mrr_at_20, round(avg(nd),4) AS ndcg_at_20 FROM m GROUP BY 1")
def metrics_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summary(_metrics(spark, sf), "label")


@query()
def recall_mrr_ndcg_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is a case; no figure looks beyond rank 20."""
    return _metrics(spark, sf, "true").select("query_id", *(F.round(c, 4).alias(c) for c in ("recall_at_5", "recall_at_20", "mrr_at_20", "ndcg_at_20")))


@query()
def metrics_by_category_all(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summary(_metrics(spark, sf, "true"), "label")


@query(r"""WITH s AS (SELECT doc_id, i, trim(x) AS sentence FROM (SELECT doc_id, unnest(string_split(text,'.')) AS x, generate_subscripts(string_split(text,'.'),1) AS i FROM documents) WHERE trim(x)<>''), k AS (SELECT *, (CASE WHEN contains(lower(sentence),'the') THEN 1 ELSE 0 END)+(CASE WHEN contains(lower(sentence),'tion') THEN 1 ELSE 0 END) AS hits FROM s)
SELECT doc_id, sentence, hits FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i)=1""")
def best_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.best_sentences(table(spark, sf, "documents"), "doc_id", "text", ["the", "tion"])


@query("SELECT doc_id, 'sha256:'||sha256(text) AS content_hash, 'chunk_'||substring(sha256(doc_id||chr(0)||lang||chr(0)||text),1,24) AS stable_id FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", H.content_hash(F.col("text")).alias("content_hash"), H.stable_id("chunk", 24, F.col("doc_id"), F.col("lang"), F.col("text")).alias("stable_id"))


@query("SELECT c_custkey, round((('0x'||substring(sha256(c_name),1,8))::BIGINT)/4294967296.0*100,6) AS place, (('0x'||substring(sha256(c_name),1,8))::BIGINT)/4294967296.0*100<25 AS chosen FROM customer")
def rollout_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(H.rollout_percent(F.col("c_name")), 6).alias("place"), H.in_rollout(F.col("c_name"), 25).alias("chosen"))


@query(r"""SELECT doc_id, regexp_matches(text,'(?i)(?:\bnot\b|\bno\b|\bnever\b|\bwithout\b)') AS negated, array_to_string(regexp_extract_all(text,'[0-9]+(?:\.[0-9]+)?%?'),' ') AS numbers FROM documents""")
def number_negation_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.has_negation(F.col("text")).alias("negated"), F.array_join(X.numbers(F.col("text")), " ").alias("numbers"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def vector_dot(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(dot(F.col("x"), F.col("y")), 6).alias("dot"))
