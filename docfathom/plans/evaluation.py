"""Queries of evaluation summaries, joins by time and position, and choices of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfathom.operators import evaluation as E
from docfathom.operators import joins as J
from docfathom.operators import selection as S

from .base import query, table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 50 != 0).alias("ok"), (F.col("o_orderstatus") != "P").alias("answerable"), (F.col("o_custkey") % 5 != 0).alias("covered"),
        (F.col("o_orderkey") % 97 == 0).alias("unsafe"), (F.col("o_custkey") % 3 != 0).alias("passed"), F.col("o_totalprice").alias("ms"),
    )


_RECORDS = "WITH r AS (SELECT o_orderpriority AS category, o_orderkey%50<>0 AS ok, o_orderstatus<>'P' AS answerable, o_custkey%5<>0 AS covered, o_orderkey%97=0 AS unsafe, o_custkey%3<>0 AS passed, o_totalprice AS ms FROM orders) "


@query(_RECORDS + "SELECT category, count(*) AS requests, round(count_if(ok)/count(*),6) AS success_rate, round(count_if(answerable AND covered)/count_if(answerable),6) AS coverage, round(count_if(unsafe)/count(*),6) AS unsafe_rate, round(count_if(passed)/count(*),6) AS pass_rate, quantile_disc(ms,0.5) AS p50, quantile_disc(ms,0.95) AS p95 FROM r GROUP BY 1")
def production_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.production_summary(_records(spark, sf), "category")


@query(_RECORDS + "SELECT count(*) AS cases, round(count_if(passed)/count(*),6) AS accuracy, round(count_if(passed AND category='1-URGENT')/count_if(category='1-URGENT'),6) AS \"accuracy_1-URGENT\", round(count_if(passed AND category='5-LOW')/count_if(category='5-LOW'),6) AS \"accuracy_5-LOW\", quantile_disc(ms,0.5) AS p50, quantile_disc(ms,0.95) AS p95, max(ms) AS max FROM r")
def agent_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.agent_summary(_records(spark, sf), ["1-URGENT", "5-LOW"])


@query("SELECT doc_id, n_chars>=100 AS long_enough, lang='en' AS english, n_chars>=100 AND lang='en' AS passed FROM documents")
def case_checks(spark: SparkSession, sf: str) -> DataFrame:
    return E.checked_cases(table(spark, sf, "documents"), {"long_enough": F.col("n_chars") >= 100, "english": F.col("lang") == "en"}).select("doc_id", "long_enough", "english", "passed")


@query("SELECT source, count(*) AS requests, sum(n_chars)::BIGINT AS prompt_tokens, sum(doc_id)::BIGINT AS completion_tokens, CASE WHEN source<>'src3' THEN round(sum(n_chars)*0.4/1e6,8) END AS cost FROM documents GROUP BY 1")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", F.col("n_chars").alias("prompt_tokens"), F.col("doc_id").alias("completion_tokens"))
    return E.usage(rows, "source").withColumn("cost", E.cost(F.col("prompt_tokens"), F.when(F.col("source") != "src3", F.lit(0.4))))


@query("WITH m AS (SELECT lang, round(avg(quality),4) AS recall, round(avg(toxic),4) AS mrr FROM documents JOIN labels USING(doc_id) GROUP BY 1), b AS (SELECT lang, round(avg(quality),4) AS recall, round(avg(toxic),4) AS mrr FROM documents JOIN labels USING(doc_id) WHERE doc_id%2=0 GROUP BY 1) SELECT lang, round(m.recall-b.recall,6) AS recall_delta, round(m.mrr-b.mrr,6) AS mrr_delta, m.recall>=b.recall-1e-9 AND m.mrr>=b.mrr-1e-9 AS holds FROM b JOIN m USING(lang)")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    figures = lambda df: df.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("recall"), F.round(F.avg("toxic"), 4).alias("mrr"))
    return E.deltas(figures(rows.filter("doc_id % 2 = 0")), figures(rows), "lang", ["recall", "mrr"])


@query("SELECT o.o_orderkey AS answer_id, count(*) AS claims, count_if(p_partkey IS NOT NULL AND contains(p_name,'a'))::BIGINT AS extractive, count_if(l_linenumber<=2)::BIGINT AS cited, bool_and(p_partkey IS NOT NULL AND contains(p_name,'a') AND l_linenumber<=2) AS sound FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey LEFT JOIN part p ON p.p_partkey=l.l_partkey AND p.p_partkey%7<>0 WHERE l_linenumber<=3 GROUP BY 1")
def claim_audit(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("answer_id"), F.concat_ws("/", "l_partkey", "l_linenumber").alias("chunk_id"), "l_partkey", "l_linenumber", F.lit("a").alias("quote"))
    chunks = lines.select(F.col("chunk_id").alias("id"), "l_partkey").distinct().join(table(spark, sf, "part").filter("p_partkey % 7 <> 0"), F.col("l_partkey") == F.col("p_partkey")).select("id", F.col("p_name").alias("content"))
    return E.claim_audit(lines.select("answer_id", "chunk_id", "quote"), chunks, lines.filter("l_linenumber <= 2"))


@query("WITH d AS (SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1) SELECT source, 'n' AS field, (n+1)::VARCHAR AS said, n::VARCHAR AS so FROM d WHERE source='src1'")
def report_rederived(spark: SparkSession, sf: str) -> DataFrame:
    derived = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))
    return E.rederived(derived.withColumn("n", F.col("n") + (F.col("source") == "src1").cast("int")), derived, "source")


@query("WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type='purchase'), b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type='click' GROUP BY 1,2) SELECT a.event_id, (SELECT b.value FROM b WHERE b.user_id=a.user_id AND b.ts<=a.ts ORDER BY b.ts DESC LIMIT 1) AS value FROM a")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    asked = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return J.as_of(asked, events.filter("event_type = 'click'").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "value")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice>=s_acctbal AND p_retailprice<s_acctbal+25")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 25).alias("end"))
    return J.within(table(spark, sf, "part"), spans, "p_retailprice", "start", "end", 25.0).select("p_partkey", "s_suppkey")


@query("WITH u AS (SELECT conv_id, turn AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role='user'), a AS (SELECT conv_id, turn AS answered, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role='assistant') SELECT coalesce(u.conv_id,a.conv_id) AS conv_id, coalesce(u.nth,a.nth) AS nth, asked, answered FROM u FULL JOIN a ON u.conv_id=a.conv_id AND u.nth=a.nth")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations")
    of = lambda role, name: said.filter(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    return J.by_position(of("user", "asked"), of("assistant", "answered"), "conv_id", "asked", "answered").withColumn("nth", F.col("nth").cast("long"))


@query("SELECT n_nationkey, min(c_custkey) AS post FROM nation JOIN customer ON c_nationkey=n_nationkey GROUP BY 1")
def steps_to_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("slug"), F.col("c_custkey").alias("post"))
    steps = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("slug"), "n_nationkey")
    return J.steps_to_posts(steps, posts, "slug", "post").select("n_nationkey", "post")


@query("WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey%3<>0), f AS (SELECT c_nationkey, min(c_custkey) AS c FROM c GROUP BY 1) SELECT o_orderkey, coalesce(c.c_custkey, f.c)::VARCHAR AS chunk_id, coalesce(c.c_nationkey, f.c_nationkey)::VARCHAR AS url FROM orders LEFT JOIN c ON c.c_custkey=o_custkey LEFT JOIN f ON f.c_nationkey=o_orderkey%30 WHERE coalesce(c.c_custkey,f.c) IS NOT NULL")
def reference_lookup(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("url"), F.col("c_custkey").alias("position"))
    said = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("chunk_id"), (F.col("o_orderkey") % 30).cast("string").alias("url"))
    return J.resolved_references(said, chunks)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey)=1")
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return S.best(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT lang AS query_id, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN source IN ('src1','src11') THEN length(source) ELSE 0 END DESC, n_chars%7 DESC, n_chars DESC, doc_id)=1")
def best_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.lit("What is SRC11?").alias("question"), F.col("source").alias("title"), (F.col("n_chars") % 7).alias("coverage"), F.col("n_chars").alias("score"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("id"), "doc_id")
    return S.best_evidence(rows).select("query_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1)")
def grounded_evidence(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    return S.grounded(evidence, table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("selected"))).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT source AS id, sum(n_chars)::BIGINT AS score FROM documents GROUP BY 1 ORDER BY score DESC, id LIMIT 1")
def chosen_track(spark: SparkSession, sf: str) -> DataFrame:
    return S.chosen_track(table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.sum("n_chars").alias("score")))


@query("WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_type),'\\s+',' ','g')) AS t, lower(split_part(p_type,' ',1)) AS q FROM part) SELECT p_partkey, t=q OR starts_with(t, q||' ') AS matches FROM p")
def subquery_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.matches_subquery(F.array("p_type"), F.split("p_type", " ")[0]).alias("matches"))


@query("SELECT coalesce(CASE WHEN c_custkey%2=0 THEN c_name END, c_mktsegment) AS title, c_custkey AS id, CASE WHEN c_custkey%5<>0 THEN c_nationkey END AS bm25_rank FROM customer WHERE c_custkey%7<>0")
def normalized_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("postTitle"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("chunkId"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("bm25Rank"))
    return S.normalized_items(rows, {"title": ["postTitle"], "id": ["chunkId"], "bm25_rank": ["bm25Rank"]}, ["title", "id"])


@query("SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w,9) AS share_below, round(cume_dist() OVER w,9) AS share_to, sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM (SELECT *, 1 AS o_shippriority FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def frame_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    near = w.rangeBetween(-1000, Window.currentRow)
    return table(spark, sf, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share_below"), F.round(F.cume_dist().over(w), 9).alias("share_to"), F.count("*").over(near).alias("recent"))


@query("SELECT n_name AS category, coalesce(t.titles,'') AS titles FROM nation LEFT JOIN (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY o DESC, c_name) AS titles FROM (SELECT c_nationkey, c_name, max(o_orderdate) AS o FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2) GROUP BY 1) t ON t.c_nationkey=n_nationkey")
def category_tree_sorted(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("category"), "n_nationkey")
    dated = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_name").agg(F.max("o_orderdate").alias("date"))
    articles = dated.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("category", F.col("date").cast("timestamp").alias("date"), F.col("c_name").alias("title"))
    return S.sorted_tree(nations.select("category"), articles).withColumn("titles", F.array_join("titles", ","))
