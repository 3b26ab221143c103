"""Queries of index maintenance, audits, sets and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.functions.hashing import content_hash as hashed
from docfathom.operators import graph as G
from docfathom.operators import integrity as I
from docfathom.operators import metrics as M
from docfathom.sources import publication as P

from .base import query, shared_place, table


def _now(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), hashed(F.col("text")).alias("content_hash"))


def _before(spark: SparkSession, sf: str) -> DataFrame:
    """The index before: other documents missing, and every seventh text changed since."""
    return table(spark, sf, "documents").filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(hashed(F.col("text"))).alias("content_hash"))


_BOTH = """WITH n AS (SELECT doc_id AS id, 'sha256:'||sha256(text) AS h FROM documents WHERE doc_id%10<>0), b AS (SELECT doc_id AS id, CASE WHEN doc_id%7=0 THEN 'old' ELSE 'sha256:'||sha256(text) END AS h FROM documents WHERE doc_id%11<>0),
s AS (SELECT coalesce(n.id,b.id) AS id, CASE WHEN n.id IS NULL THEN 'deleted' WHEN b.id IS NULL THEN 'added' WHEN n.h=b.h THEN 'reused' ELSE 'updated' END AS status FROM n FULL JOIN b ON n.id=b.id) """


@query(_BOTH + "SELECT status, count(*) AS n FROM s GROUP BY 1")
def cdc_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return I.changes(_now(spark, sf), _before(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query(_BOTH + ", c AS (SELECT count(*) FILTER (WHERE status='added') AS added, count(*) FILTER (WHERE status='deleted') AS deleted, count(*) FILTER (WHERE status='updated') AS updated, count(*) FILTER (WHERE status='reused') AS reused FROM s) SELECT *, updated+reused AS retained, round(deleted/(deleted+updated+reused),6) AS deleted_ratio, round(added/(added+updated+reused),6) AS added_ratio FROM c")
def id_diff_churn(spark: SparkSession, sf: str) -> DataFrame:
    return I.id_churn(_before(spark, sf), _now(spark, sf))


@query(_BOTH + "SELECT count(*) FILTER (WHERE status='added') AS missing, count(*) FILTER (WHERE status='deleted') AS extra, count(*) FILTER (WHERE status='updated') AS stale, 0::BIGINT AS zero, count(*) FILTER (WHERE status<>'reused')=0 AS complete FROM s")
def index_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return I.completeness(_now(spark, sf), _before(spark, sf).withColumn("values", F.array(F.lit(1.0))))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id%3<>0 AND label%2=0")
def vector_join_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    chunks = rows.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), F.lit("h").alias("content_hash"))
    vectors = rows.select(F.col("vec_id").alias("id"), F.lit("h").alias("content_hash"), F.when(F.col("label") % 2 == 0, "f").otherwise("g").alias("fingerprint"), F.col("embedding").alias("values"), "label")
    return I.usable_vectors(chunks, vectors, "f", 64).select(F.col("id").alias("vec_id"), "label")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>10)")
def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return I.orphans(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").filter("l_quantity > 10"), "o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT doc_id, f AS field FROM documents, (VALUES ('lang'),('n_chars')) v(f) WHERE (f='lang' AND lang='fr') OR (f='n_chars' AND doc_id%5=0)")
def metadata_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    right = left.withColumn("lang", F.when(F.col("lang") == "fr", None).otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return I.mismatches(left, right, "doc_id", ["lang", "n_chars", "source"])


@query(r"WITH k AS (SELECT doc_id, md5(trim(regexp_replace(lower(text),'\s+',' ','g'))) AS c FROM documents) SELECT c AS content_key, count(*) AS size, min(doc_id) AS first, array_to_string(list_slice(list_sort(list(doc_id)),1,20),',') AS sample FROM k GROUP BY 1 HAVING count(*)>1")
def duplicate_content_audit(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicate_content(table(spark, sf, "documents"), "doc_id", "text").withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query("SELECT lang, count(*) AS chunks, count(DISTINCT source) AS sources, min(n_chars) AS tokens_min, quantile_disc(n_chars,0.5) AS tokens_p50, quantile_disc(n_chars,0.95) AS tokens_p95, max(n_chars) AS tokens_max, count(*)-count(DISTINCT text) AS duplicated FROM documents GROUP BY 1")
def ingestion_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", "source", F.col("n_chars").alias("tokens"), F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    out = I.report(rows, "lang")
    return out.withColumns({c: F.col(c).cast("long") for c in ("tokens_p50", "tokens_p95")})


@query("SELECT quantile_disc(n_chars,0.5) AS p50, quantile_disc(n_chars,0.95) AS p95, quantile_disc(n_chars,0.99) AS p99 FROM documents")
def percentile_disc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(*(M.percentile("n_chars", p / 100).cast("long").alias(f"p{p}") for p in (50, 95, 99)))


@query(r"SELECT rule, n FROM (SELECT count(*) FILTER (WHERE trim(text)='') AS empty, count(*) FILTER (WHERE n_chars<40) AS short, count(*) FILTER (WHERE n_chars>20000) AS long, count(*) FILTER (WHERE contains(text,' | ')) AS \"table\", count(*) FILTER (WHERE regexp_matches(text,'\$\$')) AS formula FROM documents) UNPIVOT (n FOR rule IN (empty, short, long, \"table\", formula))".replace('\\"', '"'))
def anomaly_audit(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    rules = {"empty": F.trim(text) == "", "short": F.col("n_chars") < 40, "long": F.col("n_chars") > 20000, "table": text.contains(" | "), "formula": text.rlike(r"\$\$")}
    return I.anomalies(table(spark, sf, "documents"), rules)


_CAL = """WITH s AS (SELECT CASE WHEN doc_id%3=0 THEN 'holdout' ELSE 'calibration' END AS split, n_chars/5000.0 AS score, quality=1 AS truth FROM documents JOIN labels USING(doc_id)),
g AS (SELECT split, t AS threshold, count(*) FILTER (WHERE score>=t AND truth) AS tp, count(*) FILTER (WHERE score>=t AND NOT truth) AS fp, count(*) FILTER (WHERE score<t AND truth) AS fn FROM s, (VALUES (0.05::DOUBLE),(0.1),(0.2),(0.4),(0.8)) v(t) GROUP BY 1,2),
p AS (SELECT *, coalesce(tp/nullif(tp+fp,0),1) AS precision, coalesce(tp/nullif(tp+fn,0),1) AS recall FROM g) """


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    scored = rows.select(F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("calibration").alias("split"), (F.col("n_chars") / 5000.0).alias("score"), (F.col("quality") == 1).alias("truth"))
    return M.calibration(scored, [0.05, 0.1, 0.2, 0.4, 0.8], {"precision": 0.85})


@query(_CAL + "SELECT split, threshold, tp, fp, fn, round(precision,6) AS precision, round(recall,6) AS recall FROM p")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("split", "threshold", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_CAL + "SELECT threshold, round(precision,6) AS precision, round(recall,6) AS recall FROM p WHERE split='holdout' AND threshold=(SELECT max(threshold) FROM p WHERE split='calibration' AND precision>=0.85)")
def threshold_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return M.chosen_threshold(_grid(spark, sf)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("WITH b AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey) SELECT path, count(*) AS total FROM (SELECT r_name AS path FROM b UNION ALL SELECT r_name||'/'||n_name FROM b UNION ALL SELECT r_name||'/'||n_name||'/'||c_mktsegment FROM b) GROUP BY 1")
def category_tree_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return G.category_tree(rows.select(F.array("r_name", "n_name", "c_mktsegment").alias("path")), "path")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal),2) AS total FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey GROUP BY ROLLUP(r_name, n_name)")
def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN p.c_custkey ELSE u.c_custkey END AS target_id, (CASE WHEN o_orderkey%2=0 THEN p.c_custkey ELSE u.c_custkey END) IS NOT NULL AS resolved FROM orders LEFT JOIN customer p ON o_orderkey%2=0 AND p.c_custkey%5<>0 AND p.c_custkey=o_custkey LEFT JOIN customer u ON u.c_custkey=o_custkey+1")
def link_left_join_either_key(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("target_path"), (F.col("o_custkey") + 1).cast("string").alias("target_url"))
    posts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("path"), F.col("c_custkey").cast("string").alias("url"))
    return G.resolved_links(links, posts).select("o_orderkey", "target_id", "resolved")


@query("WITH p AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus<>'P' GROUP BY 1) SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM p)")
def legacy_semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    first = I.first_by(table(spark, sf, "orders").filter("o_orderstatus <> 'P'"), ["o_custkey"], "o_orderkey")
    return table(spark, sf, "customer").join(first.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT doc_id, 'metadata' AS block_type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_metadata_only(spark: SparkSession, sf: str) -> DataFrame:
    return I.orphans(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "doc_id").withColumn("block_type", F.lit("metadata"))


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a, _ = _keys(spark, sf)
    return a.join(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _keys(spark, sf)
    return a.join(b, "k", "left_semi").distinct()


@query("SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderstatus)))=['F','O'] AS same FROM orders GROUP BY 1")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.array_sort(F.collect_set("o_orderstatus")) == F.array(F.lit("F"), F.lit("O"))).alias("same"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber)-1 AS occurrence FROM lineitem")
def occurrence_index(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ordinal FROM lineitem WHERE l_linestatus='F'")
def code_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("ordinal"))


@query("SELECT c_custkey, lag(c_custkey) OVER w AS previous, lead(c_custkey) OVER w AS next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def prev_next_nav(spark: SparkSession, sf: str) -> DataFrame:
    return G.previous_and_next(table(spark, sf, "customer"), "c_custkey", "c_custkey", by="c_nationkey")


@query("WITH u AS (SELECT o_custkey AS k, 1 AS priority, o_orderkey AS \"at\" FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_orderstatus='O' UNION ALL SELECT o_custkey, 3, o_orderkey FROM orders WHERE o_orderstatus='P') SELECT k, priority, u.\"at\" FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, u.\"at\")=1")
def reference_merge_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("priority"), F.col("o_orderkey").alias("at"))
    return I.first_by(rows, ["k"], "priority", "at")


@query("WITH p AS (SELECT item_id, i FROM benchmark, range(1,4) v(i)) SELECT item_id, i AS iteration FROM p WHERE NOT ((item_id+i)%2=0)")
def resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "benchmark").select("item_id").crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "iteration")))
    done = plan.filter((F.col("item_id") + F.col("iteration")) % 2 == 0)
    return plan.join(done, ["item_id", "iteration"], "left_anti")


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_regionkey").alias("track"), F.col("n_nationkey").alias("step"), F.col("n_name").alias("node"))


_EDGES = "WITH s AS (SELECT n_regionkey AS track, n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation), e AS (SELECT track, 'next' AS relation, a AS \"from\", b AS \"to\" FROM s WHERE b IS NOT NULL UNION ALL SELECT track, 'prerequisite', b, a FROM s WHERE b IS NOT NULL) "


@query(_EDGES + "SELECT * FROM e")
def graph_edges_linear(spark: SparkSession, sf: str) -> DataFrame:
    return G.chain_edges(_tracks(spark, sf))


@query("WITH RECURSIVE s AS (SELECT n_regionkey AS track, n_name AS a, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation), w(node, steps) AS (SELECT min(n_name), 0 FROM nation WHERE n_nationkey=(SELECT min(n_nationkey) FROM nation) UNION ALL SELECT s.b, w.steps+1 FROM w JOIN s ON s.a=w.node WHERE s.b IS NOT NULL AND w.steps<64) SELECT node, min(steps) AS steps FROM w GROUP BY 1")
def graph_reachability(spark: SparkSession, sf: str) -> DataFrame:
    tracks = _tracks(spark, sf)
    start = tracks.join(tracks.agg(F.min("step").alias("step")), "step", "left_semi").select("node")
    return G.reachable(G.chain_edges(tracks).filter("relation = 'next'"), start)


@query("SELECT track, node, n FROM (SELECT n_regionkey AS track, n_name AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation WHERE n_nationkey%3<>0) WHERE n<=2")
def learning_path_next(spark: SparkSession, sf: str) -> DataFrame:
    tracks = _tracks(spark, sf)
    done = [r["node"] for r in tracks.filter("step % 3 = 0").collect()]  # a reader's completed list
    return G.next_steps(tracks, done, 2).select("track", "node", F.col("n").cast("long").alias("n"))


_ORDERED = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
e AS (SELECT a.k AS a, b.k AS b FROM o a JOIN o b ON a.c=b.c AND (b.i=a.i+1 OR (b.i=a.i+3 AND a.p='1-URGENT') OR (a.i=5 AND b.i=2 AND a.c%20=0))),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a=t.b), y AS (SELECT a AS k FROM t WHERE a=b UNION SELECT t.b FROM t JOIN (SELECT a AS r FROM t WHERE a=b) ON t.a=r),
w(k, n) AS (SELECT a, 0::BIGINT FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, n+1 FROM w JOIN e ON e.a=w.k WHERE e.b NOT IN (SELECT k FROM y))
SELECT k AS node, max(n) AS layer FROM (SELECT k, n FROM w UNION ALL SELECT k, NULL FROM y) GROUP BY 1"""


@query(_ORDERED)
def topological_layers(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as a track: each before the next, urgent ones also before the third after; some tracks run in a circle."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey")
    back = F.lag(key, 3).over(w)  # of the fifth order: the second
    to = F.array(F.lead(key).over(w), F.when(F.col("o_orderpriority") == "1-URGENT", F.lead(key, 3).over(w)), F.when((F.row_number().over(w) == 5) & (F.col("o_custkey") % 20 == 0), back))
    edges = table(spark, sf, "orders").select(key.alias("from"), to.alias("to")).select("from", F.explode("to").alias("to"))
    return G.layers(edges, shared_place(spark, "layers"))


@query("SELECT 'corpus_'||substring(sha256(string_agg(name||':'||hash, chr(10) ORDER BY name)),1,24) AS version, count(*) AS files, sum(n)::BIGINT AS rows FROM (SELECT lang AS name, sha256(sum(('0x'||substring(sha256(text),1,12))::BIGINT)::VARCHAR) AS hash, count(*) AS n FROM documents GROUP BY 1)")
def manifest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The languages stand for files; a file's hash sums its rows' hashes, so that it is one partial aggregate."""
    part = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    files = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.sha2(F.sum(part).cast("string").cast("binary"), 256).alias("hash"), F.count("*").alias("rows"))
    return I.manifest(files)


@query("SELECT 'short' AS rule, doc_id::VARCHAR AS id FROM documents WHERE n_chars<40 UNION ALL SELECT 'lang', doc_id::VARCHAR FROM documents WHERE lang NOT IN ('en','fr')")
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return I.violations(table(spark, sf, "documents"), "doc_id", {"short": F.col("n_chars") >= 40, "lang": F.col("lang").isin("en", "fr")})


@query("SELECT doc_id AS id FROM documents WHERE doc_id%9=0")
def source_rebuild_audit(spark: SparkSession, sf: str) -> DataFrame:
    built = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", hashed(F.col("text")).alias("h"))
    return I.rebuilt_equal(built, built.withColumn("lang", F.when(F.col("id") % 9 == 0, "xx").otherwise(F.col("lang"))), "id")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS labels FROM orders GROUP BY 1")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("labels"))


@query("SELECT source AS profile, count(*) AS n FROM documents GROUP BY 1")
def count_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = F.when(X.text(F.col("source")) != "", F.col("source"))
    return table(spark, sf, "documents").filter(profile.isNotNull()).groupBy(profile.alias("profile")).agg(F.count("*").alias("n"))


@query("""SELECT 'vec_'||vec_id AS id, CASE WHEN vec_id%7=0 THEN 'added' WHEN vec_id%11=0 THEN 'updated' ELSE 'reused' END AS status, md5(vec_id||'.2') AS content_hash, len(embedding)::BIGINT AS dimensions,
 round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),4) AS norm FROM embeddings WHERE vec_id%13<>0""")
def index_publication(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all vectors published twice: a seventh comes new, an eleventh changes, a thirteenth goes.  What readers see then."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("vec_"), "vec_id").alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("values"))
    hashed_as = lambda n: F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(n)).cast("binary"))
    folder, size = shared_place(spark, "publication"), rows.select(F.size("values")).first()[0]
    before = rows.filter("vec_id % 7 <> 0").withColumn("content_hash", F.when(F.col("vec_id") % 11 == 0, hashed_as(".1")).otherwise(hashed_as(".2")))
    now = rows.filter("vec_id % 13 <> 0").withColumn("content_hash", hashed_as(".2"))
    given = lambda todo: todo.select("id", "values")  # noqa: E731  the table has the vectors
    P.publish(before, given, folder, "f1", size, version="v1")
    P.publish(now, given, folder, "f1", size, version="v2")
    status = I.changes(now, P.read(spark, folder, P.VECTORS, "v1"))
    norm = F.round(F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)), 4)
    return P.read(spark, folder, P.VECTORS).join(status, "id").select("id", "status", "content_hash", F.size("values").cast("long").alias("dimensions"), norm.alias("norm"))
