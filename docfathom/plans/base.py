"""Registration of queries and the binding of the engine's entities to tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.operators.index import CACHE, Index

ORIGIN = "https://example.org"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores if the table has fewer files than there are: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def shared_place(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the folder that driver and executors share, or in one of our own in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix=f'docfathom-{kind}-')}/{kind}-{uuid.uuid4().hex}"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the first sentence is the title, the language a tag, the source a category."""
    first = F.trim(F.regexp_extract("text", r"^[^.\n]*", 0))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("position"), F.when(first == "", "untitled").otherwise(first).alias("title"),
        F.concat(F.lit("/d/"), F.col("doc_id"), F.lit("/")).alias("url"), F.array("lang").alias("tags"), F.array("source").alias("categories"), F.lit("").alias("section"), F.col("text").alias("content"),
        "lang", "source",
    )


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """The inverted index of ``chunks``; it is made once for the same files."""
    return CACHE.of(chunks(spark, sf_dir), table(spark, sf_dir, "documents"), shared_place(spark, "index"), ORIGIN)


def questions(spark: SparkSession, sf_dir: str, words: int = 6) -> DataFrame:
    """The first words of each benchmark item as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split(X.normalized(F.col("text")), " "), 1, words), " ").alias("question"))


#: The same in SQL: ``d`` (chunks) and ``q`` (questions).
DOCS = r"""d AS (SELECT doc_id AS position, 'doc_'||doc_id AS id, CASE WHEN trim(regexp_extract(text,'^[^.\n]*'))='' THEN 'untitled' ELSE trim(regexp_extract(text,'^[^.\n]*')) END AS title,
 lang, source, text AS content, trim(regexp_replace(lower(text),'\s+',' ','g')) AS body FROM documents WHERE trim(text)<>'')"""
ASKED = r"""q AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(text),'\s+',' ','g')),' '),1,6),' ') AS question FROM benchmark)"""
TERM = "[a-z0-9][a-z0-9_.+#-]*"
#: Scores ``s`` (query_id, id, position, score) of all pairs above 0.
BM25 = rf"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(body,'{TERM}')) AS term FROM d) GROUP BY 1,2),
ln_ AS (SELECT id, greatest(len(regexp_extract_all(body,'{TERM}')),1) AS length FROM d), st AS (SELECT count(*) AS n, avg(length) AS a FROM ln_),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(question,'{TERM}'))) AS term FROM q),
m AS (SELECT query_id, tf.id, sum(ln(1+(n-df+0.5)/(df+0.5))*(tf*2.2)/(tf+1.2*(0.25+0.75*length/a))) AS s FROM qt JOIN tf USING(term) JOIN df USING(term) JOIN ln_ ON ln_.id=tf.id CROSS JOIN st GROUP BY 1,2),
qq AS (SELECT query_id, question, list_distinct(regexp_extract_all(question,'{TERM}')) AS terms FROM q),
dd AS (SELECT id, trim(regexp_replace(lower(title),'\s+',' ','g')) AS t, trim(lower(lang||' '||source)) AS mm, body FROM d),
b AS (SELECT query_id, id, (CASE WHEN question<>'' AND contains(body,question) THEN 8.0 ELSE 0.0 END)+(CASE WHEN question<>'' AND contains(t,question) THEN 12.0 ELSE 0.0 END)
 +4.0*len(list_filter(terms, lambda x: contains(t,x)))+2.0*len(list_filter(terms, lambda x: contains(mm,x))) AS s FROM dd CROSS JOIN qq),
s AS (SELECT query_id, u.id, d.position, sum(u.s) AS score FROM (SELECT * FROM m UNION ALL SELECT query_id,id,s::double FROM b WHERE s>0) u JOIN d ON d.id=u.id GROUP BY 1,2,3 HAVING sum(u.s)>0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, position) AS rank FROM s)"""
