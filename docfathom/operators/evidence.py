"""Evidence: grading, mentions of titles, sentences, and packing of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import text as X

from .patterns import occurrences, separate

#: Gates and limits (fixed values).
SITE, PAGE, COMPOUND, TARGET, TOPIC, VECTOR = 0.30, 0.35, 0.30, 0.45, 0.50, 0.30
MAX_CHUNKS, MAX_CHARACTERS, MAX_TOKENS, PER_POST = 8, 12000, 6000, 3
#: Questions and what speaks for an answer to them (fixed values).
DIRECTNESS = (
    ("缺点|局限|不足|问题|风险|代价|劣势", "缺点|局限|不足|问题|风险|代价|劣势|瓶颈|无法|难以"),
    ("优点|优势|好处|价值", "优点|优势|好处|价值|提升|降低|减少|更快|更准"),
    ("为什么|原因|为何", "因为|由于|原因|导致|因此|所以|取决于"),
    ("如何|怎么|怎样|流程|步骤", "通过|首先|然后|最后|先|再|步骤|流程|使用|计算|检索|构建"),
    ("用途|作用|解决什么|用来做什么|适用场景", "用于|用来|作用|解决|适用|场景|召回|推荐|检索|预测"),
    ("是什么|定义|结构|组成|原理", "是|指|定义|结构|组成|包含|由|根据|一种|原理"),
)
_EMPTY_TERMS = "^(文章|相关|内容|博客|继续|展开)$"


def meaningful(question: Column) -> Column:
    return F.filter(X.question_terms(question), lambda t: ~t.rlike(_EMPTY_TERMS))


def searchable() -> Column:
    return X.normalized(F.concat_ws(" ", "title", X.text(F.col("section")), F.array_join("tags", " "), F.array_join("categories", " "), "content"))


def candidate_score(question: Column, vector_score: Column) -> Column:
    """Share of the question's terms, or of the similarity beyond its gate (up to 1 at 0.6)."""
    words = meaningful(question)
    lexical = F.when(F.size(words) == 0, 1.0).otherwise(X.coverage(words, searchable()))
    semantic = F.when(vector_score >= VECTOR, F.least(F.lit(1.0), vector_score / 0.6)).otherwise(0.0)
    return F.greatest(lexical, semantic)


def directness(question: Column, content: Column) -> Column:
    """Whether the content has what the question's kind needs; true for questions of no kind."""
    out = F.lit(True)
    for asked, wanted in reversed(DIRECTNESS):
        out = F.when(question.rlike(asked), content.rlike(wanted)).otherwise(out)
    return out


def graded(candidates: DataFrame, threshold: float = SITE) -> DataFrame:
    """Best evidence of each query's candidates and whether it suffices."""
    score = candidate_score(F.col("question"), F.col("vector_score") if "vector_score" in candidates.columns else F.lit(0.0))
    best = candidates.withColumn("s", score).groupBy("query_id").agg(F.max("s").alias("best"), F.count("*").alias("candidates"))
    return best.withColumn("sufficient", F.col("best") >= threshold)


def packed(candidates: DataFrame, most: int = MAX_CHUNKS, characters: int = MAX_CHARACTERS, tokens: int = MAX_TOKENS, per_post: int = PER_POST) -> DataFrame:
    """Context of each query: in rank order what still fits; what doesn't is left out and the next is tried.

    ``candidates``: query_id, id, rank, url, content; the lists are rankings, so bounded.  A token is a code point here.
    """
    item = F.struct("rank", "id", "url", F.md5(X.normalized(F.col("content")).cast("binary")).alias("seen"), F.length("content").alias("n"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast("array<struct<id:string,url:string,seen:string,n:int>>")

    def fold(acc: Column, x: Column) -> Column:
        used = F.aggregate(acc, F.lit(0), lambda s, y: s + y["n"])
        fits = (F.size(acc) < most) & (used + x["n"] <= min(characters, tokens)) & ~F.exists(acc, lambda y: (y["id"] == x["id"]) | (y["seen"] == x["seen"]))
        fits = fits & (F.size(F.filter(acc, lambda y: y["url"] == x["url"])) < per_post)
        return F.when(fits, F.concat(acc, F.array(F.struct(x["id"].alias("id"), x["url"].alias("url"), x["seen"].alias("seen"), x["n"].alias("n"))))).otherwise(acc)

    return lists.select("query_id", F.posexplode(F.aggregate("items", empty, fold)).alias("place", "one")).select("query_id", "place", F.col("one.id").alias("id"), F.col("one.n").alias("characters"))


def mentions(rows: DataFrame, titles: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Titles that a normalized text contains, with the first place: ``keys``, title, at."""
    return occurrences(rows, column, keys, titles, "title", first=True).withColumnRenamed("start", "at")


def separate_mentions(rows: DataFrame, titles: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Occurrences of titles, longest first, none overlapping one already taken; in order of place."""
    return separate(rows, column, keys, titles, "title")


def mentioned_titles(rows: DataFrame, titles: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Each title once, by its first separate mention: ``keys``, nth (from 0), title."""
    first = separate_mentions(rows, titles, column, keys).groupBy(*keys, "title").agg(F.min("place").alias("place"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1).select(*keys, "nth", "title")


def best_sentences(rows: DataFrame, key: str, column: str, words: list[str]) -> DataFrame:
    """The sentence of each text with most of the words; the first of those."""
    parts = rows.select(key, F.posexplode(F.split(column, r"\.")).alias("i", "x")).withColumn("sentence", F.trim("x")).filter(F.col("sentence") != "")
    hits = sum((F.when(F.lower("sentence").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    best = parts.withColumn("hits", hits.cast("int")).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hits"), "i")))
    return best.filter("k = 1").select(key, "sentence", "hits")
