"""Joins by time, range and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` of the same keys at or before its time; null if there is none,
    or if that row's value is null.

    Both sides are put in one order by key and time, so no row meets more than one other.  Of right rows at one time the
    largest value counts.
    """
    kept = [c for c in left.columns if c not in (*by, at)]
    rows = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(T.StructType([T.StructField("v", right.schema[value].dataType)]))})
    other = right.groupBy(*by, at).agg(F.struct(F.max(value).alias("v")).alias("__value")).select(*by, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept), F.lit(0).alias("__side"), "__value")
    order = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.select(*by, at, *kept, "__side", "__value").unionByName(other)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(order)["v"]).filter("__side = 1").drop("__side", "__value")


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, wide: float) -> DataFrame:
    """Points with the spans (start to before end) they stand in: an equi-join on buckets of ``wide``, checked exactly.

    Spans have levels by their length: at level n a bucket is ``wide`` * 8 ** n, and a span goes to its level's buckets, ten at
    most.  A point looks into one bucket of each level that occurs.  Choose ``wide`` of about the usual length.
    """
    length = F.greatest((F.col(end) - F.col(start)) / F.lit(wide), F.lit(1.0))
    level = F.ceil(F.log(8.0, length) - 1e-9).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (F.lit(wide) * F.pow(F.lit(8.0), F.col("__level"))))
    levelled = spans.filter(F.col(end) > F.col(start)).withColumn("__level", level)
    dealt = levelled.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    levels = levelled.agg(F.sort_array(F.collect_set("__level")).alias("__levels"))  # at most some twenty numbers
    looked = points.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__bucket", bucket(at))
    return looked.join(dealt, ["__level", "__bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__level", "__bucket")


def by_position(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of ``left`` of a key with the n-th of ``right``; rows without a counterpart stay, with nulls."""
    nth = lambda df, order: df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return nth(left, left_order).join(nth(right, right_order), [by, "nth"], "full")


def steps_to_posts(steps: DataFrame, posts: DataFrame, slug: str, post: str) -> DataFrame:
    """``steps`` with the first post (smallest ``post``) of their slug; a step without one is an error when the rows are read."""
    first = posts.groupBy(slug).agg(F.min(post).alias(post))
    joined = steps.join(first, slug, "left")
    return joined.withColumn(post, F.when(F.col(post).isNull(), F.raise_error(F.concat(F.lit("no post for step "), F.col(slug)))).otherwise(F.col(post)))


def resolved_references(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """References (chunk_id, url, ...) with the indexed chunk they mean: by id, else the first of their URL; others are dropped."""
    by_id = chunks.select(F.col("id").alias("chunk_id"), F.struct("id", "url").alias("own"))
    by_url = chunks.groupBy("url").agg(F.min_by(F.struct("id", "url"), "position").alias("first"))
    found = references.join(by_id, "chunk_id", "left").join(by_url, "url", "left").withColumn("truth", F.coalesce("own", "first"))
    return found.filter("truth is not null").drop("own", "first", "chunk_id", "url").select("*", F.col("truth.id").alias("chunk_id"), F.col("truth.url").alias("url")).drop("truth")
