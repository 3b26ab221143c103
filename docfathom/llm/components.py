"""Connected components of an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_stored, stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Columns ``a`` and ``b`` (long) to ``node`` and ``root``: each node's smallest reachable node.

    Nodes without an edge to another node are not in the result.  Every round is
    written to the shared folder; nothing but the tables' sizes reaches the driver.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = stored(turned.union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        said = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(now)
        now = following
        if said == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = said
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
