"""Links, learning tracks and category trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps that a walk over a graph may take.
MAX_STEPS = 64


def resolved_links(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Targets by source path where a link has one, else by address; whether any was found.

    ``links``: target_path, target_url, ...; ``posts``: id, path, url.  Two keyed joins, never one with OR.
    """
    by_path = posts.filter(F.coalesce("path", F.lit("")) != "").groupBy(F.col("path").alias("target_path")).agg(F.max_by("id", "id").alias("__p"))
    by_url = posts.groupBy(F.col("url").alias("target_url")).agg(F.max_by("id", "id").alias("__u"))
    out = links.join(by_path, "target_path", "left").join(by_url, "target_url", "left")
    target = F.when(F.coalesce("target_path", F.lit("")) != "", F.col("__p")).otherwise(F.col("__u"))
    return out.withColumn("target_id", target).withColumn("resolved", F.col("target_id").isNotNull()).drop("__p", "__u")


def chain_edges(steps: DataFrame) -> DataFrame:
    """A track's steps (track, step, node) as ``next`` edges and the ``prerequisite`` edges back."""
    near = steps.select("track", F.col("node").alias("a"), F.lead("node").over(Window.partitionBy("track").orderBy("step")).alias("b")).filter("b is not null")
    both = F.array(F.struct(F.lit("next").alias("relation"), F.col("a").alias("from"), F.col("b").alias("to")), F.struct(F.lit("prerequisite").alias("relation"), F.col("b").alias("from"), F.col("a").alias("to")))
    return near.select("track", F.explode(both).alias("e")).select("track", "e.relation", "e.from", "e.to")


def reachable(edges: DataFrame, start: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """Nodes that ``start`` (node) reaches over ``edges`` (from, to) and the fewest steps to each.  A graph of configuration size."""
    spark = edges.sparkSession
    edges.select(F.col("from").alias("src"), F.col("to").alias("dst")).createOrReplaceTempView("__graph_edges")
    start.select("node").createOrReplaceTempView("__graph_start")
    return spark.sql(f"""WITH RECURSIVE walk(node, steps) AS (SELECT node, 0 FROM __graph_start UNION ALL SELECT e.dst, w.steps + 1 FROM walk w JOIN __graph_edges e ON e.src = w.node WHERE w.steps < {int(steps)})
        SELECT node, min(steps) AS steps FROM walk GROUP BY node""")


def _directed(edges: DataFrame) -> DataFrame:
    """Different edges (from, to); ``alternative`` ones don't order anything, and nulls are no nodes."""
    kept = edges.filter("relation <> 'alternative'") if "relation" in edges.columns else edges
    return kept.select("from", "to").filter("`from` is not null and `to` is not null").distinct()


def layers(edges: DataFrame, folder: str) -> DataFrame:
    """Topological order: each node of the edges (from, to) with the most steps to it from any source, ``layer``.

    Sources are peeled off by rounds: a node that no remaining edge points to has the round's layer, and its edges go.  What
    stays when a round peels nothing is on a cycle or after one; its layer is null.  Nodes of one layer depend on none of
    the same, so they can be worked on together.  Each round joins the edges left with their targets once, into a table
    under ``folder``, and only a count of edges comes back.  Rounds are as many as the longest way has steps.
    """
    spark, rounds = edges.sparkSession, 0
    left = all_ = _stored(_directed(edges), f"{folder}/edges")
    remain, before = left.count(), None
    while remain and remain != before:
        targets = left.select(F.col("to").alias("from"), F.lit(True).alias("held")).distinct()
        marked = left.select("from", "to").join(targets, "from", "left").select("from", "to", F.coalesce("held", F.lit(False)).alias("held"), F.lit(rounds).alias("layer"))
        left = _stored(marked, f"{folder}/round-{rounds}").filter("held")
        remain, before, rounds = left.count(), remain, rounds + 1
    nodes = all_.select(F.explode(F.array("from", "to")).alias("node")).distinct()
    if not rounds:
        return nodes.select("node", F.lit(None).cast("long").alias("layer"))
    found = spark.read.schema(marked.schema).parquet(*(f"{folder}/round-{k}" for k in range(rounds))).filter("not held").select(F.col("from").alias("node"), "layer").distinct()
    # nodes without edges onward come right after the last that points to them, unless one of those has no layer
    into = all_.select("from", F.col("to").alias("node")).join(found.withColumnRenamed("node", "from"), "from", "left")
    ends = into.groupBy("node").agg(F.when(F.count("*") == F.count("layer"), F.max("layer") + 1).alias("__after"))
    return nodes.join(found, "node", "left").join(ends, "node", "left").select("node", F.coalesce("layer", "__after").cast("long").alias("layer"))


def _stored(df: DataFrame, place: str) -> DataFrame:
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def cyclic_core(edges: DataFrame, folder: str) -> DataFrame:
    """Edges that lie on a cycle or between two: no source of the graph leads to their start, nor their end to a sink alone."""
    both = _directed(edges)
    ahead = layers(both, f"{folder}/ahead").filter("layer is null").select("node")
    kept = both.join(ahead.withColumnRenamed("node", "from"), "from", "left_semi").join(ahead.withColumnRenamed("node", "to"), "to", "left_semi")
    back = layers(kept.select(F.col("to").alias("from"), F.col("from").alias("to")), f"{folder}/back").filter("layer is null").select("node")
    return kept.join(back.withColumnRenamed("node", "from"), "from", "left_semi").join(back.withColumnRenamed("node", "to"), "to", "left_semi").select("from", "to")


def has_cycle(edges: DataFrame, folder: str) -> bool:
    """Whether directed edges (from, to; ``alternative`` ones don't count) hold a cycle: some node has no layer."""
    return not layers(edges, folder).filter("layer is null").isEmpty()


def next_steps(steps: DataFrame, completed: list[str], k: int = 5) -> DataFrame:
    """Steps of each track that aren't completed, in order."""
    open_ = steps.filter(~F.col("node").isin(completed)) if completed else steps
    return open_.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("step"))).filter(F.col("n") <= k)


def consecutive_not_linked(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbouring steps without a ``next`` edge between them."""
    pairs = steps.select("track", F.col("node").alias("from"), F.lead("node").over(Window.partitionBy("track").orderBy("step")).alias("to")).filter("`to` is not null")
    return pairs.join(edges.filter("relation = 'next'").select("track", "from", "to"), ["track", "from", "to"], "left_anti")


def category_tree(rows: DataFrame, path: str) -> DataFrame:
    """Each prefix of the rows' category paths with the number of rows at it or below."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), "/"))
    return rows.filter(F.size(path) > 0).select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("total"))


def previous_and_next(rows: DataFrame, key: str, *order: str, by: str) -> DataFrame:
    """Each row's neighbours in the order of its group ``by`` (a track, a section)."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.select(key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"))
