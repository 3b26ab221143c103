"""Mergeable summaries: quantile and distinct-count sketches a day and group, kept as a table and merged for any period.

A day's rows are read once; a period's figures come from the sketches of its days, some kilobytes each, whatever the rows.
Quantiles (KLL, ``k``): the share of values at or below the answer is within ``rank_error(k)`` of what was asked, each with
99 % probability.  Distinct counts (HLL, ``2 ** lg`` counters): within ``count_error(lg)``, three standard deviations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, LG = 200, 12


def rank_error(k: int = K) -> float:
    """The published bound of a quantile sketch for one rank, at 99 % confidence."""
    return 2.296 / k**0.9021


def count_error(lg: int = LG) -> float:
    return 3 * 1.04 / 2 ** (lg / 2)


def daily(rows: DataFrame, at: str, value: str, item: str, *groups: str, k: int = K, lg: int = LG) -> DataFrame:
    """A row for each day of ``at`` and group: number of rows, sum of ``value``, sketches of its values and of ``item``.

    Sketches are partial aggregates, so a hot group shuffles one sketch a task.  Null values and items are counted as rows and
    left out of sketches; a group of nulls is a group; rows without time belong to the null day.
    """
    return rows.groupBy(F.col(at).cast("date").alias("day"), *groups).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("values"), F.hll_sketch_agg(item, F.lit(lg)).alias("items")
    )


def keep(days: DataFrame, folder: str) -> None:
    """Write days into the table under ``folder``: days that come again replace what was there, others stay."""
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def kept(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days from ``first`` to ``last`` (inclusive; None: open); others are not read."""
    days = spark.read.parquet(folder)
    if first is not None:
        days = days.filter(F.col("day") >= F.lit(first).cast("date"))
    return days if last is None else days.filter(F.col("day") <= F.lit(last).cast("date"))


def merged(days: DataFrame, *groups: str | Column, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Figures of each group over all its days: n, total, ``p50`` and so on by ``ranks`` (null: no values), and ``different`` items."""
    out = days.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("values").alias("__v"), F.hll_union_agg("items").alias("__i"))
    held = F.kll_sketch_get_n_double("__v") > 0
    figures = {f"p{rank * 100:g}": F.when(held, F.kll_sketch_get_quantile_double("__v", F.lit(rank))) for rank in ranks}
    return out.withColumns(figures).withColumn("different", F.hll_sketch_estimate("__i")).drop("__v", "__i")


def by_grouping_sets(rows: DataFrame, groups: tuple[str, ...], sets: list[tuple[str, ...]], **figures: Column) -> DataFrame:
    """Exact ``figures`` for each set of ``groups`` in one pass; ``level`` has a bit for each group that a row sums over, so a null group is told from a total."""
    return rows.groupingSets([list(map(F.col, s)) for s in sets], *map(F.col, groups)).agg(F.grouping_id().cast("long").alias("level"), *(f.alias(name) for name, f in figures.items()))
