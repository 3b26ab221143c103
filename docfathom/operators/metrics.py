"""Quality and latency metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("recall_at_5", "recall_at_20", "mrr_at_20", "ndcg_at_20")


def by_case(cases: DataFrame, ranks: DataFrame) -> DataFrame:
    """``cases`` (query_id, relevant, ...) with recall, reciprocal rank and gain of their relevant ranks (query_id, rank)."""
    at = lambda k, c: F.sum(F.when(F.col("rank") <= k, c))
    found = ranks.groupBy("query_id").agg(at(5, F.lit(1)).alias("h5"), at(20, F.lit(1)).alias("h20"), F.min(F.when(F.col("rank") <= 20, F.col("rank"))).alias("first"), at(20, 1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(20)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = cases.join(found, "query_id", "left")
    return out.withColumns({
        "recall_at_5": zero(F.col("h5") / F.col("relevant")), "recall_at_20": zero(F.col("h20") / F.col("relevant")), "hit_at_5": (zero(F.col("h5").cast("double")) > 0).cast("double"),
        "mrr_at_20": zero(1.0 / F.col("first")), "ndcg_at_20": zero(F.col("dcg") / ideal),
    }).drop("h5", "h20", "first", "dcg")


def summary(by_cases: DataFrame, *groups: str) -> DataFrame:
    return by_cases.groupBy(*groups).agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 4).alias(c) for c in NAMES))


def percentile(column: str, p: float) -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")


def ratio(a: Column, b: Column) -> Column:
    """1 if there is nothing to measure."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))


def safe_rate(a: Column, b: Column) -> Column:
    """Null if there is nothing to measure."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rejection_accuracy(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("cases"), F.coalesce(F.round(F.avg(F.col("rejected").cast("double")), 4), F.lit(0.0)).alias("rejection_accuracy"))


def calibration(scored: DataFrame, thresholds: list[float], least: dict[str, float]) -> DataFrame:
    """Precision and recall on each threshold of a grid, and whether it is eligible; the best is the largest eligible one.

    ``scored``: split (calibration or holdout), score, truth.
    """
    spark = scored.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    says = F.col("score") >= F.col("threshold")
    by = scored.crossJoin(F.broadcast(grid)).groupBy("split", "threshold").agg(F.count_if(says & F.col("truth")).alias("tp"), F.count_if(says & ~F.col("truth")).alias("fp"), F.count_if(~says & F.col("truth")).alias("fn"))
    by = by.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    eligible = F.lit(True)
    for name, value in least.items():
        eligible = eligible & (F.col(name) >= value)
    return by.withColumn("eligible", eligible)


def chosen_threshold(grid: DataFrame) -> DataFrame:
    """The largest threshold eligible on the calibration split, with its figures on the holdout."""
    best = grid.filter("split = 'calibration' and eligible").agg(F.max("threshold").alias("threshold"))
    return grid.filter("split = 'holdout'").join(F.broadcast(best), "threshold").select("threshold", "precision", "recall", "eligible")
