"""Summaries of evaluation runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import percentile, safe_rate


def passed(checks: dict[str, Column]) -> Column:
    """Whether all checks are true; one that is unknown fails."""
    return reduce(and_, (F.coalesce(c, F.lit(False)) for c in checks.values()), F.lit(True))


def checked_cases(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``cases`` with a column for each check and ``passed``."""
    return cases.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}).withColumn("passed", reduce(and_, (F.col(n) for n in checks), F.lit(True)))


def production_summary(records: DataFrame, *by: str) -> DataFrame:
    """Rates of records (ok, answerable, covered, unsafe, passed, ms) and their latency, by nearest rank; of nothing a rate is null."""
    return records.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.round(safe_rate(F.count_if("ok"), F.count("*")), 6).alias("success_rate"),
        F.round(safe_rate(F.count_if(F.col("answerable") & F.col("covered")), F.count_if("answerable")), 6).alias("coverage"),
        F.round(safe_rate(F.count_if("unsafe"), F.count("*")), 6).alias("unsafe_rate"),
        F.round(safe_rate(F.count_if("passed"), F.count("*")), 6).alias("pass_rate"),
        percentile("ms", 0.5).alias("p50"),
        percentile("ms", 0.95).alias("p95"),
    )


def agent_summary(results: DataFrame, categories: list[str]) -> DataFrame:
    """One row: pass rate over all results (category, passed, ms), over those of each category, and latency."""
    accuracy = [F.round(safe_rate(F.count_if((F.col("category") == c) & F.col("passed")), F.count_if(F.col("category") == c)), 6).alias(f"accuracy_{c}") for c in categories]
    return results.agg(F.count("*").alias("cases"), F.round(safe_rate(F.count_if("passed"), F.count("*")), 6).alias("accuracy"), *accuracy, percentile("ms", 0.5).alias("p50"), percentile("ms", 0.95).alias("p95"), F.max("ms").alias("max"))


def cost(tokens: Column, rate: Column) -> Column:
    """Price of tokens at a rate for a million, to 8 places; null where no rate is configured."""
    return F.when(rate.isNotNull() & (rate >= 0), F.round(tokens * rate / 1e6, 8))


def usage(records: DataFrame, *by: str) -> DataFrame:
    """Sums of ``prompt_tokens`` and ``completion_tokens``, and requests."""
    return records.groupBy(*by).agg(F.count("*").alias("requests"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def deltas(baseline: DataFrame, candidate: DataFrame, by: str, names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Differences of figures by category, and whether none falls by more than ``tolerance``."""
    a = baseline.select(by, *(F.col(n).alias(f"{n}_before") for n in names))
    out = a.join(candidate.select(by, *names), by)
    out = out.withColumns({f"{n}_delta": F.round(F.col(n) - F.col(f"{n}_before"), 6) for n in names})
    return out.withColumn("holds", reduce(and_, (F.col(n) >= F.col(f"{n}_before") - tolerance for n in names))).select(by, *(f"{n}_delta" for n in names), "holds")


def claim_audit(claims: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """By answer: claims, those whose chunk is indexed and has the quote, those that are cited, and whether all are both."""
    found = claims.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "left")
    found = found.join(citations.select("answer_id", "chunk_id").distinct().withColumn("__cited", F.lit(True)), ["answer_id", "chunk_id"], "left")
    extractive, cited = F.coalesce(F.contains("content", "quote"), F.lit(False)), F.coalesce("__cited", F.lit(False))
    return found.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(extractive).alias("extractive"), F.count_if(cited).alias("cited"), F.bool_and(extractive & cited).alias("sound"))


def rederived(report: DataFrame, derived: DataFrame, by: str) -> DataFrame:
    """Fields of a report that differ from what the data say now: key, field, what is said and what is so, as text."""
    fields = [c for c in report.columns if c != by]
    long = lambda df, name: df.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields))).alias("f")).select(by, "f.*")
    return long(report, "said").join(long(derived, "so"), [by, "field"], "full").filter(~F.col("said").eqNullSafe(F.col("so")))
