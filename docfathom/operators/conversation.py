"""Conversations: windows over turns, memory, idempotent requests, receipts and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import percentile, safe_rate

#: Limits of a request and of memory (fixed values).
MAX_MESSAGES, MAX_CHARACTERS, MAX_MESSAGE = 8, 8000, 2000
KEPT_MESSAGES, KEPT_TOPICS, KEPT_PROGRESS, KEPT_PREFERENCES = 12, 20, 50, 20
MEMORY_DAYS, REQUEST_HOURS, RECEIPT_HOURS, RECEIPT_MAX_HOURS = 30, 24, 24, 48
ROLES = ("user", "assistant")


def trimmed(turns: DataFrame, most: int = MAX_MESSAGES, characters: int = MAX_CHARACTERS) -> DataFrame:
    """The latest turns of each conversation that fit; the newest always stays; leading assistant turns go.

    ``turns``: conv_id, turn, role, text.  If no user turn remains, the newest turn does.
    """
    known = turns.filter(F.col("role").isin(*ROLES))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    sized = known.withColumn("__n", F.row_number().over(newest)).withColumn("__size", F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = sized.filter((F.col("__n") == 1) | ((F.col("__n") <= most) & (F.col("__size") <= characters)))
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kept = kept.withColumn("__first", first)
    return kept.filter((F.col("turn") >= F.col("__first")) | (F.col("__first").isNull() & (F.col("__n") == 1))).drop("__n", "__size", "__first")


def latest_assistant(turns: DataFrame) -> DataFrame:
    return turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def invalid_turns(turns: DataFrame) -> DataFrame:
    """Turns that a request may not hold, with the reason."""
    reason = F.when(~F.col("role").isin(*ROLES), "INVALID_ROLE").when(F.trim("text") == "", "EMPTY_MESSAGE").when(F.length("text") > MAX_MESSAGE, "MESSAGE_TOO_LONG")
    return turns.withColumn("reason", reason).filter("reason is not null")


def remembered(updates: DataFrame, key: str, item: str, at: str, most: int) -> DataFrame:
    """The ``most`` latest different items of each key: a repeated item moves to the end."""
    last = updates.groupBy(key, item).agg(F.max(at).alias(at))
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(item))
    return last.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__n")))).drop("__n")


def first_requests(requests: DataFrame, key: str, request: str, at: str, id_: str, hours: int = REQUEST_HOURS) -> DataFrame:
    """Requests that aren't a repeat of the same request of the same key less than ``hours`` before."""
    w = Window.partitionBy(key, request).orderBy(at, id_)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    return requests.withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") >= hours * 3_600_000_000)).drop("__gap")


def valid_receipts(receipts: DataFrame, issued: str, now: Column, hours: int = RECEIPT_HOURS) -> DataFrame:
    """Receipts that haven't expired; none lives longer than the maximum."""
    life = min(hours, RECEIPT_MAX_HOURS)
    return receipts.filter((F.unix_micros(now) - F.unix_micros(issued)) < life * 3_600_000_000)


def sessions(events: DataFrame, key: str, at: str, id_: str, minutes: int = 120) -> DataFrame:
    """Sessions of each key: a pause of more than ``minutes`` begins a new one."""
    w = Window.partitionBy(key).orderBy(at, id_)
    new = F.coalesce((F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) > minutes * 60_000_000, F.lit(True))
    numbered = events.withColumn("__new", new).withColumn("session", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(at).alias("begins"), F.max(at).alias("ends"))


def alerts(events: DataFrame, at: str, value: str, minutes: int, threshold: float, p: float = 0.95) -> DataFrame:
    """Windows whose percentile exceeds the threshold."""
    by = events.groupBy(F.window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), percentile(value, p).alias("level"))
    return by.filter(F.col("level") > threshold).select(F.col("w.start").alias("begins"), "n", "level")


def ask_summary(events: DataFrame) -> DataFrame:
    """Operational figures by event type: counts, distinct users, cost (null if nowhere measured), spread of latency."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("cost"), 6).alias("cost"),
        percentile("value", 0.5).alias("p50"), percentile("value", 0.95).alias("p95"), F.max("value").alias("highest"),
    )


def funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """Users that reached each step and the rate from the step before (null if none were there)."""
    counts = events.groupBy().agg(*(F.count_distinct(F.when(F.col("event_type") == s, F.col("user_id"))).alias(s) for s in steps))
    rows = [F.struct(F.lit(s).alias("step"), F.col(s).alias("users"), F.round(safe_rate(F.col(s), F.col(steps[i - 1])) if i else F.lit(1.0), 6).alias("rate")) for i, s in enumerate(steps)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
