"""Keyed conversation memory as a stream: a record with values, lists and requests of their own lifetimes.

Each part of a session is a state variable: the record (version, summary, lifetime), its recent messages, its topics, and a
map of requests, of which an update reads the one that it names and no other.  Lifetimes go by event time: what has ended by
the time of a row is gone for that row, whether or not it was cleaned yet; timers clean what the watermark has passed.  So the
result does not depend on the batches, as long as later batches hold later rows and none is later than the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docfathom.operators.conversation import KEPT_MESSAGES, KEPT_TOPICS, MEMORY_DAYS, REQUEST_HOURS

#: Bytes of a response that may be kept for a replay, and characters of the summary of earlier threads.
REPLAY_BYTES, SUMMARY_CHARS = 32 * 1024, 2000
HOUR = 3_600_000_000
COLUMNS = {"key": "string", "at": "timestamp", "place": "long", "action": "string", "request_id": "string", "message": "string", "topic": "string", "expected": "long", "response": "string"}
OUT = "key string, place long, outcome string, version long, messages long, topics string, summary string, response string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Request(NamedTuple):
    status: str
    response: str | None
    expires: int


@dataclass(frozen=True)
class Limits:
    """Lifetimes in hours and sizes of a session's parts."""

    memory_hours: float = MEMORY_DAYS * 24
    request_hours: float = REQUEST_HOURS
    messages: int = KEPT_MESSAGES
    topics: int = KEPT_TOPICS
    replay_bytes: int = REPLAY_BYTES


@dataclass
class Session:
    """What is known under a key; ``find`` gives a request that the state holds.  ``changed``: requests to write back."""

    limits: Limits
    find: Callable[[str], Request | None]
    version: int = 0
    summary: str = ""
    expires: int = 0
    messages: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    changed: dict[str, Request] = field(default_factory=dict)
    cleared: bool = False

    def request(self, name: str | None, now: int) -> Request | None:
        if not name:
            return None
        held = self.changed[name] if name in self.changed else None if self.cleared else self.find(name)
        return held if held and held.expires > now else None

    def forget(self) -> None:
        self.version, self.summary, self.messages, self.topics = 0, "", [], []

    def touch(self, now: int) -> None:
        self.expires = now + round(self.limits.memory_hours * HOUR)

    def keep(self, name: str, status: str, response: str | None, now: int) -> None:
        self.changed[name] = Request(status, response, now + round(self.limits.request_hours * HOUR))

    def finish(self, name: str, response: str | None, now: int) -> bool:
        """Complete a request; a response beyond the limit isn't kept, so it can't be replayed."""
        whole = len((response or "").encode()) <= self.limits.replay_bytes
        self.keep(name, "completed", response if whole else None, now)
        return whole

    def apply(self, now: int, action: str | None, name: str | None, message: str | None, topic: str | None, expected: int | None, response: str | None) -> tuple[str, str | None]:
        """One update: what came of it, and the response that a repeated request is answered with."""
        if self.version and self.expires <= now:
            self.forget()
        held = self.request(name, now)
        match action or "append":
            case "delete":
                there = self.version > 0
                self.forget()
                self.changed, self.cleared = {}, True
                return ("deleted" if there else "missing"), None
            case "read":
                if self.version:
                    self.touch(now)
                return ("found" if self.version else "missing"), None
            case "begin":
                if not self.version or not name:
                    return "missing", None
                if held:
                    return held.status, held.response
                self.keep(name, "processing", None, now)
                return "started", None
            case "complete":
                if held is None:
                    return "missing", None
                if held.status == "completed":
                    return "completed", held.response
                return ("finished" if self.finish(name, response, now) else "finished_without_replay"), None
            case "append" | "new_thread" as kind:
                if held and held.status == "completed":
                    return "replayed", held.response
                if kind == "new_thread" and not self.version:
                    return "missing", None
                if expected is not None and expected != self.version:
                    return "conflict", None
                if kind == "new_thread":
                    self.summary = " ".join(x for x in (self.summary, *self.messages) if x)[-SUMMARY_CHARS:]
                    self.messages = []
                else:
                    self.messages = [*self.messages, *([message] if message else [])][-self.limits.messages :]
                    if topic:
                        self.topics = [*(t for t in self.topics if t != topic), topic][-self.limits.topics :]
                self.version += 1
                self.touch(now)
                if name:
                    self.finish(name, response, now)
                return "applied", None
            case _:
                return "unknown", None


def _some(value: object) -> object | None:
    """The value, or None for what pandas makes of a null."""
    return None if value is None or value is pd.NA or value != value else value


class Memory(StatefulProcessor):
    """The state of a key as a value, two lists and a map, with one timer for the first lifetime that ends."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "version long, summary string, expires long")
        self.messages = handle.getListState("messages", "content string")
        self.topics = handle.getListState("topics", "topic string")
        self.requests = handle.getMapState("requests", "request_id string", "status string, response string, expires long")
        self.timer = handle.getValueState("timer", "due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        session = self._read()
        out = []
        updates = pd.concat(list(rows)).sort_values(["micros", "place"], kind="stable")
        for now, place, *update in updates[["micros", "place", "action", "request_id", "message", "topic", "expected", "response"]].itertuples(index=False):
            outcome, answer = session.apply(int(now), *map(_some, update))
            out.append((key[0], place, outcome, session.version, len(session.messages), ",".join(session.topics), session.summary, answer))
        self._write(session)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"place": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        ends = []
        if self.record.exists():
            expires = self.record.get()[2]
            if expires <= passed:
                self._clear_record()
            else:
                ends.append(expires)
        kept = [(name, Request(*held)) for (name,), held in self.requests.iterator()]
        for name, held in kept:
            if held.expires <= passed:
                self.requests.removeKey((name,))
            else:
                ends.append(held.expires)
        self._wake(ends)
        return iter(())

    def close(self) -> None:
        pass

    def _read(self) -> Session:
        def find(name: str) -> Request | None:
            return Request(*self.requests.getValue((name,))) if self.requests.containsKey((name,)) else None

        session = Session(self.limits, find)
        if self.record.exists():
            session.version, session.summary, session.expires = self.record.get()
            session.messages, session.topics = [m for (m,) in self.messages.get()], [t for (t,) in self.topics.get()]
        return session

    def _write(self, session: Session) -> None:
        if session.cleared:
            self.requests.clear()
        for name, held in session.changed.items():
            self.requests.updateValue((name,), tuple(held))
        self._clear_record()
        if session.version:
            self.record.update((session.version, session.summary, session.expires))
            for state, values in ((self.messages, session.messages), (self.topics, session.topics)):
                if values:
                    state.put([(v,) for v in values])
        self._wake([*([session.expires] if session.version else []), *(r.expires for r in session.changed.values())])

    def _clear_record(self) -> None:
        for state in (self.record, self.messages, self.topics):
            state.clear()

    def _wake(self, ends: list[int]) -> None:
        """A timer at the first end, unless an earlier one is set; whatever then still lives sets the next."""
        if not ends:
            return
        due = -(-min(ends) // 1000)
        if self.timer.exists():
            (set_at,) = self.timer.get()
            if set_at <= due:
                return
            self.handle.deleteTimer(set_at)
        self.handle.registerTimer(due)
        self.timer.update((due,))


def memory(updates: DataFrame, limits: Limits = Limits(), late: str = "1 hour") -> DataFrame:
    """A stream of updates (``COLUMNS``) to what came of each: outcome, and the session after it.

    Actions: ``append`` (null: the same), ``new_thread``, ``read`` (lengthens the record's life), ``begin`` and ``complete`` of a
    request, ``delete`` (also all requests).  An update whose request was completed is ``replayed`` with the kept response; one
    that expects another version is a ``conflict``.  Rows of a key in one batch go by time, then ``place``, and are held in memory
    together: the batch bounds them.  Rows without key or time are left out.  Needs the RocksDB state store: see ``run``.
    """
    rows = updates.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items())).filter("key is not null and at is not null")
    return rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", late).groupBy("key").transformWithStateInPandas(statefulProcessor=Memory(limits), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Run over what is there into Parquet under ``folder`` with its checkpoint, going on where an earlier run ended."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # a query keeps the setting that it was started with
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions that the state under ``folder`` holds, as callers may see them: without requests and their responses."""

    def part(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")

    key = F.col("key.key").alias("key")
    record = part("record").select(key, "value.version", "value.summary", F.timestamp_micros("value.expires").alias("expires_at"))
    lists = {name: part(name).groupBy(key).agg(F.collect_list(f"list_element.{column}").alias(name)) for name, column in (("messages", "content"), ("topics", "topic"))}
    out = record
    for name, values in lists.items():
        out = out.join(values, "key", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
