"""Sinks and services outside the cluster: signed webhooks, key-value stores, chat models.  All clients are parameters."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


def signature(secret: str, timestamp: int, body: str) -> str:
    return hmac.new(secret.encode(), f"v1.{timestamp}.{body}".encode(), hashlib.sha256).hexdigest()


def webhook_sink(url: str, secret: str, post: Callable[[str, str, dict], int], now: Callable[[], float] = time.time, key: str = "receiptId") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that posts each row once: signed, with an idempotency key; only https."""
    if not url.startswith("https://"):
        raise ValueError("WEBHOOK_REQUIRES_HTTPS")

    def send(batch: DataFrame, epoch: int) -> None:
        def run(rows: Iterator) -> None:
            for row in rows:
                body = json.dumps(row.asDict(recursive=True), default=str, sort_keys=True, ensure_ascii=False)
                at = int(now())
                status = post(url, body, {"Idempotency-Key": str(row[key]), "X-Timestamp": str(at), "X-Signature": f"v1={signature(secret, at, body)}", "Content-Type": "application/json"})
                if not 200 <= status < 300:
                    raise RuntimeError(f"FEEDBACK_SINK_{status}")

        batch.foreachPartition(run)

    return send


class KeyValue(Protocol):
    def get(self, key: str) -> str | None: ...
    def set(self, key: str, value: str, seconds: int) -> None: ...
    def delete(self, key: str) -> None: ...


def key_value_sink(connect: Callable[[], KeyValue], key: str, value: str, seconds: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last value of each key; one connection a partition."""

    def send(batch: DataFrame, epoch: int) -> None:
        def run(rows: Iterator) -> None:
            store = connect()
            for row in rows:
                store.set(str(row[key]), str(row[value]), seconds)

        batch.select(key, value).foreachPartition(run)

    return send


class InMemory:
    """A store for tests; ``now`` is a parameter."""

    def __init__(self, now: Callable[[], float] = time.time):
        self.now, self.data = now, {}

    def get(self, key: str) -> str | None:
        value, until = self.data.get(key, (None, 0.0))
        return value if until > self.now() else None

    def set(self, key: str, value: str, seconds: int) -> None:
        self.data[key] = (value, self.now() + seconds)

    def delete(self, key: str) -> None:
        self.data.pop(key, None)


def generated(prompts: DataFrame, client: Callable[[str], str], most_tokens: int = 1200) -> DataFrame:
    """Answers of a chat model to ``prompt``: ``answer`` or ``error``; one failure is a row, not a failed job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers, errors = [], []
            for prompt in part["prompt"]:
                try:
                    answers.append(client(prompt)[: most_tokens * 4])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any fault of the service becomes its code
                    answers.append(None)
                    errors.append(type(e).__name__)
            yield part.assign(answer=answers, error=errors)

    schema = prompts.schema.add("answer", "string").add("error", "string")
    return prompts.mapInPandas(run, schema)


def issue_token(secret: str, subject: str, expires: int) -> str:
    body = f"{subject}.{expires}"
    return f"{body}.{hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()}"


def verify_token(secrets: list[str], token: str, now: int) -> str | None:
    """Subject of a token signed with any of the secrets (rotation) that hasn't expired; else None."""
    body, _, mac = token.rpartition(".")
    subject, _, expires = body.rpartition(".")
    if not expires.isdigit() or int(expires) <= now:
        return None
    ok = any(hmac.compare_digest(hmac.new(s.encode(), body.encode(), hashlib.sha256).hexdigest(), mac) for s in secrets)
    return subject if ok else None
