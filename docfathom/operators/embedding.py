"""Embedding providers and index maintenance."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the hash embedding's features (fixed values).
TERM_WEIGHT, GRAM_WEIGHT, CONCEPT_WEIGHT, CONCEPT_EXTRA = 1.2, 0.18, 12.0, 4
_SPACE = re.compile(r"[\s   -     　﻿]+")
_LATIN, _HAN = re.compile(r"[a-z0-9][a-z0-9_.+#-]*"), re.compile("[一-鿿]+")


class Provider(Protocol):
    name: str
    model: str
    dimensions: int
    version: int
    normalization: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


def fingerprint(p: Provider) -> str:
    """Hash of what makes vectors comparable, over sorted keys."""
    facts = {"dimensions": p.dimensions, "model": p.model, "name": p.name, "normalization": p.normalization, "version": p.version}
    return "sha256:" + hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@functools.lru_cache(maxsize=1 << 19)
def _coded(feature: str) -> int:
    """Twice a feature's number, from its digest, plus one if its sign is negative; kept by the worker, as features come again and again."""
    d = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(d[:4], "big") << 1 | d[4] & 1


def _place(feature: str) -> tuple[int, int]:
    """A feature's number and sign."""
    return _coded(feature) >> 1, 1 - 2 * (_coded(feature) & 1)


#: For each triple of Latin-1 characters one more than its code, once it was asked for.
_TRIPLES = np.zeros(0, np.int64)


def _triples(dense: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's different triples of characters, in the order of their first places."""
    global _TRIPLES
    try:
        c = np.frombuffer(dense.encode("latin-1"), np.uint8).astype(np.int32)
    except UnicodeEncodeError:
        counts = Counter(map("".join, zip(dense, dense[1:], dense[2:], strict=False)))
        return np.fromiter((_coded("gram:" + x) for x in counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    if not len(_TRIPLES):
        _TRIPLES = np.zeros(1 << 24, np.int64)
    codes, first, counts = np.unique(c[:-2] << 16 | c[1:-1] << 8 | c[2:], return_index=True, return_counts=True)
    order = np.argsort(first)
    codes = codes[order]
    for x in codes[_TRIPLES[codes] == 0].tolist():
        _TRIPLES[x] = 1 + _coded(f"gram:{chr(x >> 16)}{chr(x >> 8 & 255)}{chr(x & 255)}")
    return _TRIPLES[codes] - 1, counts[order]


class LocalProvider:
    """Signed feature hashing of terms, character triples and concept groups (a parameter), scaled to length 1."""

    name, model, version, normalization = "local", "local-semantic-hash-v1", 3, "l2-client-v1"

    def __init__(self, dimensions: int = 384, concepts: dict[str, list[str]] | None = None):
        self.dimensions, self.concepts = dimensions, concepts or {}

    def features(self, text: str) -> dict[str, float]:
        base = _SPACE.sub(" ", (text or "").lower()).strip()
        out: dict[str, float] = {}
        runs = [r[i : i + 2] for r in _HAN.findall(base) for i in range(max(1, len(r) - 1))]
        dense = base.replace(" ", "")
        for kind, items, weight in (("term:", _LATIN.findall(base) + runs, TERM_WEIGHT), ("gram:", map("".join, zip(dense, dense[1:], dense[2:], strict=False)), GRAM_WEIGHT)):
            counts = Counter(items)
            sums = np.cumsum(np.full(max(counts.values(), default=0), weight)).tolist()  # as if added one by one
            out |= {kind + x: sums[n - 1] for x, n in counts.items()}
        for name, aliases in self.concepts.items():
            n = sum(a in base for a in aliases)
            if n:
                out[f"concept:{name}"] = CONCEPT_WEIGHT + min(CONCEPT_EXTRA, n)
        return out

    def _placed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and signed weights of the features, in the order of ``features``."""
        base = _SPACE.sub(" ", (text or "").lower()).strip()
        runs = [r[i : i + 2] for r in _HAN.findall(base) for i in range(max(1, len(r) - 1))]
        terms = Counter(_LATIN.findall(base) + runs)
        dense = base.replace(" ", "")
        rest = {f"concept:{name}": CONCEPT_WEIGHT + min(CONCEPT_EXTRA, n) for name, aliases in self.concepts.items() if (n := sum(a in base for a in aliases))}
        parts = [(np.fromiter((_coded("term:" + x) for x in terms), np.int64, len(terms)), np.fromiter(terms.values(), np.int64, len(terms)), TERM_WEIGHT)]
        if len(dense) > 2:
            parts.append((*_triples(dense), GRAM_WEIGHT))
        sums = [np.cumsum(np.full(counts.max(initial=0), weight)) for _, counts, weight in parts]  # as if added one by one
        code = np.concatenate([*(p[0] for p in parts), np.fromiter(map(_coded, rest), np.int64, len(rest))])
        weight = np.concatenate([*(one[p[1] - 1] for one, p in zip(sums, parts, strict=True) if len(one)), np.array(list(rest.values()), float)])
        return code >> 1, (1 - 2 * (code & 1)) * weight

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            place, weight = self._placed(text)
            v = np.bincount(place % self.dimensions, weight, self.dimensions)
            norm = float(np.sqrt((v * v).sum()))
            out.append([0.0] * self.dimensions if norm == 0 else [round(x, 8) for x in (v / norm).tolist()])
        return out


class RetryingProvider:
    """A hosted service behind a client function: batches, retries of passing failures, order and unit length restored.

    ``client(texts)`` returns (index, vector) pairs or raises ``ServiceError``; ``sleep`` is a parameter for tests.
    """

    def __init__(self, inner: Provider, client, batch: int = 10, retries: int = 3, sleep=None):
        import time

        self.inner, self.client, self.batch, self.retries, self.sleep = inner, client, batch, retries, sleep or time.sleep
        self.name, self.model, self.dimensions, self.version, self.normalization = inner.name, inner.model, inner.dimensions, inner.version, inner.normalization

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        if any(not (t or "").strip() for t in texts):
            raise ValueError("EMPTY_EMBEDDING_INPUT")
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            for attempt in range(self.retries + 1):
                try:
                    got = dict(self.client(part))
                    break
                except ServiceError as e:
                    if attempt == self.retries or not (e.status in (408, 409, 429) or e.status >= 500):
                        raise
                    self.sleep(e.retry_after if e.retry_after is not None else min(8.0, 0.25 * 2**attempt))
            for k in range(len(part)):
                v = np.array(got[k], float)
                norm = float(np.sqrt((v * v).sum()))
                if len(v) != self.dimensions or not np.isfinite(v).all() or norm == 0:
                    raise ServiceError(502, "INVALID_EMBEDDING")
                out.append((v / norm).tolist())
        return out


class ServiceError(Exception):
    def __init__(self, status: int, code: str = "SERVICE_ERROR", retry_after: float | None = None):
        super().__init__(code)
        self.status, self.code, self.retry_after = status, code, retry_after


def embed(rows: DataFrame, column: str, provider: Provider) -> DataFrame:
    """Adds ``values``, batch by batch; all are finite, of moderate size and of the provider's dimensions, or it fails."""

    def checked(vectors: list[list[float]]) -> list[list[float]]:
        if any(len(v) != provider.dimensions for v in vectors) or not (np.abs(np.array(vectors, float)) < 1e15).all():
            raise ValueError("INVALID_EMBEDDING")
        return vectors

    @F.pandas_udf("array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(checked(provider.embed_documents(part.fillna("").tolist())))

    return rows.withColumn("values", vectors(F.col(column)))


def document_input(chunks: DataFrame) -> DataFrame:
    """The text of a chunk that is embedded."""
    from docfathom.functions import text as X

    return chunks.withColumn("input", X.joined_nonblank("\n", F.col("title"), F.array_join("tags", " "), F.array_join("categories", " "), F.col("section"), F.col("content")))
