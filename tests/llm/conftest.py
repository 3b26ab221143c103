"""Documents with every awkward case that the operators promise to handle."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, sequence_id string, start string, kind string, h string, cls string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 40)
    rows: list[tuple[int | None, str | None]] = [(i, words(rng, rng.choice([3, 30, 200]))) for i in range(20)]
    rows += [(20, None), (21, ""), (22, "  \n\t "), (23, "one two"), (24, "ONE Two"), (25, "x" * 3000), (26, "ab " * 2000)]
    rows += [(30 + i, base) for i in range(4)]  # exact copies
    for i in range(8):  # near copies
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((40 + i, " ".join(w)))
    rows += [(50 + i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(5)]  # a shared passage
    rows += [(60, "Größe naïve 日本語 テキスト 😀 " * 30), (61, "Größe naïve 日本語 テキスト 😀 " * 30), (62, words(rng, 30000))]
    rows += [(63, "mail a.b@c.example and +1 (555) 555-0100, 10.0.0.1; 4111 1111 1111 1111")]
    rows += [(63, "mail a.b@c.example and +1 (555) 555-0100, 10.0.0.1; 4111 1111 1111 1111"), (None, words(rng, 20)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "x", "y", "z", "k", "h", "c") for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
