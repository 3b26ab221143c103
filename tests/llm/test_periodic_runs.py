from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docfathom.llm.periodic_runs import longest_lyndon, op13_periodic_runs, periodic_runs, planted, runs, suffix_ranks

from .conftest import SCHEMA, corpus


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Stretches in which words q apart are equal, by period; a stretch that a smaller period has is not counted again."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(least, exponent * q):
                found.setdefault((a, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def random_words(rng: random.Random) -> list[int]:
    out: list[int] = []
    while len(out) < rng.choice([0, 5, 6, 40, 120]):
        if rng.random() < 0.5:
            root = [rng.randint(1, 3) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
            out += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        else:
            out += [rng.randint(1, rng.choice([2, 30])) for _ in range(rng.randint(1, 8))]
    return out


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 8), (2, 6)])
def test_runs_equal_brute_force(exponent, least):
    rng = random.Random(exponent * 100 + least)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randint(1, 12))]
        first = np.cumsum([0, *map(len, texts)])
        got = runs(np.array([w for t in texts for w in t], np.int64), first, exponent, least)
        assert [tuple(map(int, r)) for r in zip(*got, strict=True)] == [(i, *r) for i, t in enumerate(texts) for r in sorted(brute(t, exponent, least), key=lambda r: (r[0], r[2]))]


def test_suffixes_and_lyndon_words():
    rng = random.Random(2)
    texts = [[*(rng.randint(1, 2) for _ in range(rng.randint(0, 60))), 0] for _ in range(40)]
    x, text = np.array([w for t in texts for w in t]), np.repeat(np.arange(40), [len(t) for t in texts])
    rank, last = suffix_ranks(x, text), np.cumsum([len(t) for t in texts]) - 1
    root, base = longest_lyndon(rank, last), 0
    for t in texts:
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert [int(rank[base + i]) - base for i in order] == list(range(len(t)))
        for i in range(len(t) - 1):
            lyndon = [n for n in range(1, len(t) - i) if all(t[i : i + n] < t[j : i + n] for j in range(i + 1, i + n))]
            assert root[base + i] == max(lyndon)
        base += len(t)


def rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(9)
    out = [(i, t if t is None or len(t) < 20000 else t[:20000]) for i, t in corpus()]
    out += [(1000 + i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(300)]
    return out + [(2000, "ha " * 30000), (2001, "a b a b a b a"), (2002, "a b a b a b a b"), (2003, "x x x x x"), (2004, "x x x x x x"), (2005, "Ü日本\tÜ日本\nÜ日本 Ü日本 Ü日本 Ü日本"), (2006, "A a A a A a a a"), (2001, "a b a b a b a")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "k", "h", "c") for i, t in rows()], SCHEMA).repartition(3)


def collapse(w: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _ordered(items) -> list:
    return sorted(items, key=lambda r: [(x is not None, x) for x in r])


def test_operator_equals_brute_force(repeated):
    got = [(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs(repeated).collect()]
    want = []
    for i, t in rows():
        w = split(t)
        found = [(0, len(w), 1)] if len(set(w)) == 1 and len(w) >= 6 else brute(w)
        want.append((i, len(w), tuple(found), collapse(w, found)))
    assert _ordered(got) == _ordered(want)


def test_query_equals_brute_force(spark, repeated, tmp_path):
    small = repeated.filter("doc_id IS NULL OR doc_id < 1200 OR doc_id > 2000")
    small.write.parquet(str(tmp_path / "documents.parquet"))
    want, changed = [], 0
    for i, t in rows():
        if i is not None and 1200 <= i <= 2000:
            continue
        w = split(t)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, changed = h // 10, changed + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{a},{n},{q}\n" for a, n, q in found), collapse(w, found))]
        want.append((i, len(found), *best, None if not found else 1000 * best[1] // best[2], *sha))
    assert changed > 10
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert _ordered(map(tuple, got.collect())) == _ordered(want)


def test_no_rows_and_bad_arguments(empty):
    assert periodic_runs(empty).count() == 0 and planted(empty).count() == 0
    with pytest.raises(ValueError, match="period"):
        periodic_runs(empty, exponent=1)
