from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from docfathom.llm import ngram_join, suffix_dedup
from docfathom.llm.components import components

from .conftest import corpus


def shingles(text: str | None, n: int) -> set:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def grouped(rows, n: int, num: int, den: int) -> dict:
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    ids: dict = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(key, ids.get(find(i), key))
    return sorted((key is None, key or 0, len(sets[i]), -1 if key is None else ids[find(i)]) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_join_equals_all_pairs(docs, n, num, den):
    got = ngram_join.near_duplicates(docs, size=n, threshold=(num, den)).collect()
    said = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["doc_id"] is None else r["component_id"]) for r in got)
    assert said == grouped(corpus(), n, num, den)


def test_join_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CLUSTER", 3)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    got = ngram_join.near_duplicates(docs, size=4, threshold=(85, 100)).collect()
    said = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["doc_id"] is None else r["component_id"]) for r in got)
    assert said == grouped(corpus(), 4, 85, 100)


def test_trie_finds_every_link():
    rng = np.random.default_rng(3)
    t = ngram_join.Threshold(70, 100)
    base = np.unique(rng.integers(0, 400, 150))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(90, len(base))], rng.integers(0, 400, rng.integers(0, 40))])) for _ in range(60)]
    sets += [base, base[:20], base[:20], np.array([1]), np.zeros(0, np.int64)]
    trie = ngram_join.Trie(sets)
    mark = np.zeros(401, bool)
    for i, q in enumerate(trie.sets):
        wanted = np.arange(len(sets)) != i
        found = set(trie.walk(q, wanted, t, mark).tolist()) if len(q) else set()
        want = {j for j, s in enumerate(trie.sets) if j != i and len(q) and len(s) and t.linked(len(np.intersect1d(q, s)), len(q), len(s))}
        assert found == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {301: 300}


def removed(rows, window: int):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen: dict = {}
    out = []
    for i in order:
        b = (rows[i][1] or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            first = seen.setdefault(w, (rows[i][0], s))
            if first != (rows[i][0], s):
                covered[s : s + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((covered & ~np.concatenate(([False], covered[:-1]))).sum()) if len(b) else 0
        out.append((rows[i][0] is None, rows[i][0] or 0, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_passages_equal_brute_force(docs, monkeypatch, hot):
    if hot:  # every anchor counts as a very frequent one
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
        monkeypatch.setattr(suffix_dedup, "HELD", 500)
    rows = [r for r in corpus() if r[1] is not None or r[0] is not None]
    got = suffix_dedup.dedup_substrings(docs.filter("text is not null or doc_id is not null")).collect()
    said = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert said == removed(rows, 100)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcd "), 5000))
    rows = [(1, long), (2, long[1000:3000]), (3, "zz" + long[200:2900] + "yy"), (4, "a" * 900)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((False, r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed(rows, 100)


def test_radix_groups_are_the_equal_windows():
    data = np.frombuffer(b"abcdefghijklmnopqrst" * 5 + b"xyz" * 10, np.uint8)
    start = np.arange(len(data) - 20)
    left, group = suffix_dedup.radix_groups(data, start, np.zeros(len(start), np.int64), 20)
    by: dict = {}
    for s, g in zip(left.tolist(), group.tolist(), strict=True):
        by.setdefault(g, []).append(bytes(data[s : s + 20]))
    want: dict = {}
    for s in start.tolist():
        want.setdefault(bytes(data[s : s + 20]), []).append(s)
    assert sorted(len(v) for v in by.values()) == sorted(len(v) for v in want.values() if len(v) > 1)
    assert all(len(set(v)) == 1 for v in by.values())


def test_empty_tables(empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_texts_under_one_key_and_rows_without_a_key(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    base, other = draw(500), draw(400)
    rows = [(5, base), (5, other), (7, base[100:400]), *((None, draw(300)) for _ in range(40)), (None, base)]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    # The text without a key comes first: both copies under keys go, nothing else does.
    assert [x for x in by if x[0]] == [(5, 400, 0), (5, 500, 500), (7, 300, 300)]
    assert sum(x[2] for x in by if not x[0]) == 0


def test_rows_without_near_duplicates(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, z, q = text(60), text(60), text(60)
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a, "x"), (2, a, "y"), (2, z, "x"), (3, q, "x"), (3, q, "x"), (None, near, "x"), (None, text(40), "x"), (4, None, "x"), (5, "", "x"), (6, "", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    kept = ngram_join.without_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in kept.collect())
    want = sorted([(1, a, False), (2, z, False), (3, q, False), (0, rows[6][1], False), (4, "", True), (5, "", False), (6, "", False)])
    assert got == want
    assert ngram_join.without_near_duplicates(df.limit(0)).count() == 0


def test_whole_runs_are_sorted_by_their_bytes():
    pieces = [b"a" * 120, b"b" * 120, b"a" * 120, b"a" * 119 + b"c", b"a" * 130, b"a" * 130]
    length = np.array([len(x) for x in pieces])
    which, group = suffix_dedup.equal_runs(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length, np.zeros(6, np.int64))
    by = sorted(sorted(which[group == g].tolist()) for g in set(group.tolist()))
    assert by == [[0, 2], [4, 5]]
