from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from docfathom.llm import divergence as module
from docfathom.llm.divergence import divergence, radix_top

from .conftest import SCHEMA, corpus


def rows() -> list[tuple]:
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "abcdefé" for b in ("", "a", "aa", "aaaa", "aaaab", "é", "日本")]
    out = []
    for i in range(240):
        weights = [1 + (len(x) * (i % 5)) % 7 for x in vocabulary]
        text = rng.choice([" ", "1", "-"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 60])))
        out.append((i, text.upper() if i % 3 else text, ["en", "de", None][i % 3], ["s1", "s2", None, "", "s3"][i % 5]))
    out += [(None, None, "en", "alone"), (None, None, None, None), (1, "", "xx", "one"), (1, "", "xx", "two"), (2, "a a", "yy", "one"), (2, "a a", "yy", "one")]
    return out + [(i, t, "big", f"s{i or 0}") for i, t in corpus()[:30]]


def expected(table: list[tuple], least: int, top: int) -> list[tuple]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, source in table:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))

    def shares(c: Counter, lang: str) -> dict[str, int]:
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = sum(c[k] for k in kept)
        return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

    def apart(p: int, q: int) -> int:
        return (p - q) ** 2 // (p + q)

    whole = {lang: shares(sum((c for (x, _), c in counts.items() if x == lang), Counter()), lang) for lang in docs}
    each = {(lang, source): shares(c, lang) for (lang, source), c in counts.items()}
    out = []
    for (lang, source), p in each.items():
        terms = [(apart(p[t], q), t) for t, q in whole[lang].items() if counts[lang, source][t] and p[t] > q]
        pairs = [(sum(apart(p[t], other[t]) for t in p), s) for (x, s), other in each.items() if x == lang and s != source]
        for part, items, most in (("term", terms, top), ("pair", pairs, len(pairs))):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, r) for r, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, x, s, 0, "x", "y", "z", "k", "h", "c") for i, t, x, s in rows()], SCHEMA).repartition(4)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3)])
def test_divergence_equals_brute_force(table, least, top, monkeypatch):
    if top == 3:
        monkeypatch.setattr(module, "HELD", 5)
        monkeypatch.setattr(module, "DEPTHS", (1, 3))
    got = divergence(table, least_docs=least, top=top)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == expected(rows(), least, top)


def test_no_term_is_kept(table):
    few = table.limit(40)
    got = divergence(few, least_docs=10**6).collect()
    assert {(r["part"], r["value"]) for r in got} == {("pair", 0)}


def test_no_rows(empty):
    assert divergence(empty).count() == 0


def test_radix_select_with_ties(spark):
    rng = random.Random(5)
    items = [("x", f"g{i % 7}", "".join(rng.choice("aé日\U0001f600") for _ in range(rng.randint(1, 6))) + str(i), rng.choice([0, 1, 5, 5, 5, 2**22 + 1, 2**31])) for i in range(900)]
    items += [("x", "few", "t", 3), ("x", "same", "aaaab", 7), ("x", "same", "aaaaa", 7), ("x", "same", "aaaa", 7)]
    table = spark.createDataFrame(items, "lang string, source string, term string, value long")
    for top in (2, 40):
        want = []
        for g in {i[1] for i in items}:
            own = sorted((i for i in items if i[1] == g), key=lambda i: (-i[3], i[2].encode()))
            want += [(*i, r) for r, i in enumerate(own[:top], 1)]
        assert sorted(tuple(r) for r in radix_top(table, top).collect()) == sorted(want)
