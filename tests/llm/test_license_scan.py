from __future__ import annotations

import random
import re

import pytest

from docfathom.llm import license_scan
from docfathom.llm.license_scan import COVERED, GRAM, LONG, NEAR, VOTES, license_spans, scan_licenses
from docfathom.llm.license_templates import PHRASES, TEMPLATES

from .conftest import SCHEMA, corpus, words


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def spans(text: str | None) -> list[tuple]:
    w, out = split(text), []
    for i, (label, passage) in enumerate(TEMPLATES):
        t = passage.split()
        votes: dict[int, set] = {}
        places: dict[tuple, list[int]] = {}
        for x in range(len(t) - GRAM + 1):
            places.setdefault(tuple(t[x : x + GRAM]), []).append(x)
        for p in range(len(w) - GRAM + 1):
            for x in places.get(tuple(w[p : p + GRAM]), ()):
                votes.setdefault(p - x, set()).add(x)
        group: list[int] = []
        for d in [*sorted(d for d, v in votes.items() if len(v) >= min(VOTES, len(t) - GRAM + 1)), None]:
            if group and (d is None or d - group[-1] > NEAR):
                seen = {(g, x + j) for g in group for x in votes[g] for j in range(GRAM)}
                covered = len({x for _, x in seen})
                if 100 * covered >= (100 if len(t) < LONG else COVERED) * len(t):
                    out.append((label, i, min(g + x for g, x in seen), max(g + x for g, x in seen) + 1, covered / len(t)))
                group = []
            if d is not None:
                group.append(d)
    return out


def digest(text: str | None) -> tuple:
    w = split(text)
    at = [(p, label) for label, f in PHRASES for p in range(len(w)) if w[p : p + len(f.split())] == f.split()]
    found = spans(text)
    base = {label for _, label in at}
    places = [p for p, _ in at]
    score = 1.0 if at else max((s[-1] for s in found), default=0.0)
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in found})), score


def rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    out = corpus()[:30] + corpus()[-6:]
    for i, (_, passage) in enumerate(TEMPLATES):
        w = passage.split()
        out.append((100 + i, f"{words(rng, 20)} {passage.upper()} {words(rng, 20)}"))
        changed = [x if rng.random() > 0.06 else "changed" for x in w]
        out.append((200 + i, " ".join([*changed[: len(w) // 2], *["put", "in"] * rng.randint(0, 4), *changed[len(w) // 2 :]])))
        out.append((300 + i, " ".join(w[: len(w) * 2 // 3])))
        out.append((400 + i, " ".join(rng.sample(w, len(w)))))
    out += [(500, "Released under the MIT\nLicense. " * 40), (501, "Apache License, Version 2.0 (CC BY-NC)"), (502, "all rights reserved " * 3000), (503, "under the mit license ünder the mit license")]
    out += [(500, TEMPLATES[0][1]), (None, TEMPLATES[2][1]), (None, TEMPLATES[2][1]), (None, None), (504, "under the mit"), (505, "license under the mit"), (506, "日本 all rights reserved日本"), (507, "ALL RIGHTS RESERVED.")]
    return out


@pytest.fixture(scope="module")
def licensed(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "k", "h", "c") for i, t in rows()], SCHEMA).repartition(3)


def _ordered(items) -> list:
    return sorted(items, key=lambda r: [(x is not None, x) for x in r])


def test_digest_equals_brute_force(licensed):
    got = [tuple(r) for r in scan_licenses(licensed).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()]
    assert _ordered(got) == _ordered((i, *digest(t)) for i, t in rows())


def test_spans_equal_brute_force(licensed):
    got = [tuple(r) for r in license_spans(licensed).collect()]
    assert _ordered(got) == _ordered({(i, *s) for i, t in rows() for s in spans(t)})
    assert {r[1] for r in got} == {label for label, _ in TEMPLATES}


def test_empty_table_and_bad_templates(empty):
    assert scan_licenses(empty).count() == 0 and license_spans(empty).count() == 0
    with pytest.raises(ValueError, match="words"):
        license_spans(empty, templates=[("x", "two words")])


def test_templates_too_many_to_send(licensed, monkeypatch):
    monkeypatch.setattr(license_scan, "SENT", 10)
    assert {r["labels"] for r in scan_licenses(licensed).collect()} == {digest(t)[5] for _, t in rows()}
