from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docfathom.llm import boosting, personal_data, quality_knn, quality_rules, toxicity, vector_search
from docfathom.llm.labelled import isotonic

from .conftest import corpus


def test_search_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16)) * 3
    v = (centres[rng.integers(0, 6, 900)] + rng.standard_normal((900, 16))).astype(np.float32).astype(float)
    v[200:260] = v[200]  # ties
    rows = [(i, [float(x) for x in v[i]], "a") for i in range(900)]
    bad = [(1000, None, "a"), (1001, [0.0] * 16, "a"), (1002, [float("nan")] * 16, "a"), (1100, [1.0, None] + [0.0] * 14, "a"), (1200, [1.0] * 3, "a"), (None, [1.0] * 16, "a")]
    got = vector_search.search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 900, 100))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and q not in [x[1] for x in found]
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        assert all(math.isclose(x[2], d[x[1]], rel_tol=1e-12, abs_tol=1e-12) for x in found)
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(900), d))[:10].tolist()) & {x[1] for x in found})
    assert hits / (10 * len(by)) >= 0.9
    assert [x[1] for x in by[200]] == list(range(201, 211))


def test_each_row_that_asks_has_one_list(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8)).astype(np.float32).astype(float)
    rows = [(i, v[i].tolist()) for i in range(300)] + [(100, v[100].tolist()), (200, v[7].tolist()), (150, v[150].tolist()), (200, v[200].tolist())]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    lists: dict = {}
    for r in got:
        lists.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    m, ids, want = np.array([x for _, x in rows]), np.array([i for i, _ in rows]), {}
    for q in np.flatnonzero(ids % 100 == 0).tolist():
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        for rank, c in enumerate(np.lexsort((ids, d))[:10].tolist(), 1):
            want.setdefault((rows[q][0], rank), []).append((rows[c][0], d[c]))
    assert {k: len(x) for k, x in lists.items()} == {k: len(x) for k, x in want.items()}
    near = sum(len(set(x) & set(lists[k])) for k, x in want.items()) / sum(len(set(x)) for x in want.values())
    assert near >= 0.9 and [sorted(x) for x in (lists[100, 1], lists[200, 1])] == [sorted(x) for x in (want[100, 1], want[200, 1])]


def test_search_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in vector_search.search(few).collect()] == [(0, 1, 5)]
    assert vector_search.search(few.limit(0)).count() == 0


def clean(rng: random.Random) -> str:
    return " ".join(rng.choice(["the", "of", "and", "word", "text", "river", "stone", "light", "house", "garden"]) + rng.choice(["", "ing", "ed", "s", "er"]) for _ in range(60))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        text, quality, toxic = clean(rng), 1, 0
        if i % 5 == 1:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 4 == 3:
            w = text.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyterm", "awfulname"])
            text, toxic = " ".join(w), 1
        rows.append((i, text, "x"))
        labels.append((i, quality, toxic, "en"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "\n", "x"), (None, clean(rng), "x"), (3, rows[3][1], "x"), (903, "z" * 200_000, "x")]
    labels += [(3, None, None, "en"), (None, 1, 1, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")


@pytest.mark.parametrize(("classify", "label", "folds", "kept"), [(quality_knn.classify, "quality", 5, 0), (toxicity.classify, "toxic", 4, 2)])
def test_classifiers_on_rows_kept_out(labelled, classify, label, folds, kept):
    docs, labels = labelled
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    got = classify(docs, labels).collect()
    assert len(got) == docs.count()
    right = total = 0
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % folds == kept)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and i in truth:
            total += 1
            right += r["predicted"] == truth[i]
    assert total > 50 and right / total > 0.95


@pytest.mark.parametrize("classify", [quality_knn.classify, toxicity.classify])
def test_classifiers_without_labels_or_rows(labelled, classify):
    docs, labels = labelled
    assert classify(docs.limit(0), labels).count() == 0
    assert {0.0 <= r["score"] <= 1.0 for r in classify(docs.limit(5), labels.limit(0)).collect()} == {True}


def test_accepted_rows_are_whole(labelled):
    docs, labels = labelled
    kept = quality_knn.accepted(docs, labels)
    assert kept.columns == docs.columns
    want = {(r["doc_id"],) for r in quality_knn.classify(docs, labels).collect() if r["predicted"] == 1}
    assert {(r["doc_id"],) for r in kept.collect()} == want


def test_isotonic_and_boosting():
    x = np.array([0.0, 0.0, 1.0, 2.0, 3.0])
    knots, values = isotonic(x, np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    rng = np.random.default_rng(0)
    f = rng.standard_normal((400, 3))
    y = ((f[:, 0] > 0) ^ (f[:, 1] > 0.5)).astype(float)
    assert ((boosting.log_odds(boosting.boost(f, y), f) > 0) == y).mean() > 0.95


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group(0))
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if [True, all(int(x) <= 255 for x in m.group(0).split(".")) if k == 1 else False, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    import hashlib

    rng = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", ".", "1", "22", "255.255.0.1", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-0100", "+", "(", "é", "😀", "abc", "_", "%", "1.2.3.4.5", "\n", "000.00.0.0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "1 " * 20000, "a" * 30000, "1." * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data.personal_data(df).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        line = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (r["doc_id"], texts[r["doc_id"]], line, r["spans"])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_proposals_add_what_base_rules_swallow(spark, docs):
    text = "pay 4111111111111111 5500005555555559 or call +1 (826) 555-4081 190.137.223.204 now; version 1.2.3 of 2024"
    rows = personal_data.personal_data(spark.createDataFrame([(1, text), (2, "clean words of section 4.2 and 17 more")], "doc_id long, text string")).orderBy("doc_id").collect()
    found = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[0]["spans"].split(","))]
    assert {"4111111111111111", "5500005555555559", "+1 (826) 555-4081", "190.137.223.204"} <= set(found)
    assert rows[1]["spans"] == ""
    assert personal_data.personal_data(docs).count() == docs.count()


def test_redaction_replaces_spans_only(spark, empty, docs):
    text = "é😀 write to a.b@c.example, or 10.0.0.1!"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "nothing", "k")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in personal_data.redact(df).collect()}
    assert got == {1: ("é😀 write to <email>, or <ip>!", "k"), 2: (None, "k"), 3: ("nothing", "k")}
    assert personal_data.redact(empty).count() == 0 and personal_data.redact(docs).count() == docs.count()


def counts(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_rules_equal_brute_force(spark, docs, empty):
    more = ["a b\na b\n\na b", "x y z " * 40, "é 日本語\tб #$ |", "same line of ten words which is here not short enough\n" * 3]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = [t for _, t in corpus()] + more
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(df).collect())
    assert got == sorted(map(counts, texts))
    assert all(not (r["kept"] and r["base_failed"]) for r in quality_rules.quality_rules(df).collect())
    assert quality_rules.quality_rules(empty).count() == 0


def test_fertility_rejects_what_the_vocabulary_does_not_fit(spark):
    odd = " ".join("".join(chr(0x1F300 + (i * 7 + k) % 200) for k in range(6)) + "qzx" for i in range(40))
    good = "the quick brown fox jumps over the lazy dog while many other words of plain prose follow in this line " * 1
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, odd), (2, good)], "doc_id long, text string")).collect()}
    assert got[2]["kept"] and not got[1]["kept"] and got[1]["byte_share"] > 0.5


def _junk(kind: str, rng: random.Random) -> str:
    signs = {"consonants": "bcdfghjklmnpqrstvwxz", "symbols": "#*$%&|<>!@^~+=-_/:;,.?()[]{}", "numbers": "0123456789", "hexadecimal": "0123456789abcdef", "extended": "".join(map(chr, range(0xC0, 0x250)))}
    draw = lambda: base64.b64encode(rng.randbytes(rng.randint(4, 12))).decode() if kind == "base64" else "".join(rng.choice(signs[kind]) for _ in range(rng.randint(4, 12)))
    return " ".join(draw() for _ in range(80))


@pytest.mark.parametrize("copies", [2, 30])
def test_junk_is_rejected_however_much_there_is(spark, copies):
    """0.2 and 3 per cent of each kind of junk in 1,000 documents."""
    rng, kinds = random.Random(copies), ["base64", "consonants", "symbols", "numbers", "hexadecimal", "extended"]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    junk = [(10**6 + i, _junk(kinds[i % 6], rng)) for i in range(6 * copies)]
    got = quality_rules.quality_rules(docs.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string"))).filter("not base_failed")
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    clean = [r["doc_id"] for r in labels.filter("quality = 1").collect() if r["doc_id"] in kept]
    assert sum(kept.get(i, False) for i, _ in junk) <= 0.05 * len(junk)
    assert sum(not kept[i] for i in clean) < 0.01 * len(clean) and len(clean) > 200


def test_fertility_equals_brute_force(spark):
    import public_tokenizers
    import sentencepiece
    import tiktoken

    texts = ["the quick brown fox jumps over it", "Größe naïve 日本語 テキスト 😀", "привет мир как дела", "", "한국어 문장 입니다", "x" * 50]
    one = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    two = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = {i for i, b in {v: k for k, v in ranks.items()}.items() if b.decode("utf-8", "ignore").encode() == b}
    names = ["latin", "kana", "cyrillic", "other", "hangul", "latin"]
    for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        words = texts[r["doc_id"]].split()
        chars = sum(map(len, words))
        a = [t for w in words for t in one.encode(w)]
        b = [t for w in words for t in two.encode_ordinary(f" {w}")]
        assert math.isclose(r["chars_per_token"], chars / max(len(a), 1)) and math.isclose(r["chars_per_token_multi"], chars / max(len(b), 1))
        assert math.isclose(r["byte_share"], sum(one.is_byte(t) or one.is_unknown(t) for t in a) / max(len(a), 1))
        assert math.isclose(r["byte_share_multi"], sum(t not in whole for t in b) / max(len(b), 1))
        want = -sum(c / len(a) * math.log2(c / len(a)) for c in Counter(a).values()) if a else 0.0
        assert math.isclose(r["token_entropy"], want, abs_tol=1e-9)
        assert list(quality_rules.BANDS)[r["script"]] == names[r["doc_id"]] or r["doc_id"] == 1


def test_windows_cover_texts_and_save_what_the_compressors_say():
    rng = random.Random(3)
    text = clean(rng) * 5 + " " + "ล" * 100 + " " + "word " * 3
    pieces = toxicity._PIECES.findall(toxicity.spelled(text))
    some = [w for part in toxicity.windows(text) for w in part]
    want, a = [], 0
    while True:
        want.append(("".join(pieces[a : a + toxicity.WINDOW]) + " ").encode())
        if a + toxicity.WINDOW >= len(pieces):
            break
        a += toxicity.STRIDE
    assert some == want
    assert [w for part in toxicity.windows("12 34 !!") for w in part] == [w for part in toxicity.windows(None) for w in part] == []
    toxic, ordinary = [f"{clean(rng)} vileword".encode() for _ in range(200)], [clean(rng).encode() for _ in range(400)]
    tables, content = toxicity.trained(ordinary, 4096, 64)
    _, more = toxicity.trained(toxic, 1024, 32)
    distance = toxicity.Distance(more, content, tables)
    by_one = [len(distance.plain.compress(w)) - len(distance.toxic.compress(w)) for w in some]
    assert distance.saved(some).tolist() == by_one
    assert distance.saved([b" the vileword of stone "])[0] > 0


def test_votes_equal_brute_force(labelled):
    docs, labels = labelled
    rows = docs.filter("doc_id < 200")
    model = quality_knn.fit(rows, labels, "doc_id", "text", "quality", quality_knn.fold("doc_id", 5) == 0)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    import pyarrow as pa
    from docfathom.llm.textblocks import blocks

    for r in quality_knn.classify(rows, labels).limit(60).collect():
        block = next(blocks([pa.RecordBatch.from_pydict({"text": [texts[r["doc_id"]] or ""]})]))
        terms = model.vocabulary.vectors(block)
        v = (terms * model.idf) @ model.basis
        v = v[0] / max(np.linalg.norm(v[0]), 1e-12)
        cosine = np.array([float(np.dot(v, u)) for u in model.vectors])
        edge = np.sort(cosine)[::-1][min(15, len(cosine)) - 1]
        weight = np.where(cosine >= edge - 1e-6, np.maximum(cosine, 0) ** quality_knn.POWER, 0)
        assert abs(r["score"] - (weight @ model.y / weight.sum() if terms.any() else model.prior)) < 1e-3


def test_words_decide_where_formats_are_equal(spark):
    rng = random.Random(8)
    kinds = (["river", "stone", "light", "house"], ["spamm", "clicc", "winnn", "freee"])
    rows = [(i, " ".join(rng.choice(kinds[i % 3 == 0]) for _ in range(40))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    got = quality_knn.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).filter("doc_id >= 300").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in got) and len(got) == 100


def test_redaction_of_long_texts_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["10.0.0.1 ", "é😀", "a.b@c.de ", "words of a line\n", "+1 (555) 555-0100 ", "4111 1111 1111 1111; "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 40, 700, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(df).collect()}
    for r in personal_data.redact(df).collect():
        text, out, at = texts[r["doc_id"]], [], 0
        found = sorted((int(a), personal_data.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s))
        for a, k, b in found:
            if a >= at:
                out += [text[at:a], f"<{personal_data.KINDS[k]}>"]
            at = max(at, b)
        assert r["text"] == "".join(out) + text[at:]
