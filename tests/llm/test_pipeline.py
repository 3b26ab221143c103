"""Each stage of the pipeline on odd rows, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from docfathom.llm import personal_data, quality_knn

from .conftest import corpus
from .test_duplicates import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with null and repeated keys, two texts under one key, and a column that no stage knows."""
    path = tmp_path_factory.mktemp("tables")
    texts = dict(corpus())
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "extra") for k, (i, t) in enumerate(corpus())]
    rows += [(2, texts[32], "en", "s1", 1, "extra"), (None, texts[45], "en", "s1", 1, "extra"), (70, texts[50], "en", "s2", 1, "extra"), (71, texts[6] + " and more", "en", "s2", 1, "extra")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 26), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def _kept(rows):
    """One row of each group of near duplicates: the smallest key, null keys last; equal rows are one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.md5((r[1] or "").encode()).hexdigest()))
    sets, root = [shingles(t, 5) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((str(k), t or "", t is None) for i, (k, t) in enumerate(rows) if find(i) == i)


def _without_passages(rows, window):
    """Without the bytes of strings that start earlier: at a smaller key (null before all), or under one key earlier, then by hash."""
    rows = [((k is not None, k or 0), (t or "").encode(), mark) for k, t, mark in rows]
    first: dict = {}
    for key, b, mark in rows:
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            first[w] = min(first.get(w, (key, s, mark)), (key, s, mark))
    out = []
    for key, b, mark in rows:
        gone = {i for s in range(len(b) - window + 1) if first[b[s : s + window]] != (key, s, mark) for i in range(s, s + window)}
        out.append((*key, bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")))
    return sorted(out)


def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = {}
    for i, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, p.stored(stage(spark, docs, folder))
        found[name] = docs
        if i < len(p.STAGES) - 1:
            assert set(docs.columns) == set(p.COLUMNS)
        if i == 0:
            scores = quality_knn.classify(before, labels).filter("predicted = 1")
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter(r["doc_id"] for r in scores.collect())
            assert not Counter(_rows(docs)) - Counter(_rows(before))
        if i == 1:
            assert sorted((str(k), t or "", t is None) for k, t in _rows(docs)) == _kept(_rows(before))
        if i == 2:
            said = before.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
            want, got = _without_passages([tuple(r) for r in said], 100), sorted((k is not None, k or 0, t) for k, t in _rows(docs))
            assert got == want and sum(len(t) for _, _, t in got) < sum(len(t or "") for _, t in _rows(before))
        if i == 3:
            left = personal_data.personal_data(docs)
            assert left.agg(*(F.sum(f"n_{k}") for k in personal_data.KINDS)).first() == (0, 0, 0, 0)
            assert docs.count() == before.count() and docs.filter("text is not null and n_chars <> length(text)").count() == 0
    import public_tokenizers
    from tokenizers import Tokenizer

    coder, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    coder.no_truncation()
    for k, t in _rows(found["PII"]):
        want[k] += len(coder.encode(t or "", add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    ends = docs.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("n")).collect()
    assert all(r["end"] == r["n"] <= 1024 for r in ends)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
