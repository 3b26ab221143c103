from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docfathom.llm import ngram_join as J


def test_a_short_text_in_a_group_does_not_connect_long_ones():
    """Long sets that share a token and little else, beside a short one of the same token."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (2000, 2000, 2010, 30)]
    sets.append(np.concatenate([sets[0][:1950], rng.integers(0, 1 << 63, 60).astype(np.uint64)]))  # similar to the first
    rows = {"token": [1] * 5, "cell": [0] * 5, "cls": list(range(5)), "n": [len(s) for s in sets], "at": [0] * 5}
    batch = pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in rows.values()), pa.array([J.parity_bits(s) for s in sets], pa.binary())], names=[*rows, "bits"])
    out = next(J.candidate_edges(J.Threshold(85, 100))(iter([batch])))
    assert [set(e) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)] == [{0, 4}]


def test_differences_are_never_overstated():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [base[: int(n)] for n in rng.integers(1, 3000, 40)]
    signs = J.Signs([J.parity_bits(s) for s in sets])
    for q in range(40):
        assert (signs.differ(q, np.arange(40)) <= [len(np.setxor1d(sets[q], s)) for s in sets]).all()


def test_counters_follow_the_input():
    assert J.sketch_counters(10 << 20) == J.sketch_counters(1 << 62) == J.SKETCH
    assert J.SKETCH < J.sketch_counters(2 << 30) <= J.sketch_counters(100 << 30) == J.SKETCH_MOST
    tokens = np.arange(1 << 20, dtype=np.uint64)
    assert sorted(J.ordered(tokens, np.zeros(J.SKETCH_MOST, np.uint8)).tolist()) == tokens.tolist()


def test_texts_of_other_keys_stay_where_they_are(spark):
    docs = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id") - 9).alias("__key"), F.lit("a text").alias("__text"))
    wanted = docs.filter("__key % 100 = 0 or __key is null").select(F.col("__key").alias("rep"))
    kept = [r["__key"] for r in J.among(docs, J.key_bits(wanted)).collect()]
    assert {r["rep"] for r in wanted.collect()} <= set(kept) and len(kept) < 60
