"""Sketches of days: merged ones against exact figures, replaced days against a rebuild, grouping sets against single groupings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docfathom.operators import sketches as S

SCHEMA = "at timestamp, kind string, value double, who long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [(datetime(2024, 1, 1) + timedelta(minutes=17 * i), rng.choice(["a", "a", "a", "b", None]), None if i % 50 == 0 else rng.expovariate(0.01), rng.choice([None, rng.randint(1, 4000)])) for i in range(6000)]
    return data, spark.createDataFrame(data, SCHEMA)


def test_periods_are_within_the_bounds(spark, rows, tmp_path):
    data, df = rows
    S.keep(S.daily(df, "at", "value", "who", "kind"), str(tmp_path))
    for first, last in ((None, None), ("2024-01-10", "2024-02-05"), ("2024-03-01", "2024-03-01")):
        inside = [r for r in data if (first or "") <= str(r[0].date()) <= (last or "9")]
        got = {r["kind"]: r for r in S.merged(S.kept(spark, str(tmp_path), first, last), "kind").collect()}
        assert set(got) == {r[1] for r in inside}
        for kind, r in got.items():
            mine = [x for x in inside if x[1] == kind]
            values, items = [x[2] for x in mine if x[2] is not None], {x[3] for x in mine} - {None}
            assert r["n"] == len(mine) and r["total"] == pytest.approx(sum(values)) and abs(r["different"] - len(items)) <= S.count_error() * len(items) + 0.5
            for rank in (0.5, 0.95):
                q = r[f"p{rank * 100:g}"]
                assert sum(v < q for v in values) / len(values) - S.rank_error() <= rank <= sum(v <= q for v in values) / len(values) + S.rank_error()


def test_a_day_that_comes_again_replaces_itself(spark, rows, tmp_path):
    _, df = rows
    S.keep(S.daily(df, "at", "value", "who", "kind"), str(tmp_path / "t"))
    changed = df.filter("at >= '2024-01-03' and at < '2024-01-04' and kind = 'a'").withColumn("value", F.lit(1.0))
    S.keep(S.daily(changed, "at", "value", "who", "kind"), str(tmp_path / "t"))
    whole = df.filter("at < '2024-01-03' or at >= '2024-01-04'").union(changed)
    want = S.daily(whole, "at", "value", "who", "kind").groupBy("day", "kind").agg(F.sum("n"), F.round(F.sum("total"), 6)).collect()
    got = S.kept(spark, str(tmp_path / "t")).groupBy("day", "kind").agg(F.sum("n"), F.round(F.sum("total"), 6)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([(None, None, None, None), (None, None, None, None)], SCHEMA)
    r = S.merged(S.daily(none, "at", "value", "who", "kind"), "kind").collect()
    assert [tuple(x) for x in r] == [(None, 2, None, None, None, 0)]
    assert S.merged(S.daily(none.limit(0), "at", "value", "who", "kind"), "kind").count() == 0


def test_grouping_sets(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", None, 2), (None, "p", 3)], "a string, b string, v long")
    got = {tuple(r) for r in S.by_grouping_sets(df, ("a", "b"), [("a", "b"), ("a",), ()], total=F.sum("v")).collect()}
    assert got == {("x", "p", 0, 1), ("x", None, 0, 2), (None, "p", 0, 3), ("x", None, 1, 3), (None, None, 1, 3), (None, None, 3, 6)}
