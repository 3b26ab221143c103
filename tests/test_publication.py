from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docfathom.sources import publication as P


def _chunks(spark, hashes: dict[str, str]):
    return spark.createDataFrame([(i, h, 0) for i, h in hashes.items()], "id string, content_hash string, values int").repartition(3)


def _build(asked: list | None = None, zero: str = "", without: str = ""):
    def build(todo):
        if asked is not None:
            asked.extend(sorted(r["id"] for r in todo.collect()))
        return todo.filter(F.col("id") != without).select("id", F.when(F.col("id") == zero, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.length("content_hash").cast("double"))).alias("values"))

    return build


def _seen(spark, folder) -> dict[str, str]:
    return {r["id"]: r["content_hash"] for r in P.read(spark, folder, P.VECTORS).collect()}


def test_only_changes_are_built_and_readers_follow(spark, tmp_path):
    folder, asked = str(tmp_path / "index"), []
    first, second = {"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "2", "d": "1"}
    assert _seen(spark, folder) == {}
    assert P.publish(_chunks(spark, first), _build(asked), folder, "f", 2)["published"] and _seen(spark, folder) == first
    report = P.publish(_chunks(spark, second), _build(asked), folder, "f", 2, version="v2")
    assert asked == ["a", "b", "c", "b", "d"] and _seen(spark, folder) == second
    assert {k: report[k] for k in ("added", "updated", "reused", "deleted", "published")} == {"added": 1, "updated": 1, "reused": 1, "deleted": 1, "published": True}
    P.publish(_chunks(spark, second), _build(asked), folder, "other", 2)
    assert asked[5:] == ["a", "b", "d"]  # another fingerprint: nothing is used again
    P.point(folder, "v2")
    assert {r["fingerprint"] for r in P.read(spark, folder, P.VECTORS).collect()} == {"f"}
    assert P.publish(_chunks(spark, {}), _build(), folder, "f", 2)["published"] and _seen(spark, folder) == {}
    with pytest.raises(ValueError):
        P.point(folder, "none")


def test_an_incomplete_version_is_never_seen(spark, tmp_path):
    folder, good = str(tmp_path), {"a": "1", "b": "1"}
    P.publish(_chunks(spark, good), _build(), folder, "f", 2, version="v1")
    for n, build in enumerate((_build(zero="c"), _build(without="c"))):
        report = P.publish(_chunks(spark, good | {"c": "1"}), build, folder, "f", 2, version=f"bad{n}")
        assert not report["published"] and report["zero"] + report["missing"] == 1
    report = P.publish(_chunks(spark, good), lambda todo: todo.select("id", F.array(F.lit(1.0)).alias("values")), folder, "g", 2)
    assert not report["published"] and report["malformed"] == 2
    assert P.current(folder) == "v1" and _seen(spark, folder) == good


def test_a_failing_task_leaves_the_version_before(spark, tmp_path):
    folder, good = str(tmp_path), {"a": "1", "b": "1"}
    P.publish(_chunks(spark, good), _build(), folder, "f", 2, version="v1")
    rows = P.read(spark, folder, P.VECTORS).repartition(2)
    with pytest.raises(Exception, match="no such vector"):
        P.stage(rows.withColumn("content_hash", F.when(F.col("id") == "b", F.raise_error(F.lit("no such vector"))).otherwise("x")), folder, "v2")
    assert not (tmp_path / "v2").exists() and P.current(folder) == "v1" and _seen(spark, folder) == good


def test_leftovers_of_attempts_count_for_nothing(spark, tmp_path):
    folder, good = str(tmp_path), {"a": "1", "b": "1"}
    P.publish(_chunks(spark, good), _build(), folder, "f", 2, version="v1")
    whole = next((tmp_path / "v1").glob("part-*.parquet"))
    (tmp_path / "v1" / "part-again.parquet").write_bytes(whole.read_bytes())
    assert P.read(spark, folder, P.VECTORS).count() == 2


def test_damage_costs_only_what_is_lost(spark, tmp_path):
    folder, good = str(tmp_path), {x: "1" for x in "abcdef"}
    P.publish(_chunks(spark, good), _build(), folder, "f", 2, version="v1")
    P.stage(P.read(spark, folder, P.VECTORS).repartition(3), folder, "v2")
    P.point(folder, "v2")
    files = json.loads(Path(tmp_path / "v2" / P.MANIFEST).read_text())["files"]
    assert len(files) > 1
    torn = tmp_path / "v2" / files[0]["name"]
    torn.write_bytes(torn.read_bytes()[:-10])
    asked: list = []
    report = P.publish(_chunks(spark, good), _build(asked), folder, "f", 2, version="v3")
    assert report["published"] and len(asked) == files[0]["rows"] and _seen(spark, folder) == good
    (tmp_path / P.POINTER).write_text('{"version": "v')  # the pointer is torn: all is built anew
    assert P.current(folder) is None
    report = P.publish(_chunks(spark, good), _build(), folder, "f", 2)
    assert report["published"] and report["added"] == 6 and _seen(spark, folder) == good


def test_seeds_stand_in_for_the_version_before(spark, tmp_path):
    seeds = spark.createDataFrame([("a", "1", "f", [3.0, 4.0]), ("b", "0", "f", [3.0, 4.0]), ("c", "1", "f", [0.0, 0.0]), ("d", "1", "f", [1.0])], P.VECTORS)
    asked: list = []
    report = P.publish(_chunks(spark, {x: "1" for x in "abcd"}), _build(asked), str(tmp_path), "f", 2, seeds=seeds)
    assert report["published"] and asked == ["b", "c", "d"] and report["reused"] == 1
