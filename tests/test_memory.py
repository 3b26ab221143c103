"""Keyed memory: single updates on literals; one batch, many batches and a restart give the same."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from docfathom.streaming import memory as M

HOUR = M.HOUR
SCHEMA = ", ".join(f"{c} {t}" for c, t in M.COLUMNS.items())


def session(**limits):
    return M.Session(M.Limits(**limits), lambda name: None)


def update(s, now, action="append", name=None, message=None, topic=None, expected=None, response=None):
    return s.apply(now, action, name, message, topic, expected, response)


def test_versions_topics_and_threads():
    s = session(messages=3, topics=2)
    assert update(s, 0, "read") == update(s, 0, "begin", "r") == update(s, 0, "new_thread") == ("missing", None)
    assert update(s, 0, expected=1)[0] == "conflict" and s.version == 0
    for i, topic in enumerate("abca"):
        assert update(s, i, message=f"m{i}", topic=topic, expected=i)[0] == "applied"
    assert (s.version, s.messages, s.topics) == (4, ["m1", "m2", "m3"], ["c", "a"])
    assert update(s, 9, expected=3)[0] == "conflict"
    assert update(s, 9, "new_thread")[0] == "applied" and (s.messages, s.summary, s.topics) == ([], "m1 m2 m3", ["c", "a"])
    assert update(s, 9, "sing")[0] == "unknown"
    assert update(s, 9, "delete")[0] == "deleted" and update(s, 9, "delete")[0] == "missing" and not s.topics and not s.summary


def test_requests_go_from_begin_to_completed():
    s = session(request_hours=1)
    update(s, 0, message="m")
    assert [update(s, 0, "complete", "r")[0], update(s, 0, "begin", "r")[0], update(s, 1, "begin", "r")[0]] == ["missing", "started", "processing"]
    assert update(s, 2, "complete", "r", response="yes")[0] == "finished"
    assert update(s, 3, "complete", "r", response="no") == update(s, 3, "begin", "r") == ("completed", "yes")
    assert update(s, 3, "append", "r") == ("replayed", "yes") and s.version == 1
    assert update(s, HOUR + 1, "begin", "r")[0] == "completed" and update(s, HOUR + 2, "begin", "r")[0] == "started"  # completing began a new hour
    assert update(s, HOUR + 3, "complete", "r", response="é" * 16_384)[0] == "finished"  # 32 KiB exactly
    update(s, HOUR + 3, "begin", "q")
    assert update(s, HOUR + 3, "complete", "q", response="é" * 16_384 + "x")[0] == "finished_without_replay"
    assert update(s, HOUR + 4, "begin", "q") == ("completed", None)
    assert update(s, HOUR + 4, "delete")[0] == "deleted" and update(s, HOUR + 5, message="m")[0] == "applied" and update(s, HOUR + 5, "begin", "r")[0] == "started"


def test_reads_lengthen_a_life():
    s = session(memory_hours=2)
    update(s, 0, message="m")
    assert update(s, 2 * HOUR - 1, "read")[0] == "found" and update(s, 3 * HOUR, "read")[0] == "found"
    assert update(s, 5 * HOUR, "read")[0] == "missing" and s.version == 0
    assert update(s, 5 * HOUR, message="n", expected=0)[0] == "applied" and s.messages == ["n"]


def _files(spark, folder, n):
    """Updates in order of time, in ``n`` files; some without key or time."""
    rng, at, rows = random.Random(5), datetime(2024, 1, 1), []
    for i in range(240):
        at += timedelta(minutes=rng.choice([0, 1, 40, 200]))
        action = rng.choice([None, "append", "append", "append", "begin", "begin", "complete", "complete", "read", "new_thread", *(["delete"] if i % 3 == 0 else [])])
        rows.append((rng.choice(["x", "y", "z"]), at, i, action, rng.choice(["r1", "r2"] if action in ("begin", "complete") else [None, None, "", "r1"]), rng.choice([None, f"m{i}"]), rng.choice([None, "s", "t"]), rng.choice([None, None, 1]), rng.choice([None, f"a{i}"])))
    rows += [(None, at, 900, "append", None, "m", None, None, None), ("x", None, 901, "append", None, "m", None, None, None)]
    step = -(-len(rows) // n)
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        yield


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_batches_and_restarts(spark, tmp_path):
    limits = M.Limits(memory_hours=60, request_hours=12, messages=3, topics=1)
    for _ in _files(spark, str(tmp_path / "one"), 1):
        pass
    one = M.run(M.memory(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "one")), limits), str(tmp_path / "a"))
    for _ in _files(spark, str(tmp_path / "four"), 4):  # a run for each new file goes on from the checkpoint
        four = M.run(M.memory(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "four")), limits), str(tmp_path / "b"))
    want = _got(one)
    assert len(want) == 240 and _got(four) == want
    assert {"applied", "conflict", "replayed", "missing", "found", "started", "deleted", "finished"} <= {r[2] for r in want}
    held = {r["key"]: r for r in M.sessions(spark, str(tmp_path / "a")).collect()}
    for key in "xyz":
        last = [r for r in want if r[0] == key][-1]
        if key in held:
            assert (held[key]["version"], len(held[key]["messages"]), ",".join(held[key]["topics"]), held[key]["summary"]) == (last[3], last[4], last[5], last[6])
        else:
            assert last[3] == 0
    assert held


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "none"))
    assert M.run(M.memory(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))), str(tmp_path / "c")).count() == 0


def test_rows_later_than_the_watermark(spark, tmp_path):
    """A row before the last one's time, but within the watermark, is applied when it comes; one beyond it is dropped."""
    day = datetime(2024, 1, 1)
    for hours in ((0, 10), (9.5, 1), (12,)):
        rows = [("x", day + timedelta(hours=h), int(h * 10), "append", None, f"m{h}", None, None, None) for h in hours]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = M.run(M.memory(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    assert [(r[1], r[3]) for r in sorted(out.collect(), key=lambda r: r["version"])] == [(0, 1), (100, 2), (95, 3), (120, 4)]
