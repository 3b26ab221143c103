"""Topological layers and cyclic cores against the standard library and brute force."""

from __future__ import annotations

import graphlib
import random

import pytest

from docfathom.operators import graph as G


def brute(edges):
    """Longest way from a source, None on or after a cycle."""
    nodes, into = {n for e in edges for n in e}, {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    layer, changed = {}, True
    while changed:
        changed = False
        for n in nodes - set(layer):
            if into.get(n, set()) <= set(layer):
                layer[n], changed = max((layer[p] + 1 for p in into.get(n, ())), default=0), True
    return {n: layer.get(n) for n in nodes}


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.append(b)
                break
        else:
            todo.pop()
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_layers_and_core(spark, tmp_path, seed):
    rng = random.Random(seed)
    edges = {(rng.randint(0, 24), rng.randint(0, 24)) for _ in range(30)}
    edges = {(a, b) for a, b in edges if a < b or (seed and rng.random() < 0.3)}
    edges |= {(7, 8), (8, 7), (20, 21), (21, 22), (22, 20)} if seed else set()
    rows = [(a, b) for a, b in edges] * 2 + [(None, 3), (3, None)]
    df = spark.createDataFrame(rows, "`from` long, `to` long")
    got = {r["node"]: r["layer"] for r in G.layers(df, str(tmp_path / "l")).collect()}
    assert got == brute(edges)
    acyclic = None not in got.values()
    assert acyclic == (seed == 0)
    try:
        order = list(graphlib.TopologicalSorter({b: {a for a, c in edges if c == b} for _, b in edges}).static_order())
        assert acyclic and all(got[a] < got[b] for a, b in edges) and len(order) == len(got)
    except graphlib.CycleError:
        assert not acyclic
    ways = {n: reach(edges, n) for n in got}
    cycle = {n for n in got if n in ways[n]}
    core = {(a, b) for a, b in edges if (a in cycle or any(a in ways[c] for c in cycle)) and (b in cycle or ways[b] & cycle)}
    assert {tuple(r) for r in G.cyclic_core(df, str(tmp_path / "c")).collect()} == core


def test_cycles_of_tracks(spark, tmp_path):
    df = spark.createDataFrame([("next", "a", "b"), ("next", "b", "c"), ("alternative", "c", "a")], "relation string, `from` string, `to` string")
    assert not G.has_cycle(df, str(tmp_path / "1"))
    assert G.has_cycle(df.replace("alternative", "next"), str(tmp_path / "2"))
    assert G.has_cycle(spark.createDataFrame([("x", "x")], "`from` string, `to` string"), str(tmp_path / "3"))
    assert not G.has_cycle(df.limit(0), str(tmp_path / "4")) and G.layers(df.limit(0), str(tmp_path / "5")).count() == 0
