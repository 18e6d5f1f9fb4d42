"""Hierarchies against a walk in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import descendants, resolve_hierarchy, resolve_parents
from tidemark.operators.notes import link_id, live_notes

SCHEMA = "id string, parent string"


def walk(parents):
    out = {}
    for k in parents:
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = parents.get(at) if parents.get(at) in parents else None
        out[k] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at) :]), -1)
    return out


def run(spark, parents, **kw):
    df = spark.createDataFrame(list(parents.items()), SCHEMA)
    rows = resolve_hierarchy(df, **kw).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.root_id, r.depth) for r in rows}, rows


@pytest.mark.parametrize("levels", [1, 3, 10, None])
def test_random_forests_with_circles(spark, levels):
    rng = random.Random(levels or 5)
    ids = [f"n{i:03d}" for i in range(120)]
    parents = {k: rng.choice([None, *ids, "unknown"]) if rng.random() < 0.9 else None for k in ids}
    got, _ = run(spark, parents, levels=levels)
    assert got == walk(parents)


def test_deep_chain_and_long_circle(spark):
    parents = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(70)}
    parents |= {f"r{i:02d}": f"r{(i + 1) % 23:02d}" for i in range(23)} | {"s0": "r05", "s1": "s0", "a0": "a0"}
    got, rows = run(spark, parents, levels=4, with_path=True)
    assert got == walk(parents)
    by = {r.id: r for r in rows}
    assert by["c069"].path == [f"c{i:03d}" for i in range(70)] and by["s1"].path is None
    assert by["r03"].on_cycle and by["a0"].on_cycle and not by["s1"].on_cycle


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(40)]
    parents = {k: rng.choice([None, *ids]) for k in ids} | {"a": "b", "b": "a", "c": "b", "d": "c", "s": "s", "t": "s"} | {f"r{i}": f"r{(i + 3) % 7}" for i in range(7)}
    want = set()
    for k in parents:
        at, n, seen = parents[k], 1, {k}
        while at is not None and at not in seen:
            want.add((at, k, n))
            seen.add(at)
            at, n = parents[at], n + 1
    rows = descendants(resolve_hierarchy(spark.createDataFrame(list(parents.items()), SCHEMA), with_path=True)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert ("c", "d", 1) in want and ("b", "d", 2) in want


def test_empty_null_and_repeated_rows(spark):
    assert resolve_hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "a"), ("b", "a")], SCHEMA)
    assert sorted((r.id, r.depth) for r in resolve_hierarchy(df).collect()) == [("a", 0), ("b", 1)]


def test_links_in_other_spellings(spark):
    rows = [("x", " VAULT:Y\n", None), ("y", None, None), ("z", "gone", None), ("u", None, "vault:z"), ("t", None, "z"), ("v", "", "  ")]
    df = spark.createDataFrame(rows, "id string, up string, down string").withColumn("parent", F.lit("clash"))
    got = {r.id: r.parent for r in resolve_parents(df, "id", "up", "down", link_id).collect()}
    assert got == {"x": "y", "y": None, "z": "t", "u": None, "t": None, "v": None}


def test_live_notes_take_the_holding_row(spark):
    rows = [(1, "a", "2024-01-01", False, "p1"), (2, "a", "2024-01-01", True, "p2"), (3, "b", "2024-02-01", False, "p3"), (4, "b", "2024-01-01", True, "p4"), (5, None, "2025-01-01", False, "p5"), (6, "c", "2024-01-01", None, None)]
    df = spark.createDataFrame(rows, "row_no long, id string, s string, is_deleted boolean, path string").withColumn("synced_at", F.col("s").cast("timestamp"))
    assert sorted((r.id, r.path) for r in live_notes(df, ["path"]).collect()) == [("b", "p3"), ("c", None)]
