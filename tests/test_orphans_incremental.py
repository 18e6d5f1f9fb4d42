"""Orphan references, and processing of changes only, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental
from tidemark.operators.incremental import MerkleStore, bits_for, replay_jobs
from tidemark.operators.orphans import orphan_records, orphan_report, parents, references


def test_orphans(spark):
    kids = spark.createDataFrame([("r1", "a", "2024-01"), ("r1", "a", "2024-01"), ("r2", "x", "2024-01"), ("r3", "x", None), ("r4", None, "2024-01"), ("r5", "y", "2024-02")], "k string, ref string, month string")
    kids = kids.withColumn("parent_table", F.lit("clash"))
    tops = spark.createDataFrame([("a",), (None,), ("a",)], "key string")
    c = references(kids, "t", F.col("k"), "ref", F.lit("p"), F.col("ref"), F.col("month"))
    p = parents(tops, "p", "key")
    got = sorted((r.record_key, r.period or "") for r in orphan_records(c, p).collect())
    assert got == [("r2", "2024-01"), ("r3", ""), ("r5", "2024-02")]
    report = {(r.period, r.orphans, r.missing_keys) for r in orphan_report(c, p).collect()}
    assert report == {("2024-01", 1, 1), (None, 1, 1), ("2024-02", 1, 1)}
    assert orphan_records(c.limit(0), p).count() == 0 and orphan_records(c, p.limit(0)).count() == 4


CHANGES = "change_id long, project string, corpus string, path string, content_hash string, modified_at timestamp, arrived_at timestamp, extra string"
JOBS = "job_id long, project string, corpus string, status string, started_at timestamp"


def expected(changes, jobs):
    out, last = set(), {}
    done = {j[0]: j for j in jobs if j[3] == "succeeded" and j[4]}
    for j in sorted(done.values(), key=lambda j: (j[4], j[0])):
        state = {}
        for c in changes:
            if c[1:3] == j[1:3] and c[3] is not None and c[6] <= j[4]:
                state[c[3]] = max(state.get(c[3], (datetime.min, -1, None)), (c[5], c[0], c[4]), key=lambda s: s[:2])
        before = last.get(j[1:3], {})
        out |= {(j[0], p) for p, s in state.items() if s[2] is not None and before.get(p) != s[2]}
        last[j[1:3]] = {p: s[2] for p, s in state.items()}
    return out


@pytest.mark.parametrize("seed,node_runs,bits", [(1, 64, 4), (2, 2, 8), (3, 3, None)])
def test_replay(spark, monkeypatch, seed, node_runs, bits):
    monkeypatch.setattr(incremental, "NODE_RUNS", node_runs)
    rng = random.Random(seed)
    t = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000))
    changes = []
    for i in range(300):
        m = t()
        changes.append((i, rng.choice("PPQ"), "code", rng.choice([f"f{x}" for x in range(12)] + ["hot"] * 6 + [None]), rng.choice(["h1", "h2", None]), m, m + timedelta(minutes=rng.choice([0, 5, 500])), "x"))
    jobs = [(i, rng.choice("PQR"), "code", rng.choice(["succeeded", "succeeded", "failed", "running"]), t()) for i in range(25)]
    jobs += jobs[:5]
    got = [tuple(r) for r in replay_jobs(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(jobs, JOBS), bits=bits).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(changes, jobs)


def test_replay_of_nothing(spark):
    assert replay_jobs(spark.createDataFrame([], CHANGES), spark.createDataFrame([], JOBS)).count() == 0


def test_store_survives_failures(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "store"), bits=4)
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, digest string")
    one = {f"k{i}": "a" for i in range(50)}
    assert {r.key for r in store.run(frame(one), "r1").collect()} == set(one)
    two = one | {"k3": "b", "new": "c"}
    del two["k7"]

    def fail():
        raise OSError("killed")

    with pytest.raises(OSError):
        store.run(frame(two), "r2", before_publish=fail)
    assert store.current() == "r1"
    got = {(r.key, r.digest, r.was) for r in store.run(frame(two), "r2").collect()}
    assert got == {("k3", "b", "a"), ("new", "c", None), ("k7", None, "a")}
    assert store.run(frame(two), "r2").count() == 3 and store.run(frame(two), "r3").count() == 0


def folders(path):
    return sorted(p.relative_to(path).as_posix() for p in path.glob("*/snapshot/range=*"))


def test_store_reads_only_leaves_that_differ(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "s"), bits=12)
    frame = lambda d: spark.createDataFrame([*d.items(), *list(d.items())[:50], (None, "x")], "key string, digest string")
    state = {f"k{i}": "a" for i in range(3000)}
    assert store.run(frame(state), "r1").count() == 3000
    first = len(folders(tmp_path / "s"))
    state |= {"k5": "b", "k6": "b", "more": "a"}
    del state["k9"]
    got = {(r.key, r.digest, r.was) for r in store.run(frame(state), "r2").collect()}
    assert got == {("k5", "b", "a"), ("k6", "b", "a"), ("more", "a", None), ("k9", None, "a")}
    assert store.seen["leaves"] <= 4 and store.seen["of"] == 4096 and store.seen["ranges"] <= 4
    assert sum(f.startswith("r2/") for f in folders(tmp_path / "s")) <= 4 and len(folders(tmp_path / "s")) <= first + 4
    assert store.run(frame(state), "r3").count() == 0 and store.seen["leaves"] == 0
    # What only r1 had of the ranges that r2 rewrote isn't needed any more.
    assert len(folders(tmp_path / "s")) == first
    assert store.run(frame({}), "r4").count() == len(state) and store.run(frame(state), "r5").count() == len(state)


def test_store_grows_its_leaves(spark, tmp_path):
    assert [bits_for(n) for n in (0, 64 * 16, 64 * 16 + 1, 10**9)] == [4, 4, 8, 24]
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, digest string")
    state = {f"k{i}": "a" for i in range(500)}
    MerkleStore(spark, str(tmp_path / "s"), bits=8).run(frame(state), "r1")
    grown = MerkleStore(spark, str(tmp_path / "s"), bits=12)
    assert {r.key for r in grown.run(frame(state | {"k1": "b"}), "r2").collect()} == {"k1"} and grown.seen["of"] == 4096


def test_store_refuses_an_input_that_changes(spark, tmp_path):
    store = MerkleStore(spark, str(tmp_path / "s"))
    moving = spark.range(50).select(F.col("id").cast("string").alias("key"), F.expr("cast(java_method('java.lang.System', 'nanoTime') as string)").alias("digest"))
    with pytest.raises(RuntimeError):
        store.run(moving, "r1")
    assert store.current() is None
