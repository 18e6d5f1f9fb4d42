"""Snapshots, deletions, compare-and-set, and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tables as T
from tidemark.streaming import watch


def test_snapshot_table(spark, tmp_path):
    t = T.SnapshotTable(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert t.read("k string, v int").count() == 0
    with pytest.raises(FileNotFoundError):
        t.read()
    t.append(rows(("a", 1), ("b", 1)))
    t.upsert(rows(("b", 2), ("c", 2)), "k")
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]
    with pytest.raises(RuntimeError):
        t.replace(rows(), expected=1)
    assert t.version() == 2


def test_writes_touch_the_parts_of_their_keys(spark, tmp_path):
    t = T.SnapshotTable(spark, str(tmp_path / "t"), "k", parts=8)
    rows = lambda d: spark.createDataFrame(list(d.items()), "k string, v int")
    state = {f"k{i}": i for i in range(200)} | {None: 1}
    t.replace(rows(state))
    parts = lambda v: sorted(p.name for p in (tmp_path / "t" / "data" / f"v{v}").glob("_part=*"))
    assert len(parts(1)) == 8
    t.upsert(rows({"k5": -5}), "k")
    assert len(parts(2)) == 1 and parts(1) == sorted({*parts(1)})
    t.append(rows({"more": 1}))
    assert len(parts(3)) == 1
    t.delete(rows({"k7": 0}), "k")
    assert dict(map(tuple, t.read().collect())) == {k: v for k, v in state.items() if k != "k7"} | {"k5": -5, "more": 1}
    # Files of the first version that two later ones rewrote are gone.
    assert len(parts(1)) < 8 and not (tmp_path / "t" / "v2.json").exists()
    t.replace(rows({}))
    assert t.read().count() == 0 and t.append(rows({"a": 1})) == 6 and t.read().count() == 1


def test_generations_overrides_and_deletion(spark):
    e = spark.createDataFrame([("e1", "n1", "n2", "derived", "x", 1), ("e2", "n2", "n3", "derived", "x", 2), ("e3", "n1", "n3", "user", None, None)], "edge_key string, source_key string, target_key string, origin string, extractor string, generation long")
    n = spark.createDataFrame([("n1", 1), ("n2", 2), ("n3", None)], "node_key string, generation long")
    assert sorted(r.edge_key for r in T.prune(e, "x", 2).collect()) == ["e2", "e3"]
    assert T.next_generation(n, e).first()[0] == 3 and T.next_generation(n.limit(0), e.limit(0)).first()[0] == 1
    o = spark.createDataFrame([("e1", "suppress", 1), ("e3", "suppress", 1)], "edge_key string, action string, revision int")
    assert [r.edge_key for r in T.visible_edges(e, o).collect()] == ["e2"]
    nodes, edges, over = T.delete_nodes(n, e, o, n.filter("node_key = 'n2'").select("node_key"))
    assert (nodes.count(), [r.edge_key for r in edges.collect()], [r.edge_key for r in over.collect()]) == (2, ["e3"], ["e3"])
    asked = spark.createDataFrame([("e1", "restore", 0), ("e3", "restore", 1), ("e2", "suppress", 0)], "edge_key string, action string, expected int")
    got = {r.edge_key: (r.action, r.revision, r.conflict) for r in T.compare_and_set(o, asked).collect()}
    assert got == {"e1": ("suppress", 1, True), "e3": ("restore", 2, False), "e2": ("suppress", 1, False)}
    assert {r.edge_key for r in T.touching(n.filter("node_key = 'n1'").select("node_key"), e).collect()} == {"e1", "e3"}


def test_collisions_and_pairs(spark):
    r = spark.createDataFrame([("k", "h1", 0), ("k", "h1", 1), ("k", "h2", 2)], "key string, h string, at int")
    got = {x.h: x.key for x in T.rekey_collisions(r, "key", "h", ["at"]).collect()}
    assert got["h1"] == "k" and got["h2"] != "k" and len(got) == 2
    p = spark.createDataFrame([("b", "a", 0.2), ("a", "b", 0.7)], "x string, y string, w double")
    assert [tuple(x) for x in T.pairs_once(p, "x", "y", "w").collect()] == [("a", "b", 0.7)]


T0 = datetime(2024, 1, 1)


def events(spark, *seconds):
    return spark.createDataFrame([("p", T0 + timedelta(seconds=s), f"f{s % 2}") for s in seconds], "project string, at timestamp, path string")


def test_debounce_scope_and_freshness(spark):
    e = events(spark, 0, 2, 4, 20, 21)
    b = watch.debounce(e, "project", "at", "3 seconds", "path").orderBy("dirty_since").collect()
    assert [(r.events, r.dirty_paths) for r in b] == [(3, 1), (2, 2)]
    assert sorted((r.dirty_since, r.path) for r in watch.dirty_values(e, "project", "at", "3 seconds", "path").collect()) == [(T0, "f0"), (T0 + timedelta(seconds=20), "f0"), (T0 + timedelta(seconds=20), "f1")]
    bursts = watch.debounce(events(spark, 0, 10), "project", "at")
    marks = spark.createDataFrame([("p", T0)], "project string, completed_at timestamp")
    assert watch.stale_bursts(bursts, marks, "project").count() == 1 and watch.stale_bursts(bursts, marks.limit(0), "project").count() == 2
    s = spark.createDataFrame([(0,), (1,), (200,), (201,)], "dirty_paths long")
    assert [r.scope for r in watch.index_scope(s).collect()] == ["full", "paths", "paths", "full"]
    assert [r.full_walk for r in watch.overflowed(spark.createDataFrame([(100,), (101,)], "events int")).collect()] == [False, True]


def test_sync_takes_new_newer_and_gone(spark, tmp_path):
    t = T.SnapshotTable(spark, str(tmp_path / "s"))
    read = lambda d: d.selectExpr("path", "modified_at", "concat(path, '@', modified_at) AS text")
    listing = lambda **x: spark.createDataFrame(list(x.items()), "path string, modified_at int")
    watch.sync_snapshot(t, listing(a=1, b=1), read)
    watch.sync_snapshot(t, listing(a=1, b=2, c=1), read)
    watch.sync_snapshot(t, listing(b=1, c=1), read)
    assert sorted(r.text for r in t.read().collect()) == ["b@2", "c@1"]


def test_stream_upserts_and_bursts(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")], "k string, n int, v string").coalesce(1).write.parquet(str(src / "1"))
    spark.createDataFrame([("a", 1, "late"), ("c", 5, "z")], "k string, n int, v string").coalesce(1).write.parquet(str(src / "2"))
    stream = lambda: spark.readStream.schema("k string, n int, v string").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    for _ in range(2):
        watch.stream_upserts(stream(), str(tmp_path / "t"), "k", "n", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.k, r.v) for r in T.SnapshotTable(spark, str(tmp_path / "t")).read().collect()) == [("a", "y"), ("b", "x"), ("c", "z")]
    events(spark, 0, 2, 4, 20, 21, 9000).coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema("project string, at timestamp, path string").parquet(str(tmp_path / "ev"))
    q = watch.stream_bursts(live, "project", "at", "3 seconds", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.events for r in spark.sql("select events from bursts").collect()) == [2, 3]


def test_small_scans_are_spread(spark, tmp_path):
    from tidemark.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    wide, shuffled = spark.range(0, 10, 1, 64), one.groupBy("id").count()
    assert spread(wide) is wide and spread(shuffled) is shuffled


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_bursts_over_chunks(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(watch, "CHUNK_CELLS", chunk)
    rng, now, at = random.Random(chunk), 0, []
    for _ in range(300):
        now += rng.choice([0, 1, 2, 3, 4, 9])
        at.append(now)
    runs = [[at[0]]]
    for t in at[1:]:
        if t - runs[-1][-1] <= 3:
            runs[-1].append(t)
        else:
            runs.append([t])
    got = watch.debounce(events(spark, *rng.sample(at, len(at))), "project", "at", "3 seconds", "path").orderBy("dirty_since").collect()
    assert [(r.dirty_since, r.last_event, r.events, r.dirty_paths) for r in got] == [(T0 + timedelta(seconds=r[0]), T0 + timedelta(seconds=r[-1]), len(r), len({x % 2 for x in r})) for r in runs]


def test_busy_projects_try_again(spark):
    b = watch.debounce(events(spark, 0, 100, 200), "project", "at")
    jobs = spark.createDataFrame([("p", T0, T0 + timedelta(seconds=10)), ("p", T0 + timedelta(seconds=12), T0 + timedelta(seconds=20)), ("p", T0 + timedelta(seconds=110), None), ("q", T0, T0 + timedelta(days=1))], "project string, started_at timestamp, finished_at timestamp")
    got = watch.requeue(b, jobs, "project").orderBy("dirty_since").collect()
    assert [((r.fires_at - T0).seconds, r.tries) for r in got] == [(21, 7), (103, 1), (203, 1)]


def test_smallest_enclosing(spark):
    import random

    rng = random.Random(5)
    rows = [(f"s{i:03d}", rng.choice("fgh"), a := rng.randrange(300), a + rng.choice([0, 1, 5, 40, 250])) for i in range(150)] + [(f"m{i}", "min", 1, 1) for i in range(30)]
    rows += rows[:9] + [(None, "f", 1, 2), ("n", None, 1, 2), ("o", "f", None, 2)]
    df = spark.createDataFrame(rows, "i string, f string, a int, z int").withColumn("one", F.lit("clash"))
    good = {r for r in rows if None not in r}
    want = {}
    for i, f, a, z in good:
        around = [(q - p, j) for j, g, p, q in good if g == f and p <= a and q >= z and j != i]
        if around:
            want[i] = min(around)[1]
    got = T.smallest_enclosing(df, "f", "i", "a", "z").collect()
    assert {r.i: r.owner for r in got} == want and len(got) == len(want)
