"""Processing only new or changed records, by Merkle trees over key ranges.

Keys are placed on a 64-bit ring by a hash and the ring is cut into 2**bits leaf ranges, as many as give a leaf some
LEAF_RECORDS records. The digest of a range is the exclusive-or of two independent 64-bit hashes of its records, with
their number; that of a node is the same over its children. So digests combine before a shuffle in any order, and a record
that comes or goes changes the nodes above it and no others. Trees are compared from the root down: children are looked at
only under nodes whose digests differ, and records are compared only in leaves that do.

``replay_jobs`` goes through a history: a record enters its leaf in the run it first shows in and leaves it in the run it
is replaced in. Folding these toggles up and summing them along the runs gives the tree of every run, in proportion to the
changes and whatever the number of runs. ``MerkleStore`` does single runs and publishes output, snapshot and tree together:
all are written to a new folder, which becomes current by one atomic rename of a pointer; a run that fails before leaves the
last one in force and is simply repeated. Leaves and keys spread a project that has a third of all rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

FANOUT_BITS = 4
#: Records a leaf should hold.
LEAF_RECORDS = 64
#: Runs, or ranges of runs, that one node of the search for a run holds.
NODE_RUNS = 64


def bits_for(records: int, least: int = FANOUT_BITS, most: int = 48) -> int:
    """Bits of the leaf ranges for so many records, a multiple of FANOUT_BITS."""
    bits = FANOUT_BITS
    while bits < most and records > LEAF_RECORDS << bits:
        bits += FANOUT_BITS
    return max(bits, least)


def leaf_of(key: Column, bits: int) -> Column:
    """Leaf range of a key: the top bits of its place on the hash ring."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _record(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("key"), F.col("digest"))


def fold_leaves(records: DataFrame, keys: list[str], bits: int, sign: Column) -> DataFrame:
    """``keys, level, node, a, b, rows`` of all levels, from records ``keys, node, key, digest``; level ``bits /
    FANOUT_BITS`` holds the leaves, 0 the root. ``sign``: 1 where a record enters, -1 where it leaves."""
    folds = lambda rows: [F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), rows.alias("rows")]
    leaves = records.select(*keys, "node", _record(1).alias("a"), _record(2).alias("b"), sign.alias("rows")).groupBy(*keys, "node").agg(*folds(F.sum("rows")))
    depth = bits // FANOUT_BITS
    up = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.expr(f"shiftright(node, {bits - d * FANOUT_BITS})").alias("at")) for d in range(depth + 1)]))
    every = leaves.select(*keys, up.alias("n"), "a", "b", "rows").select(*keys, "n.level", F.col("n.at").alias("node"), "a", "b", "rows")
    return every.groupBy(*keys, "level", "node").agg(*folds(F.sum("rows")))


def descend(nodes: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``keys, node``: leaves that differ. ``nodes``: keys, level, node, differs. Goes down a level at a time and joins
    only the children of nodes that differ above."""
    found = None
    for d in range(bits // FANOUT_BITS + 1):
        here = nodes.filter((F.col("level") == d) & F.col("differs")).select(*keys, "node")
        if found is not None:
            above = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_n"))
            on = F.shiftright(here["node"], FANOUT_BITS) == F.col("_n")
            for k in keys:
                on &= here[k] == F.col(f"_{k}")
            here = here.join(above, on, "left_semi")
        found = here
    return found


def succeeded_runs(jobs: DataFrame) -> DataFrame:
    """``group(project, corpus), run, job_id, started_at``: succeeded jobs numbered from 0 within their group by
    started_at, then job_id. Repeated rows of a job count once; jobs of another status, or without start, commit
    nothing."""
    done = jobs.filter("status = 'succeeded' and started_at is not null").select("job_id", F.struct("project", "corpus").alias("group"), "started_at").dropDuplicates(["job_id"])
    return done.withColumn("run", F.row_number().over(Window.partitionBy("group").orderBy("started_at", "job_id")) - 1)


def first_run_from(rows: DataFrame, at: str, runs: DataFrame) -> DataFrame:
    """``rows(group, ...)`` with ``first_run``, the first run of the group that started at ``at`` or later; rows before
    none are dropped. Runs are put under a tree whose nodes have NODE_RUNS children, and rows go down it by one join a
    level, so no row ever carries more than a node, however many runs a group has."""
    last = runs.agg(F.max("run")).first()[0]
    if last is None:
        return rows.limit(0).withColumn("first_run", F.lit(None).cast("int"))
    levels = 1
    while NODE_RUNS**levels <= last:
        levels += 1
    rows = rows.withColumn("first_run", F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        ends = runs.groupBy("group", F.expr(f"run div {NODE_RUNS**level}").alias("child")).agg(F.max("started_at").alias("end"))
        node = ends.groupBy(F.col("group").alias("_g"), F.expr(f"child div {NODE_RUNS}").alias("_n")).agg(F.sort_array(F.collect_list("end")).alias("_ends"))
        below = F.size(F.filter("_ends", lambda e: e < F.col(at)))
        met = rows.join(node, (F.col("group") == F.col("_g")) & (F.col("first_run") == F.col("_n"))).withColumn("_below", below).filter(F.col("_below") < F.size("_ends"))
        rows = met.withColumn("first_run", F.col("first_run") * NODE_RUNS + F.col("_below")).drop("_g", "_n", "_ends", "_below")
    return rows.withColumn("first_run", F.col("first_run").cast("int"))


def path_versions(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions ``group, key, digest, first_run, next_run`` of the paths as the runs see them (no next_run: it stands to
    the end): a path's state is its row with the greatest modified_at, then change_id, among those with arrived_at <=
    started_at; deleted and unseen paths have no version. Rows without path or arrival are ignored.

    Rows are first reduced to the newest per path and run they first show in (a combine before the shuffle), so that a
    path with a third of all rows becomes a few rows."""
    known = changes.filter("path is not null and arrived_at is not null").select(F.struct("project", "corpus").alias("group"), "path", "modified_at", "change_id", "content_hash", "arrived_at")
    newest = first_run_from(known, "arrived_at", runs).groupBy("group", "path", "first_run").agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("state"))
    order = Window.partitionBy("group", "path").orderBy("first_run")
    return (
        newest.withColumn("state", F.max("state").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_run", F.lead("first_run").over(order))
        .filter("state.content_hash is not null")
        .select("group", F.col("path").alias("key"), F.col("state.content_hash").alias("digest"), "first_run", "next_run")
    )


def replay_jobs(changes: DataFrame, jobs: DataFrame, bits: int | None = None) -> DataFrame:
    """``job_id, path`` that each succeeded job must take; a group's first job meets an empty tree. Empty tables give an
    empty result. ``bits``: of the leaf ranges, by default after the largest group."""
    runs = cut_lineage(succeeded_runs(jobs))
    come = F.struct(F.col("first_run").alias("run"), F.lit(1).alias("way"))
    go = F.when(F.col("next_run").isNotNull(), F.struct(F.col("next_run").alias("run"), F.lit(-1).alias("way")))
    toggles = path_versions(changes, runs).select("group", "key", "digest", F.explode(F.array_compact(F.array(come, go))).alias("t")).select("group", "key", "digest", "t.run", "t.way")
    toggles = cut_lineage(toggles)
    if bits is None:
        bits = bits_for(toggles.groupBy("group").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    toggles = toggles.withColumn("node", leaf_of(F.col("key"), bits))
    moves = fold_leaves(toggles, ["group", "run"], bits, F.col("way"))
    # A node's digest in a run folds all its moves up to then; what the run before saved is that of its last move.
    upto = Window.partitionBy("group", "level", "node").orderBy("run")
    sums = {c: f(c).over(upto.rowsBetween(Window.unboundedPreceding, 0)) for c, f in (("a", F.bit_xor), ("b", F.bit_xor), ("rows", F.sum))}
    tree = moves.select("group", "run", "level", "node", F.struct(*[x.alias(c) for c, x in sums.items()]).alias("mine"))
    nothing = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("rows"))
    tree = cut_lineage(tree.withColumn("differs", F.col("mine") != F.coalesce(F.lag("mine").over(upto), nothing)).drop("mine"))
    leaves = descend(tree, ["group", "run"], bits)
    # A record of such a leaf shows in the run it comes in as what is, and in the run it goes in as what was.
    met = toggles.join(leaves, ["group", "run", "node"], "left_semi")
    changed = met.groupBy("group", "run", "key").agg(F.max(F.when(F.col("way") > 0, F.col("digest"))).alias("digest"), F.max(F.when(F.col("way") < 0, F.col("digest"))).alias("was"))
    taken = changed.filter(F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("was")))
    return taken.join(runs.select("group", "run", "job_id"), ["group", "run"]).select("job_id", F.col("key").alias("path"))


class MerkleStore:
    """Output, snapshot and tree of the last successful run in one folder per run; ``CURRENT`` names the folder.

    ``run`` computes the changes against the saved tree, hands them to ``process`` and publishes everything at once. If
    it fails or is killed at any point before the rename, the next run sees the same saved tree and takes the same
    records; if it is killed after, nothing is taken twice. Leftovers of failed runs are never read.

    The snapshot is laid out by ranges of leaves, a folder each. A run reads and writes only folders in which a leaf
    differs, and in these only the row groups of such leaves; its manifest names the run that wrote each of the others.
    Folders that neither the published run nor the one before needs are removed."""

    RANGE_BITS = 8

    def __init__(self, spark: SparkSession, root: str, bits: int | None = None):
        self.spark, self.root, self._bits = spark, root.rstrip("/"), bits
        #: Of the last run: leaves that differed, of how many, and ranges that were read and written.
        self.seen: dict = {}
        jvm = spark.sparkContext._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *p)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """Name of the published run, or None."""
        return self._read("CURRENT")

    def _read(self, *at: str) -> str | None:
        if not self._fs.exists(self._path(*at)):
            return None
        return self.spark.read.text("/".join((self.root, *at)), wholetext=True).first()[0]

    def _write(self, text: str, *at: str) -> None:
        out = self._fs.create(self._path(*at), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _manifest(self) -> dict:
        name = self.current()
        return json.loads(self._read(name, "manifest.json")) if name else {"run": None, "bits": 0, "rows": 0, "homes": {}, "before": None}

    def _records(self, homes: dict) -> DataFrame:
        """Snapshot rows ``key, digest, node`` of the ranges named."""
        schema = "key string, digest string, ring long"
        paths = [f"{self.root}/{home}/snapshot/range={r}" for r, home in homes.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _tree(self, records: DataFrame, bits: int) -> DataFrame:
        return fold_leaves(records.withColumn("node", F.shiftrightunsigned("ring", 64 - bits)), [], bits, F.lit(1))

    def run(self, current: DataFrame, run_name: str, process=lambda changes: changes, before_publish=lambda: None) -> DataFrame:
        """Process what changed in ``current(key, digest)`` and publish; returns the published output, by default ``key,
        digest, was`` of new and changed (digest) and gone keys (no digest). A null key is no record; of repeated rows of a
        key the greatest digest counts. A run name that is already current is a repeated call and changes nothing. If the
        input reads otherwise the second time, the run fails and publishes nothing."""
        saved = self._manifest()
        if saved["run"] == run_name:
            return self.spark.read.parquet(f"{self.root}/{run_name}/output")
        at = f"{self.root}/{run_name}"
        ring = F.xxhash64("key")
        state = current.filter("key is not null").select("key", "digest").groupBy("key").agg(F.max("digest").alias("digest")).withColumn("ring", ring)
        bits = self._bits or bits_for(saved["rows"] or state.count(), self.RANGE_BITS)
        bits = max(bits, saved["bits"], self.RANGE_BITS)
        self._tree(state, bits).sort("level", "node").write.mode("overwrite").partitionBy("level").parquet(f"{at}/tree")
        schema = "level int, node long, a long, b long, rows long"
        mine = self.spark.read.schema(schema).parquet(f"{at}/tree")
        if saved["run"] is None:
            old = self.spark.createDataFrame([], schema)
        elif saved["bits"] == bits:
            old = self.spark.read.schema(schema).parquet(f"{self.root}/{saved['run']}/tree")
        else:
            # The collection has outgrown its leaves: the saved snapshot is folded anew, once.
            old = cut_lineage(self._tree(self._records(saved["homes"]), bits))
        both = mine.select("level", "node", F.struct("a", "b", "rows").alias("mine")).join(old.select("level", "node", F.struct("a", "b", "rows").alias("theirs")), ["level", "node"], "full")
        leaves = cut_lineage(descend(both.withColumn("differs", ~F.col("mine").eqNullSafe(F.col("theirs"))), [], bits))
        place = lambda c, width: F.shiftrightunsigned(c, 64 - width)
        touched = sorted(r[0] for r in leaves.select(F.shiftright("node", bits - self.RANGE_BITS)).distinct().collect())  # at most 2**RANGE_BITS
        fresh = state.withColumn("range", place(F.col("ring"), self.RANGE_BITS)).filter(F.col("range").isin(touched) if touched else F.lit(False))
        fresh.repartition("range").sortWithinPartitions("range", "ring").write.mode("overwrite").partitionBy("range").parquet(f"{at}/snapshot")
        there = {str(r): run_name for r in touched if self._fs.exists(self._path(run_name, "snapshot", f"range={r}"))}
        wrote = self._records(there).withColumn("node", place(F.col("ring"), bits))
        again = fold_leaves(wrote, [], bits, F.lit(1)).filter(F.col("level") == bits // FANOUT_BITS)
        if not again.select("node", "a", "b", "rows").exceptAll(mine.select("node", "a", "b", "rows")).isEmpty():
            raise RuntimeError("the input changed while it was read")
        kept = {r: home for r, home in saved["homes"].items() if int(r) not in touched}
        had = self._records({r: home for r, home in saved["homes"].items() if int(r) in touched}).withColumn("node", place(F.col("ring"), bits))
        pick = lambda df, name: df.join(leaves, "node", "left_semi").select("key", F.col("digest").alias(name))
        changed = pick(wrote, "digest").join(pick(had, "was"), "key", "full").filter(~F.col("digest").eqNullSafe(F.col("was")))
        process(changed).write.mode("overwrite").parquet(f"{at}/output")
        rows = mine.filter("level = 0").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        self.seen = {"leaves": leaves.count(), "of": 2**bits, "ranges": len(touched), "rows": rows}
        self._write(json.dumps({"run": run_name, "bits": bits, "rows": rows, "homes": kept | there, "before": saved["run"]}), run_name, "manifest.json")
        before_publish()
        self._publish(run_name)
        self._vacuum(run_name, saved)
        return self.spark.read.parquet(f"{at}/output")

    def _publish(self, run_name: str) -> None:
        new = f"CURRENT.{run_name}"
        self._write(run_name, new)
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path("CURRENT"), overwrite)

    def _vacuum(self, run_name: str, saved: dict) -> None:
        """Remove what neither the published run nor the one before reads."""
        homes = json.loads(self._read(run_name, "manifest.json"))["homes"]
        whole = {run_name, saved["run"]}
        used = {f"{home}/range={r}" for h in (homes, saved["homes"]) for r, home in h.items()}
        for entry in self._fs.listStatus(self._path()):
            name = entry.getPath().getName()
            if not entry.isDirectory() or name in whole:
                continue
            if not any(u.startswith(f"{name}/") for u in used):
                self._fs.delete(entry.getPath(), True)
                continue
            for part in ("tree", "output"):
                self._fs.delete(self._path(name, part), True)
            for folder in self._fs.listStatus(self._path(name, "snapshot")):
                if folder.isDirectory() and f"{name}/{folder.getPath().getName()}" not in used:
                    self._fs.delete(folder.getPath(), True)
