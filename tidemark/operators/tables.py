"""Snapshot tables on parquet: append, upsert, delete, compare-and-set and generational prune.

Parquet has no MERGE, so a write makes new files and a manifest that names them beside those that stay, and a pointer is
renamed to it; readers see the old snapshot or the new one, never half of it. Tables with a key are laid out in parts by
its hash, and a write touches the parts of its own keys only. The state transitions are plain DataFrame functions, so they
also run inside larger plans.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-null key, the last by ``order``; aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.max(F.struct(*order, *rest)).alias("_row")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c != key]).select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace those of their key, new ones are added. ``changes`` has one row per key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, overrides: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and overrides without the nodes ``gone(node_key)``, the edges that touch them and their overrides.
    The two ends are two joins, never one with OR."""
    left = edges.join(gone, edges["source_key"] == gone["node_key"], "left_anti").join(gone, F.col("target_key") == gone["node_key"], "left_anti")
    return delete_keys(nodes, gone, "node_key"), left, overrides.join(left.select("edge_key"), "edge_key", "left_semi")


def prune(edges: DataFrame, extractor: str, generation: int) -> DataFrame:
    """Without the derived edges of one extractor that are older than a generation; user edges always stay."""
    old = (F.col("origin") == "derived") & (F.col("extractor") == extractor) & (F.col("generation") < generation)
    return edges.filter(~F.coalesce(old, F.lit(False)))


def next_generation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = nodes.select("generation").unionByName(edges.select("generation"))
    return both.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def compare_and_set(overrides: DataFrame, requests: DataFrame) -> DataFrame:
    """``overrides(edge_key, action, revision)`` after ``requests(edge_key, action, expected)``, one per key: a request
    holds if the stored revision is the expected one (0: none stored); others change nothing. ``conflict`` tells."""
    both = requests.select("edge_key", F.col("action").alias("asked"), "expected").join(overrides, "edge_key", "full")
    fits = F.coalesce(F.col("revision"), F.lit(0)) == F.col("expected")
    return both.select(
        "edge_key", F.when(fits, F.col("asked")).otherwise(F.col("action")).alias("action"),
        F.when(fits, F.col("expected") + 1).otherwise(F.col("revision")).alias("revision"), F.coalesce(F.col("asked").isNotNull() & ~fits, F.lit(False)).alias("conflict"),
    )


def guarded_writes(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """``path, content_hash, outcome`` of documents ``stored(path, content_hash)`` after ``requests(path, expected,
    content_hash)``, one per path: a request that names the hash it has read is written, one that names none creates; others
    are conflicts and change nothing, as are writes to what isn't there. Paths without request are kept."""
    both = requests.select("path", "expected", F.col("content_hash").alias("_new"), F.lit(True).alias("_asked")).join(stored, "path", "full")
    outcome = F.when(F.col("_asked").isNull(), "kept").when(F.col("expected").isNull() & F.col("content_hash").isNull(), "created").when(F.col("expected") == F.col("content_hash"), "written").otherwise("conflict")
    done = both.withColumn("outcome", outcome)
    return done.select("path", F.when(F.col("outcome").isin("created", "written"), F.col("_new")).otherwise(F.col("content_hash")).alias("content_hash"), "outcome")


def visible_edges(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    return edges.join(overrides.filter(F.col("action") == "suppress").select("edge_key"), "edge_key", "left_anti")


def touching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes(node_key)``: a union of two semi-joins."""
    by = lambda end: edges.join(nodes.select(F.col("node_key").alias(end)), end, "left_semi")
    return by("source_key").unionByName(by("target_key")).distinct()


def rekey_collisions(rows: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Rows of one key and digest count once; rows of one key with another digest than its first get a key of both."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order, digest)).alias("_first")).select(key, F.col(f"_first.{digest}").alias("_digest"))
    once = rows.groupBy(key, digest).agg(F.min(F.struct(*order)).alias("_at"))
    return once.join(first, key).select(
        F.when(F.col(digest) == F.col("_digest"), F.col(key)).otherwise(F.sha2(F.concat_ws("\0", key, digest), 256)).alias(key), digest
    )


def pairs_once(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Undirected pairs, the smaller key first, with their greatest weight."""
    return pairs.groupBy(F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")).agg(F.max(weight).alias(weight))


def smallest_enclosing(spans: DataFrame, group: str, ident: str, start: str, end: str, width: int = 64) -> DataFrame:
    """``ident, owner``: for each span the smallest other one of its group that encloses it, of equal ones that with the
    smallest id; spans that nothing encloses have no row. Repeated rows count once, of several spans of an id the one with
    the smallest around it does, rows with a null are ignored.

    Spans with the same ends are one range with its two smallest ids, so lines that all of a group's spans lie on (a
    minified file) make no pairs. Ranges are posted in the blocks of ``width`` they cover, and one that a single span has
    looks only into the block it begins in."""
    rows = spans.select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(start).alias("a"), F.col(end).alias("z")).filter("g is not null and id is not null and a is not null and z is not null")
    first = rows.groupBy("g", "a", "z").agg(F.min("id").alias("one"), F.max("id").alias("last"))
    second = rows.join(first, ["g", "a", "z"]).filter("id <> one").groupBy("g", "a", "z").agg(F.min("id").alias("two"))
    ranges = first.join(second, ["g", "a", "z"], "left")
    # Another span with the same ends is the smallest there can be.
    shared = rows.distinct().join(ranges.filter("two is not null"), ["g", "a", "z"]).select("id", (F.col("z") - F.col("a")).alias("size"), F.when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("owner"))
    block = lambda c: F.floor(c / width)
    posted = ranges.select("g", F.col("a").alias("oa"), F.col("z").alias("oz"), F.col("one").alias("owner"), F.explode(F.sequence(block(F.col("a")), block(F.greatest("a", "z")))).alias("block"))
    alone = ranges.filter("two is null").select("g", "a", "z", F.col("one").alias("id"), block(F.col("a")).alias("block"))
    around = alone.join(posted, ["g", "block"]).filter("oa <= a and oz >= z and owner <> id")
    found = shared.unionByName(around.select("id", (F.col("oz") - F.col("oa")).alias("size"), "owner"))
    return found.groupBy("id").agg(F.min(F.struct("size", "owner")).alias("b")).select(F.col("id").alias(ident), F.col("b.owner").alias("owner"))


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


class SnapshotTable:
    """A parquet table in versioned folders with a manifest per version and a pointer file; one writer at a time.

    ``key``: rows lie in ``parts`` folders by the hash of their key. An append adds files to parts, an upsert, a merge and
    a deletion rewrite the parts that hold a key they name. A table without key is one part until it is first upserted.
    Files that neither the current nor the previous version names are removed."""

    def __init__(self, spark: SparkSession, root: str, key: str | None = None, parts: int = 64):
        self.spark, self.root, self.key, self.parts = spark, root.rstrip("/"), key, parts
        jvm = spark.sparkContext._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.root, *p)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the current snapshot, 0 if there is none."""
        return int(self.spark.read.text(f"{self.root}/CURRENT").first()[0]) if self._fs.exists(self._path("CURRENT")) else 0

    def _manifest(self, version: int) -> dict | None:
        """Key, number of parts, schema, and per part the versions that have files of it."""
        at = f"v{version}.json"
        return json.loads(self.spark.read.text(f"{self.root}/{at}", wholetext=True).first()[0]) if version and self._fs.exists(self._path(at)) else None

    def _read(self, manifest: dict, parts=None) -> DataFrame:
        schema = types.StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/data/v{v}/_part={p}" for p, versions in manifest["homes"].items() if parts is None or p in parts for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema=None) -> DataFrame:
        """The current snapshot; a missing table is empty if its schema is given."""
        if manifest := self._manifest(self.version()):
            return self._read(manifest)
        if schema is None:
            raise FileNotFoundError(self.root)
        return self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The parts that hold ``keys``, rows with the table's key; of a table without key all there is."""
        manifest = self._manifest(self.version())
        if manifest is None:
            raise FileNotFoundError(self.root)
        if manifest["key"] is None:
            return self._read(manifest)
        return self._read(manifest, {r[0] for r in keys.select(self._part(manifest["key"], manifest["parts"])).distinct().collect()})  # at most ``parts``

    def _part(self, key: str | None, parts: int) -> Column:
        return (F.pmod(F.xxhash64(key), F.lit(parts)) if key else F.lit(0)).cast("string")

    def _publish(self, df: DataFrame, manifest: dict | None, key: str | None, stay: dict, expected: int | None) -> int:
        """Write rows as files of a new version, name these beside those that stay, and point to it."""
        now = self.version()
        if expected is not None and expected != now:
            raise RuntimeError(f"conflict: expected version {expected}, found {now}")
        parts = manifest["parts"] if manifest and manifest["key"] == key else self.parts
        laid = df.withColumn("_part", self._part(key, parts))
        # Balanced by part where there are parts: large ones go over several tasks, small ones together.
        (laid.hint("rebalance", "_part") if key else laid).write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/data/v{now + 1}")
        wrote = [f.getPath().getName().removeprefix("_part=") for f in self._fs.listStatus(self._path("data", f"v{now + 1}")) if f.isDirectory()]
        homes = {p: list(stay.get(p, [])) + ([now + 1] if p in wrote else []) for p in sorted({*stay, *wrote})}
        schema = manifest["schema"] if manifest and stay else df.schema.jsonValue()
        self._write(json.dumps({"key": key, "parts": parts, "schema": schema, "homes": homes}), f"v{now + 1}.json")
        self._write(str(now + 1), "CURRENT.next")
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), sc._jsc.hadoopConfiguration()).rename(self._path("CURRENT.next"), self._path("CURRENT"), options)
        self._vacuum(now, homes, manifest)
        return now + 1

    def _write(self, text: str, at: str) -> None:
        out = self._fs.create(self._path(at), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _vacuum(self, before: int, homes: dict, manifest: dict | None) -> None:
        used = {(str(v), p) for h in (homes, (manifest or {}).get("homes", {})) for p, versions in h.items() for v in versions}
        for folder in self._fs.listStatus(self._path("data")):
            name = folder.getPath().getName().removeprefix("v")
            if int(name) > before + 1:
                continue
            for part in self._fs.listStatus(folder.getPath()):
                if part.isDirectory() and (name, part.getPath().getName().removeprefix("_part=")) not in used:
                    self._fs.delete(part.getPath(), True)
        if before > 1:
            self._fs.delete(self._path(f"v{before - 1}.json"), False)

    def replace(self, df: DataFrame, expected: int | None = None) -> int:
        """Write a new snapshot of all rows. With ``expected``, fail if the table moved on meanwhile."""
        return self._publish(df, self._manifest(self.version()), self.key, {}, expected)

    def append(self, df: DataFrame) -> int:
        """Add rows; what is there stays where it is."""
        manifest = self._manifest(self.version())
        if manifest is None:
            return self.replace(df)
        columns = [f["name"] for f in manifest["schema"]["fields"]]
        return self._publish(df.select(*columns), manifest, manifest["key"], manifest["homes"], None)

    def merge(self, keys: DataFrame, key: str, combine, schema=None) -> int:
        """Rewrite the parts that hold ``keys``: ``combine`` makes their new rows from their old ones. A table kept by
        another key, or by none, is written anew by this one, once."""
        manifest = self._manifest(self.version())
        if manifest is None or manifest["key"] != key:
            self.key = key
            return self.replace(combine(self.read(schema)))
        touched = {r[0] for r in keys.select(self._part(key, manifest["parts"]).alias("p")).distinct().collect()}  # at most ``parts``
        stay = {p: v for p, v in manifest["homes"].items() if p not in touched}
        return self._publish(combine(self._read(manifest, touched)), manifest, key, stay, None)

    def upsert(self, changes: DataFrame, key: str) -> int:
        """Changed rows, one per key, replace those of their key; new ones are added."""
        return self.merge(changes, key, lambda old: upsert(old, changes, key), changes.schema)

    def delete(self, keys: DataFrame, key: str) -> int:
        return self.merge(keys, key, lambda old: delete_keys(old, keys, key))
