"""Watching files: debounce, freshness, scope and incremental sync, in batch and as streams.

Every event resets a project's timer and the batch fires after a quiet gap; in event time that is a session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_periods
from tidemark.operators.tables import SnapshotTable, delete_keys
from tidemark.session import cut_lineage

#: Dirty paths from which a full walk is cheaper; events a watcher may hold.
MOST_PATHS, MOST_EVENTS = 200, 100


#: Busy cells of a key that one task puts in order.
CHUNK_CELLS = 4096


def _cell_runs(events: DataFrame, key: str, at: str, gap: str) -> tuple[DataFrame, object]:
    """Cells of the gap's length that have events, with ``run``, the first event of the burst they belong to, and the cell
    of an event. Events in one cell always belong together, so they become one row before the shuffle. Cells of a key are
    ordered in chunks: what lies before a chunk, and the burst that reaches into it, come from one row per chunk."""
    width = pd.Timedelta(gap) // pd.Timedelta(microseconds=1)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cell = F.floor(micros / F.lit(width))
    cells = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, cell.alias("cell")).agg(F.min(micros).alias("a"), F.max(micros).alias("z"), F.count("*").alias("n"))
    cells = cells.withColumn("chunk", F.floor(F.col("cell") / CHUNK_CELLS))
    inside, over = Window.partitionBy(key, "chunk").orderBy("a"), Window.partitionBy(key).orderBy("chunk")
    ends = cells.groupBy(key, "chunk").agg(F.max("z").alias("z")).select(F.col(key).alias("_k"), F.col("chunk").alias("_c"), F.lag("z").over(over).alias("_z"))
    met = cells.join(ends, (F.col(key) == F.col("_k")) & (F.col("chunk") == F.col("_c"))).drop("_k", "_c")
    before = F.coalesce(F.lag("z").over(inside), F.col("_z"))
    fresh = met.withColumn("start", F.when(before.isNull() | (F.col("a") > before + width), F.col("a"))).drop("_z")
    carried = F.max("start").over(over.rowsBetween(Window.unboundedPreceding, -1))
    starts = fresh.groupBy(key, "chunk").agg(F.max("start").alias("start")).select(F.col(key).alias("_k"), F.col("chunk").alias("_c"), carried.alias("_start"))
    met = fresh.join(starts, (F.col(key) == F.col("_k")) & (F.col("chunk") == F.col("_c")))
    run = F.coalesce(F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_start"))
    return met.select(key, "cell", "a", "z", "n", run.alias("run")), cell


def debounce(events: DataFrame, key: str, at: str, gap: str = "3 seconds", value: str | None = None) -> DataFrame:
    """``key, dirty_since, last_event, events`` of each burst: events no farther apart than the gap. With ``value`` also
    ``dirty_paths``, the number of its distinct values. Events without key or time are ignored; null values count for
    nothing. A key with a third of all events is as many rows as it has busy cells of the gap's length, in chunks."""
    cells, _ = _cell_runs(events, key, at, gap)
    bursts = cells.groupBy(key, "run").agg(F.timestamp_micros(F.min("a")).alias("dirty_since"), F.timestamp_micros(F.max("z")).alias("last_event"), F.sum("n").alias("events"))
    if value:
        counts = dirty_values(events, key, at, gap, value).groupBy(F.col(key).alias("_k"), F.unix_micros("dirty_since").alias("_run")).agg(F.count("*").alias("dirty_paths"))
        bursts = bursts.join(counts, (F.col(key) == F.col("_k")) & (F.col("run") == F.col("_run")), "left").select(key, "dirty_since", "last_event", "events", F.coalesce("dirty_paths", F.lit(0)).alias("dirty_paths"))
    return bursts.drop("run")


def dirty_values(events: DataFrame, key: str, at: str, gap: str, value: str) -> DataFrame:
    """``key, dirty_since, value``: the distinct values of each burst, one row each, however many a burst has."""
    cells, cell = _cell_runs(events, key, at, gap)
    seen = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("_k"), cell.alias("_c"), value).distinct()
    met = seen.join(cells.select(key, "cell", "run"), (F.col("_k") == F.col(key)) & (F.col("_c") == F.col("cell")))
    return met.select(key, F.timestamp_micros("run").alias("dirty_since"), value).distinct()


def requeue(bursts: DataFrame, jobs: DataFrame, key: str, quiet: str = "3 seconds", retry: str = "3 seconds") -> DataFrame:
    """``key, dirty_since, fires_at, tries``: when the run of each burst gets its turn. It asks first when the burst has been
    quiet, and again after each ``retry`` while a job of its key is running (``jobs``: key, started_at, finished_at; jobs
    without end are none). Jobs less than a retry apart leave no turn between them."""
    wait, step = (pd.Timedelta(x) // pd.Timedelta(microseconds=1) for x in (quiet, retry))
    held = jobs.filter("finished_at is not null").select(F.col(key).alias("entity"), F.unix_micros(F.col("started_at").cast("timestamp")).alias("s"), (F.unix_micros(F.col("finished_at").cast("timestamp")) + step).alias("e"))
    busy = merge_periods(held.select("entity", F.timestamp_micros("s").alias("s"), F.timestamp_micros("e").alias("e")), "entity", "s", "e")
    asks = bursts.select(key, "dirty_since", (F.unix_micros("last_event") + wait).alias("at"))
    # Busy periods don't overlap, so the last one that began before a turn is the one that may hold it up.
    marks = asks.select(key, "at", "dirty_since", F.lit(None).cast("long").alias("until")).unionByName(
        busy.select(F.col("entity").alias(key), F.col("period_start").alias("at"), F.lit(None).cast("timestamp").alias("dirty_since"), (F.col("period_end") - step).alias("until"))
    )
    last = F.last("until", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", F.col("until").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    tries = F.when(last > F.col("at"), F.ceil((last - F.col("at")) / step)).otherwise(0)
    return marks.withColumn("again", tries).filter("dirty_since is not null").select(key, "dirty_since", F.timestamp_micros(F.col("at") + F.col("again") * step).alias("fires_at"), (F.col("again") + 1).cast("int").alias("tries"))


def overflowed(bursts: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """A burst of more events than a watcher can hold asks for a full walk."""
    return bursts.withColumn("full_walk", F.col("events") > most)


def stale_bursts(bursts: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Bursts that no completed run covers: runs that ended at or after the burst began suppress it. ``markers``: key,
    completed_at."""
    last = markers.groupBy(key).agg(F.max("completed_at").alias("_done"))
    return bursts.join(last, key, "left").filter(F.col("_done").isNull() | (F.col("_done") < F.col("dirty_since"))).drop("_done")


def index_scope(bursts: DataFrame, initialised: F.Column | None = None) -> DataFrame:
    """'paths' or 'full': a run takes single paths only where the index exists and a few are dirty."""
    ready = F.lit(True) if initialised is None else initialised
    n = F.col("dirty_paths")
    return bursts.withColumn("scope", F.when(ready & (n > 0) & (n <= MOST_PATHS), "paths").otherwise("full"))


def sync_snapshot(table: SnapshotTable, listing: DataFrame, read, key: str = "path") -> int:
    """One incremental sync: ``listing`` (path, modified_at) is what is on disk; gone notes are deleted, new and newer
    ones are read by ``read(paths)`` and replace theirs. Only the table's parts that hold such notes are rewritten. The new
    snapshot becomes current as a whole or not at all."""
    stored = table.read(read(listing.limit(0)).schema)
    times = stored.groupBy(key).agg(F.max("modified_at").alias("_stored"))
    both = cut_lineage(listing.withColumn("_listed", F.lit(True)).join(times, key, "full").filter(F.col("_listed").isNull() | F.col("_stored").isNull() | (F.col("modified_at") > F.col("_stored"))))
    fresh = cut_lineage(read(both.filter("_listed").drop("_listed", "_stored")))
    moved = both.select(key)
    return table.merge(moved, key, lambda old: delete_keys(old, moved, key).unionByName(fresh), fresh.schema)


def stream_bursts(events: DataFrame, key: str, at: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """The streaming form of ``debounce``: a burst is emitted once the watermark has passed its end."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(key).isNotNull()).withWatermark(at, lateness)
    burst = timed.groupBy(F.col(key), F.session_window(F.col(at), gap).alias("_w"))
    return burst.agg(F.min(at).alias("dirty_since"), F.max(at).alias("last_event"), F.count("*").alias("events")).drop("_w")


def stream_upserts(events: DataFrame, root: str, key: str, order: str, checkpoint: str):
    """A stream of changed rows into a snapshot table: each micro-batch keeps the last row per key and is upserted; a
    batch that fails is replayed from the checkpoint and, being an upsert by key, changes nothing twice."""
    from tidemark.operators.tables import last_per_key

    spark = events.sparkSession
    table = SnapshotTable(spark, root, key)

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            newest = last_per_key(batch, key, [order])
            # A replayed or late row must not undo a newer one.
            table.merge(newest, key, lambda old: last_per_key(old.unionByName(newest), key, [order]), newest.schema)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_lint(jobs: DataFrame) -> DataFrame:
    """Jobs whose rows contradict the life of a job: a terminal state with no end, an end before the start, progress
    outside 0..100, or several states under one id."""
    many = jobs.groupBy("job_id").agg(F.countDistinct("status").alias("states"), F.max("status").alias("status"), F.max("started_at").alias("s"), F.max("finished_at").alias("f"), F.max("progress").alias("p"), F.min("progress").alias("q"))
    ended = F.col("status").isin("succeeded", "failed", "cancelled")
    wrong = F.when(F.col("states") > 1, "several_states").when(ended & F.col("f").isNull(), "no_end").when(F.col("f") < F.col("s"), "ends_before_start").when((F.col("p") > 100) | (F.col("q") < 0), "progress")
    return many.select("job_id", wrong.alias("problem")).filter("problem is not null")
