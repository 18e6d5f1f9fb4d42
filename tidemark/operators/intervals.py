"""Merging intervals per entity into continuous periods, and the gaps between them, in two levels.

Entities with more starts than a task may order are cut into time shards of about equal numbers of starts, so shards are
short where intervals are dense. Level one clips each interval at the borders of its shards and merges what lies inside
one (entity, shard); shards that an interval covers whole aren't written out one by one but stay one span of shard
numbers. Level two sees only the pieces that touch a shard border, and the spans: per entity a few rows per shard, however
many intervals there are. All other entities have one shard without borders, in which level one is all there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import utc_text
from tidemark.session import cut_lineage

#: End of an interval without end, as microseconds; later than any readable date.
OPEN = 2**62
#: Different starts of one entity that one task may order, and the most shards an entity is cut into.
SHARD_ROWS, SHARDS = 100_000, 256


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def _borders(rows: DataFrame, at: str, shard_rows: int) -> DataFrame | None:
    """``entity, cuts``: the shard borders of entities with more than ``shard_rows`` rows, at quantiles of ``at``; None if
    there are none. Such entities are few: no more than all rows by ``shard_rows``."""
    count = F.count("*").alias("_n")
    if (big := cut_lineage(rows.groupBy("entity").agg(count).filter(F.col("_n") > shard_rows).select(F.col("entity").alias("_big")))).isEmpty():
        return None
    mine = rows.join(big, F.col("entity") == F.col("_big"), "left_semi")
    quantiles = F.percentile_approx(at, [i / SHARDS for i in range(1, SHARDS)], 10_000)
    return cut_lineage(mine.groupBy(F.col("entity").alias("_big")).agg(F.array_sort(F.array_distinct(quantiles)).alias("cuts")))


def _shard(t: Column, before: bool = False) -> Column:
    """Number of the shard that holds a point in time; with ``before``, that holds what lies just before it."""
    inside = (lambda c: c < t) if before else (lambda c: c <= t)
    return F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", inside)))


def merge_periods(intervals: DataFrame, entity: str, start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``entity, period_start, period_end`` in microseconds; an open end is ``OPEN``. Intervals are half open;
    touching ones merge. No interval comes of a null entity or start; a null end is open; empty and inverted intervals
    are ignored. Other columns are dropped before anything moves."""
    iv = intervals.select(F.col(entity).alias("entity"), _micros(F.col(start)).alias("s"), F.coalesce(_micros(F.col(end)), F.lit(OPEN)).alias("e"))
    # Of equal starts only the farthest end matters: a combine before the shuffle.
    iv = cut_lineage(iv.filter("entity is not null and s is not null and s < e").groupBy("entity", "s").agg(F.max("e").alias("e")))
    as_periods = lambda df: df.select("entity", F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    borders = _borders(iv, "s", shard_rows)
    if borders is None:
        return as_periods(_coalesce(iv, ["entity"]))
    held = iv.join(borders, F.col("entity") == F.col("_big"), "left").withColumn("a", _shard(F.col("s"))).withColumn("z", _shard(F.col("e"), before=True))
    # The cuts are ends of shards: shard n lies between cuts n - 1 and n, counted from 0.
    low, high = (lambda n: F.get("cuts", n - 1)), (lambda n: F.get("cuts", n))
    piece = lambda shard, s, e, span: F.struct(shard.alias("shard"), s.alias("s"), e.alias("e"), span.alias("to"))
    none = F.lit(None).cast("int")
    head = piece(F.col("a"), F.col("s"), F.when(F.col("a") == F.col("z"), F.col("e")).otherwise(high(F.col("a"))), none)
    tail = F.when(F.col("z") > F.col("a"), piece(F.col("z"), low(F.col("z")), F.col("e"), none))
    span = F.when(F.col("z") > F.col("a") + 1, piece(F.col("a") + 1, high(F.col("a")), low(F.col("z")), F.col("z") - 1))
    lies = F.when(F.col("p.to").isNull(), F.struct(low(F.col("p.shard")).alias("low"), high(F.col("p.shard")).alias("high"))).alias("b")
    parts = held.select("entity", "cuts", F.explode(F.array_compact(F.array(head, tail, span))).alias("p")).select("entity", "p.*", lies)
    parts = cut_lineage(parts.groupBy("entity", "shard", "s", "b").agg(F.max("e").alias("e"), F.max("to").alias("to")))
    spans = parts.filter("b is null")
    inner = _coalesce(parts.filter("b is not null").select("entity", "shard", "b", "s", "e"), ["entity", "shard", "b"])
    inner = cut_lineage(inner.withColumn("touches", F.coalesce(F.col("s") == F.col("b.low"), F.lit(False)) | F.coalesce(F.col("e") == F.col("b.high"), F.lit(False))))
    # Per entity no more rows than shards from here on. A piece that touches nothing may lie in a shard that is covered whole.
    whole = spans.select(F.col("entity").alias("_e"), F.explode(F.sequence("shard", "to")).alias("_s")).distinct()
    free = inner.filter("not touches").join(whole, (F.col("entity") == F.col("_e")) & (F.col("shard") == F.col("_s")), "left_anti").select("entity", "s", "e")
    stitched = _coalesce(inner.filter("touches").select("entity", "s", "e").unionByName(spans.select("entity", "s", "e")), ["entity"])
    return as_periods(free.unionByName(stitched))


def _coalesce(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching [s, e) within ``keys``."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_new", F.when(before.isNull() | (before < F.col("s")), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("_run")
    )


def period_gaps(periods: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``entity, gap_start, gap_end`` (microseconds) between neighbouring periods of ``merge_periods``, which is read
    several times if an entity has more than ``shard_rows`` of them. Neighbours are found within (entity, shard) first; the
    first period of a shard takes the last end from a summary with one row per shard, so no entity is one task."""
    p = periods.select("entity", "period_start", "period_end")
    borders = _borders(p, "period_start", shard_rows)
    if borders is None:
        before = F.lag("period_end").over(Window.partitionBy("entity").orderBy("period_start"))
        return p.select("entity", before.alias("gap_start"), F.col("period_start").alias("gap_end")).filter("gap_start is not null and gap_start < gap_end")
    p = p.join(borders, F.col("entity") == F.col("_big"), "left").withColumn("shard", _shard(F.col("period_start"))).drop("_big", "cuts")
    local = p.withColumn("_prev", F.lag("period_end").over(Window.partitionBy("entity", "shard").orderBy("period_start")))
    ends = (
        p.groupBy("entity", "shard").agg(F.max("period_end").alias("_end"))
        .withColumn("_before", F.lag("_end").over(Window.partitionBy("entity").orderBy("shard")))
        .select(F.col("entity").alias("_e"), F.col("shard").alias("_s"), "_before")
    )
    firsts = local.filter("_prev is null").join(ends, (F.col("entity") == F.col("_e")) & (F.col("shard") == F.col("_s"))).select("entity", F.col("_before").alias("gap_start"), F.col("period_start").alias("gap_end"))
    rest = local.filter("_prev is not null").select("entity", F.col("_prev").alias("gap_start"), F.col("period_start").alias("gap_end"))
    return firsts.unionByName(rest).filter("gap_start is not null and gap_start < gap_end")


def micros_text(col: str):
    """Text in UTC of microseconds; null for an open end."""
    c = F.col(col)
    return F.when(c < OPEN, utc_text(F.timestamp_micros(F.when(c < OPEN, c))))
