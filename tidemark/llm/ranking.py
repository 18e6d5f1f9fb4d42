"""One ranking from several differently scaled scores, by Borda count.

Ranks are counted on distinct values: rows are first tallied per (group, score, value), which combines before the
shuffle, and groups with more values than a task may order are cut into ranges of values whose offsets are summed up.
Places of all items are given along one sort by ranges of (group, points, item), so a group with a third of all rows is
ranked by many tasks even if all its items tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Distinct values of one group and score that one task may order.
BUCKET_ROWS = 100_000


def rank_values(values: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of rows ``keys, value`` one row per distinct value: ``n`` (rows with it), ``before`` (rows of the group with a
    greater value) and ``m`` (rows of the group). Values are doubles, not null."""
    tally = cut_lineage(values.groupBy(*keys, "value").agg(F.count("*").alias("n")))
    if tally.groupBy(*keys).count().filter(F.col("count") > bucket_rows).isEmpty():
        whole, higher = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
        return tally.select(*keys, "value", "n", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("m"))
    sizes = tally.groupBy(*keys).agg(F.sum("n").alias("m"), F.count("*").alias("distinct_values"))
    # Groups with more distinct values than a task may order: at most rows / bucket_rows of them.
    big = sizes.filter(F.col("distinct_values") > bucket_rows).select(*keys, "distinct_values")
    cut = F.percentile_approx("value", [i / 256 for i in range(1, 256)], 10_000)
    cuts = tally.join(big, keys).groupBy(*keys).agg(cut.alias("cuts"))
    placed = tally.join(sizes.drop("distinct_values"), keys).join(cuts, keys, "left")
    # Greater values come first, so ranges are numbered from above.
    placed = placed.withColumn("range", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c > F.col("value"))))).drop("cuts")
    inside = Window.partitionBy(*keys, "range").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "range").agg(F.sum("n").alias("in_range")).withColumn("offset", F.coalesce(F.sum("in_range").over(above), F.lit(0))).drop("in_range")
    return (
        placed.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*keys, "range"])
        .select(*keys, "value", "n", (F.col("local") + F.col("offset")).alias("before"), "m")
    )


def borda_ranking(hits: DataFrame, group: str, item: str, scores: dict[str, float], top: int | None = None) -> DataFrame:
    """``group, item, points, place``. ``scores`` maps a column to its weight; a negative weight says that smaller is
    better. Within a group each score gives its items points by competition rank, ties sharing the mean of their ranks,
    on a scale from 0 (worst) to 1 (best) whatever the number of items that have it; a missing score (null or NaN)
    gives the middle, 0.5. Points are the weighted mean; equal points (to 12 digits) are ordered by item.

    A repeated item counts once, with its best value of each score; rows without group or item are ignored; a group in
    which nobody has a score ranks by item. ``top`` keeps the first places of each group (a top-k report)."""
    oriented = [F.max(F.nanvl(F.col(c).cast("double"), F.lit(None)) * (1 if w > 0 else -1)).alias(f"s{i}") for i, (c, w) in enumerate(scores.items())]
    items = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), *scores).filter("g is not null and i is not null").groupBy("g", "i").agg(*oriented)
    weights = [abs(w) for w in scores.values()]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("value")) for k in range(len(weights))])
    long = items.select("g", "i", F.explode(each).alias("s")).select("g", "i", "s.kind", "s.value")
    ranks = rank_values(long.filter("value is not null").select("g", "kind", "value"), ["g", "kind"])
    scale = (F.col("m") - F.col("before") - F.col("n") / 2) / F.col("m")
    weight = F.element_at(F.array(*[F.lit(float(w) / sum(weights)) for w in weights]), F.col("kind") + 1)
    points = (
        long.join(ranks, ["g", "kind", "value"], "left")
        .groupBy("g", "i")
        .agg(F.round(F.sum(F.coalesce(scale, F.lit(0.5)) * weight), 12).alias("points"))
    )
    order = [F.col("points").desc(), F.col("i")]
    if top is not None:
        placed = points.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("place") <= top)
    else:
        placed = _places(points, order)
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), "points", "place")


def _places(points: DataFrame, order: list) -> DataFrame:
    """``points(g, i, points)`` with ``place``: rows are sorted by ranges of group, points and item, counted in each range,
    and the ranges' counts of a group are summed up. Ties are cut by item, so no range is longer for them."""
    ranged = cut_lineage(points.repartitionByRange("g", *order).withColumn("range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("g", "range").orderBy(*order))
    above = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("g", "range").agg(F.count("*").alias("n")).select("g", "range", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))
    return ranged.withColumn("inside", inside).join(offsets, ["g", "range"]).select("g", "i", "points", (F.col("inside") + F.col("offset")).cast("int").alias("place"))
