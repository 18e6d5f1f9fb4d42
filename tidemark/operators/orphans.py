"""References to records that don't exist, per record and summed per table and period.

Parent and child keys are tagged and put in one long form, grouped by (parent table, key), and groups without a parent
flag are orphans. The group-by combines before it shuffles, so a key with a third of all references costs one row per
task. Records of orphan keys come back by a semi-join whose right side is unique (AQE splits a skewed left side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def references(df: DataFrame, table: str, record_key: Column, field: str, parent_table: Column, key: Column, period: Column) -> DataFrame:
    """Tagged child rows. A null key is no reference and is left out."""
    return df.select(
        F.lit(table).alias("ref_table"), record_key.cast("string").alias("record_key"), F.lit(field).alias("ref_field"),
        parent_table.alias("parent_table"), key.alias("ref_key"), period.alias("period"),
    ).filter("ref_key is not null")


def parents(df: DataFrame, table: str, key: str) -> DataFrame:
    return df.select(F.lit(table).alias("parent_table"), F.col(key).alias("ref_key")).filter("ref_key is not null")


def orphan_counts(children: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """``parent_table, ref_key, ref_table, ref_field, period, n``: how often each missing key is referred to. One
    group-by of the union; the sums by period come from a second, much smaller one."""
    kid = children.select("parent_table", "ref_key", F.struct("ref_table", "ref_field", "period").alias("of"), F.lit(0).alias("is_parent"))
    top = parent_rows.select("parent_table", "ref_key", F.lit(None).cast(kid.schema["of"].dataType).alias("of"), F.lit(1).alias("is_parent"))
    # Combine to one row per key and period first: the window below then never sees a hot key's rows.
    tally = kid.unionByName(top).groupBy("parent_table", "ref_key", "of").agg(F.max("is_parent").alias("is_parent"), F.count("*").alias("n"))
    flagged = tally.groupBy("parent_table", "ref_key").agg(F.max("is_parent").alias("is_parent"), F.collect_list(F.when(F.col("is_parent") == 0, F.struct("of", "n"))).alias("by"))
    return flagged.filter("is_parent = 0").select("parent_table", "ref_key", F.explode("by").alias("b")).select("parent_table", "ref_key", "b.of.*", "b.n")


def orphan_records(children: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Distinct ``ref_table, record_key, ref_field, period`` whose key no parent has. Repeated rows of a record count
    once; empty inputs give an empty result."""
    kids = children.select("parent_table", "ref_key").withColumn("is_parent", F.lit(0))
    tops = parent_rows.select("parent_table", "ref_key").withColumn("is_parent", F.lit(1))
    missing = (
        kids.unionByName(tops).groupBy("parent_table", "ref_key").agg(F.max("is_parent").alias("_p")).filter("_p = 0")
        .select(F.col("parent_table").alias("_pt"), F.col("ref_key").alias("_rk"))
    )
    return (
        children.join(missing, (F.col("parent_table") == F.col("_pt")) & (F.col("ref_key") == F.col("_rk")), "left_semi")
        .select("ref_table", "record_key", "ref_field", "period").distinct()
    )


def orphan_report(children: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """``ref_table, ref_field, period, orphans, missing_keys``; the period is null where a record has no readable time."""
    return orphan_counts(children, parent_rows).groupBy("ref_table", "ref_field", "period").agg(
        F.sum("n").alias("orphans"), F.count("*").alias("missing_keys")
    )
