"""The state that holds: last row per note and per graph node, and what is live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normal_path
from tidemark.functions.timestamps import parse_instant


def link_id(col: Column | str) -> Column:
    """An id as links are compared: trimmed, in lower case, without a leading ``vault:``; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), r"^vault:\s*", "")
    return F.when(bare != "", bare)


def holding_rows(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``order``; ties between equal orders fall to the
    greatest remaining columns, so the result doesn't depend on the row order. Aggregates before it shuffles, so a
    key with a third of all rows costs no more than any other."""
    picked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.max(picked).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    )


def live_notes(notes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Notes whose holding row (greatest synced_at, then row_no) is not deleted. Rows without id are no notes; a null
    is_deleted means not deleted."""
    columns = columns or ["path", "supersedes", "superseded_by", "valid_from", "valid_until"]
    wanted = [*columns, "is_deleted"] if "is_deleted" not in columns else columns
    held = holding_rows(notes, "id", [F.col("synced_at"), F.col("row_no")], wanted)
    return held.filter(~F.coalesce(F.col("is_deleted"), F.lit(False))).select("id", *columns)


def live_nodes(nodes: DataFrame) -> DataFrame:
    """Keys of graph nodes whose row with the latest updated_at (an instant), then row_no, is not deleted. Rows whose
    updated_at can't be read come before all others."""
    held = holding_rows(nodes, "node_key", [parse_instant("updated_at"), F.col("row_no")], ["is_deleted"])
    return held.filter(~F.coalesce(F.col("is_deleted"), F.lit(False))).select("node_key")


def linked_contents(notes: DataFrame, files: DataFrame) -> DataFrame:
    """``note, content, linked``: texts of notes (note, root, link, content), that of the file (path, content) the link
    names if it lies in the note's root folder, else their own. Absolute links and such that leave the root are none."""
    target = normal_path(F.col("link"))
    inside = F.when(target.startswith(F.concat("root", F.lit("/"))), target)
    found = files.filter("path is not null and content is not null").groupBy(F.col("path").alias("_p")).agg(F.min("content").alias("_content"))
    met = notes.withColumn("_t", inside).join(found, F.col("_t") == F.col("_p"), "left")
    return met.select("note", F.coalesce("_content", "content").alias("content"), F.col("_p").isNotNull().alias("linked"))
