"""The tools of the service as functions: each takes DataFrames or a vault's folder and returns one or the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vault
from tidemark.functions.predicates import LANGUAGES, in_wiki, prefers_text_search, recallable
from tidemark.functions.timestamps import parse_instant
from tidemark.operators import packs, retrieval
from tidemark.operators.notes import live_notes

DEFAULT_LIMIT, MOST = 10, 100
PROJECTS = 8


def bounded(limit: int | None) -> int:
    return min(limit or DEFAULT_LIMIT, MOST)


def search(notes: DataFrame, queries: DataFrame, now: str, limit: int | None = None, least_confidence: float | None = None) -> DataFrame:
    """``query_id, chunk_id, place, mode`` over note chunks (chunk_id, text, vector and the recall columns) for queries
    (query_id, text, vector): what the gate shows, by words if the query looks like keywords and words hit, else by
    words and vectors fused."""
    k = bounded(limit)
    gate = recallable(*[F.col(c) for c in ("status", "pinned", "valid_from", "valid_until", "confidence")], now, least_confidence)
    shown = notes.filter(gate)
    words = retrieval.bm25(queries, shown, k, "query_id", "text", "chunk_id", "text").select("query_id", "chunk_id", "rank")
    near = retrieval.exact_neighbours(queries, shown, k, "query_id", "chunk_id", "vector").select("query_id", "chunk_id", "rank")
    hit = words.select("query_id").distinct().withColumn("hit", F.lit(True))
    by_words = queries.join(hit, "query_id", "left").select("query_id", (prefers_text_search(F.col("text")) & F.col("hit").isNotNull()).alias("fts"))
    fused = retrieval.reciprocal_rank_fusion(words.unionByName(near), ["query_id"], ["chunk_id"], "rank", k)
    first = words.join(by_words.filter("fts"), "query_id").select("query_id", "chunk_id", F.col("rank").alias("place"), F.lit("fts_prefer").alias("mode"))
    return first.unionByName(fused.join(by_words.filter("not fts"), "query_id").select("query_id", "chunk_id", "place", F.lit("hybrid").alias("mode")))


def code_search(segments: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    return retrieval.exact_neighbours(queries, segments, bounded(limit), "query_id", "segment_id", "vector")


def federated(lists: DataFrame, projects: list[str], limit: int | None = None) -> DataFrame:
    """Lists of several projects (project, query_id, item, rank) fused; of one project taken as they are."""
    keys = list(dict.fromkeys(projects))
    if not 1 <= len(keys) <= PROJECTS:
        raise ValueError(f"1 to {PROJECTS} projects")
    part = lists.filter(F.col("project").isin(*keys) & (F.col("rank") <= bounded(limit)))
    if len(keys) == 1:
        return part.select("query_id", "project", "item", F.col("rank").alias("place"))
    return retrieval.reciprocal_rank_fusion(part, ["query_id"], ["project", "item"], "rank", bounded(limit)).select("query_id", "project", "item", "place")


def check_cross_project(opted: dict[str, bool], corpus: str) -> None:
    """PermissionError if several projects are searched for notes and one of them didn't opt in."""
    if len(opted) > 1 and corpus in ("vault", "all") and not all(opted.values()):
        raise PermissionError("cross-project search needs every project's consent")


def read(chunks: DataFrame, path: str) -> str:
    """Text of an indexed note, its chunks joined by blank lines; empty for an unknown path."""
    rows = chunks.filter(F.col("path") == path).orderBy("chunk_index").select("text").collect()
    return "\n\n".join(r["text"] for r in rows)


def write(root: str, path: str, content: str, mode: str, project: str, now: str, **given) -> dict:
    return vault.write_note(root, path, content, mode, project, now, **given)


def wiki_pack(root: str, scope: str, sections: dict[str, list[packs.PackItem]]) -> str:
    return packs.write_pack(root, scope, {n: packs.allocate(items) for n, items in sections.items()})


def projects(registry: DataFrame) -> DataFrame:
    return registry.select("key").distinct().orderBy("key")


def overview(notes: DataFrame, recent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by top folder and status, and the newest notes (1 to 50)."""
    folder = F.when(F.col("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("(root)")
    counts = notes.groupBy(folder.alias("folder"), F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active")).alias("status")).count()
    return counts, notes.orderBy(F.col("created_at").desc_nulls_last(), "path").limit(max(1, min(50, recent)))


def checkpoint_save(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """Checkpoints (name, id, created_at, updated_at, title, body) after saves: a known one keeps its id and time of
    creation, and fields the save omits."""
    old = stored.select("name", *[F.col(c).alias(f"_{c}") for c in ("id", "created_at", "updated_at", "title", "body")])
    both = saved.join(old, "name", "full")
    keep = lambda c, first: F.coalesce(f"_{c}", c) if first else F.coalesce(c, f"_{c}")
    return both.select("name", *[keep(c, c in ("id", "created_at")).alias(c) for c in ("id", "created_at", "updated_at", "title", "body")])


def checkpoint_done(stored: DataFrame, name: str, now: str) -> DataFrame:
    hit = F.col("name") == name
    return stored.withColumn("status", F.when(hit, "done").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))


def checkpoint_load(stored: DataFrame, notes: DataFrame, name: str) -> DataFrame:
    """The notes a checkpoint links, in order, with whether they exist, their title and 400 characters of their text."""
    links = stored.filter(F.col("name") == name).select(F.posexplode("links").alias("pos", "path"))
    known = notes.select("path", "title", F.substring(F.trim("text"), 1, 400).alias("preview"), F.lit(True).alias("_there"))
    return links.join(known, "path", "left").select("pos", "path", F.col("_there").isNotNull().alias("found"), "title", "preview").orderBy("pos")


def checkpoint_query(stored: DataFrame, status: str | None = "active") -> DataFrame:
    rows = stored if status in (None, "all") else stored.filter(F.coalesce("status", F.lit("active")) == status)
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), "name")


def system_instructions() -> str:
    return "Search before you write; write decisions as notes with a status; save a checkpoint before the context ends."


def session_hook(event: str, stored: DataFrame, notes: DataFrame) -> DataFrame | tuple[DataFrame, DataFrame]:
    """What a session's hook shows: at its start the overview, before compaction and at its end the open checkpoints."""
    if event == "session_start":
        return overview(notes)
    if event in ("pre_compact", "session_stop"):
        return checkpoint_query(stored)
    raise ValueError(f"unknown event {event}")


def newest_per_project(notes: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.col("created_at").desc_nulls_last(), "path"))
    return notes.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def merge_settings(stored: DataFrame, flags: DataFrame) -> DataFrame:
    """Settings (key, include, code_indexing, languages) after flags of the same columns: only given fields change.
    ``error`` names what is wrong with a project's flags, which then change nothing: an unknown language or an empty
    glob."""
    asked = flags.select("key", *[F.col(c).alias(f"_{c}") for c in ("include", "code_indexing", "languages")])
    unknown = F.exists("_languages", lambda x: ~F.lower(F.trim(x)).isin("auto", *LANGUAGES))
    error = F.when(unknown, "unknown language").when(F.exists("_include", lambda g: F.trim(g) == ""), "empty glob")
    both = stored.join(asked, "key", "left").withColumn("error", error)
    keep = lambda c: F.when(F.col("error").isNull(), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
    return both.select("key", *[keep(c) for c in ("include", "code_indexing", "languages")], "error")


def migration_plan(notes: DataFrame, target: DataFrame) -> DataFrame:
    """``step, id, subject, warning`` of moving the notes (id, path, project, links) of all other projects into the one
    named by ``target(new)``, a single row. move: a note's new path, and whether another note has or gets it too; stamp:
    the project it gets, and whether its path was another's; link: a link to a moved note, to be written anew, or of a moved
    note to none."""
    named = notes.join(F.broadcast(target))  # one row
    moved = named.filter("project <> new and path like '%/%'").withColumn("to", F.concat("new", F.regexp_extract("path", "^[^/]*(.*)$", 1)))
    meets = moved.groupBy("to").agg(F.count("*").alias("n"))
    stays = notes.filter("path is not null").join(moved.select("id"), "id", "left_anti").select(F.col("path").alias("to"), F.lit(True).alias("taken")).distinct()
    clash = F.when((F.col("n") > 1) | F.col("taken").isNotNull(), "collision")
    step = lambda name, df, subject, warning: df.select(F.lit(name).alias("step"), "id", F.col(subject).alias("subject"), warning.alias("warning"))
    moves = step("move", moved.join(meets, "to").join(stays, "to", "left"), "to", clash)
    stamps = step("stamp", moved, "new", F.when(F.split_part("path", F.lit("/"), F.lit(1)) != F.col("project"), "path of another project"))
    links = notes.select("id", F.explode("links").alias("link")).filter("link is not null").distinct()
    repaired = step("link", links.join(moved.select(F.col("path").alias("link")).distinct(), "link", "left_semi"), "link", F.lit(None).cast("string"))
    known = notes.filter("path is not null").select(F.col("path").alias("link"))
    missing = step("link", links.join(moved.select("id"), "id", "left_semi").join(known, "link", "left_anti"), "link", F.lit("missing"))
    return moves.unionByName(stamps).unionByName(repaired).unionByName(missing)


def doctor(rows: DataFrame, registered: DataFrame, changes: DataFrame) -> DataFrame:
    """``check, n``: numbers of issues of the synced notes (``rows``), given the projects ``registered(project)`` and the
    observed ``changes`` (path, modified_at, change_id, content_hash) of the files."""
    n = live_notes(rows, ["path", "links", "supersedes", "valid_from", "valid_until", "project"])
    paths = n.filter("path is not null").select("path").distinct()
    links = n.select("id", F.explode("links").alias("path")).filter("path is not null").distinct()
    several = lambda df, by, what: df.filter(f"{by} is not null and {what} is not null").groupBy(by).agg(F.countDistinct(what).alias("k")).filter("k > 1")
    unread = lambda c: F.col(c).isNotNull() & parse_instant(c).isNull()
    files = changes.groupBy("path").agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s")).select("path", F.col("s.modified_at").alias("m"), F.col("s.content_hash").isNotNull().alias("there"))
    indexed = rows.filter("path is not null").groupBy("path").agg(F.max("synced_at").alias("synced"))
    fresh = files.filter("there").join(indexed, "path", "left")
    named = n.filter("supersedes is not null").filter(~F.col("supersedes").startswith("path:"))
    checks = {
        "missing_id": rows.filter("id is null"), "duplicate_id": several(rows, "id", "path"), "shared_path": several(n, "path", "id"),
        "bad_path": n.filter(F.col("path").isNull() | ~F.col("path").endswith(".md")), "broken_links": links.join(paths, "path", "left_anti"),
        "broken_supersedes": named.join(n.select(F.col("id").alias("_k")), F.col("supersedes") == F.col("_k"), "left_anti"),
        "bad_dates": n.filter(unread("valid_from") | unread("valid_until")), "wiki_leakage": n.filter(in_wiki(F.col("path"))), "no_project": n.filter("project is null"),
        "unregistered_project": n.filter("project is not null").select("project").distinct().join(registered, "project", "left_anti"),
        "not_indexed": fresh.filter("synced is null"), "outdated_index": fresh.filter("synced < m"), "index_of_deleted": paths.join(files.filter("not there"), "path", "left_semi"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counts)
