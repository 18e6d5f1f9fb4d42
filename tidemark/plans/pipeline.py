"""Queries of the general training-data problems (2, 4, 5 and 6) over the domain's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import parse_instant, utc_month
from tidemark.operators.hierarchy import descendants, resolve_hierarchy, resolve_parents
from tidemark.operators.incremental import MerkleStore, replay_jobs
from tidemark.operators.intervals import merge_periods, micros_text, period_gaps
from tidemark.operators.notes import link_id, live_nodes, live_notes
from tidemark.operators.orphans import orphan_records, orphan_report, parents, references
from tidemark.session import cut_lineage, ensure_checkpoint_dir, read_table

EXTERNAL_LINK = "external:vault-link:"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    live = live_notes(read_table(spark, sf, "vault_notes"), ["supersedes", "superseded_by"])
    return cut_lineage(resolve_parents(live, "id", "supersedes", "superseded_by", link_id))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    tree = resolve_hierarchy(links)
    named = links.filter("parent is not null").select(F.col("parent").alias("_p")).distinct()
    return tree.join(named, F.col("id") == F.col("_p"), "left").filter("parent is not null or _p is not null").select("id", "root_id", "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree = resolve_hierarchy(_links(spark, sf), with_path=True)
    return tree.select("id", "root_id", "depth", F.array_join("path", ">").alias("path"), "on_cycle")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(resolve_hierarchy(_links(spark, sf), with_path=True))


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    live = cut_lineage(live_notes(read_table(spark, sf, "vault_notes")))
    links = cut_lineage(resolve_parents(live, "id", "supersedes", "superseded_by", link_id))
    roots = resolve_hierarchy(links).select("id", "root_id")
    held = live.select("id", parse_instant("valid_from").alias("s"), parse_instant("valid_until").alias("e")).filter("s is not null")
    return merge_periods(held.join(roots, "id"), "root_id", "s", "e")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    gaps = period_gaps(cut_lineage(_periods(spark, sf)))
    return gaps.select(F.col("entity").alias("root_id"), micros_text("gap_start").alias("gap_from"), micros_text("gap_end").alias("gap_to"))


def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _periods(spark, sf).select(F.col("entity").alias("root_id"), micros_text("period_start").alias("period_from"), micros_text("period_end").alias("period_to"))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges, links = read_table(spark, sf, "graph_edges"), read_table(spark, sf, "linked_notes")
    ends = edges.select(
        "edge_key", utc_month(parse_instant("created_at")).alias("month"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in ("source_key", "target_key")])).alias("end"),
    ).select("edge_key", "month", "end.*")
    external = F.col("key").startswith(EXTERNAL_LINK)
    children = ends.select(
        F.lit("graph_edges").alias("ref_table"), F.col("edge_key").alias("record_key"), F.col("field").alias("ref_field"),
        F.when(external, F.lit("vault_notes")).otherwise(F.lit("graph_nodes")).alias("parent_table"),
        F.when(external, F.substring("key", len(EXTERNAL_LINK) + 1, 2**30)).otherwise(F.col("key")).alias("ref_key"),
        F.col("month").alias("period"),
    ).filter("ref_key is not null")
    path = F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")
    children = children.unionByName(
        references(links, "linked_notes", F.col("link_id"), "path", F.lit("vault_notes"), path, F.date_format("loaded_at", "yyyy-MM"))
    )
    tops = parents(live_nodes(read_table(spark, sf, "graph_nodes")), "graph_nodes", "node_key").unionByName(
        parents(live_notes(read_table(spark, sf, "vault_notes"), ["path"]), "vault_notes", "path")
    )
    return children, tops


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    children, tops = _references(spark, sf)
    return orphan_records(children, tops).withColumnRenamed("period", "created_month")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    children, tops = _references(spark, sf)
    return orphan_report(children.distinct(), tops).withColumnRenamed("period", "created_month")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay_jobs(read_table(spark, sf, "file_changes"), read_table(spark, sf, "index_jobs"))


def p6_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store's second run over the states of all paths, the first having seen what arrived in the first half of time."""
    seen = read_table(spark, sf, "file_changes").filter("path is not null and arrived_at is not null").withColumn("at", F.unix_micros(F.col("arrived_at").cast("timestamp")))
    key = F.concat_ws("\t", "project", "corpus", "path")
    half = seen.agg(F.expr("(min(at) + max(at)) div 2").alias("half"))

    def state(rows: DataFrame) -> DataFrame:
        held = rows.groupBy(key.alias("key")).agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s"))
        return held.select("key", F.col("s.content_hash").alias("digest")).filter("digest is not null")

    store = MerkleStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.run(state(seen.join(F.broadcast(half), F.col("at") <= F.col("half"))), "first")  # one row
    return store.run(state(seen), "second")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p4_found, p4_periods, p5_found, p5_report, p6_found, p6_store)}

_LIVE = """
held AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC, row_no DESC) rn FROM vault_notes WHERE id IS NOT NULL),
live AS (SELECT *, regexp_replace(regexp_replace(lower(trim(supersedes, E' \\t\\n\\r')), '^vault:', ''), '^\\s+', '') up,
  regexp_replace(regexp_replace(lower(trim(superseded_by, E' \\t\\n\\r')), '^vault:', ''), '^\\s+', '') dn FROM held WHERE rn = 1 AND NOT is_deleted)"""
_TREE = (
    _LIVE
    + """,
below AS (SELECT dn, min(id) bid FROM live GROUP BY dn),
par AS (SELECT l.id, coalesce(a.id, b.bid) parent FROM live l LEFT JOIN live a ON a.id = l.up LEFT JOIN below b ON b.dn = l.id),
walk AS (SELECT id, id root_id, 0 depth, id path FROM par WHERE parent IS NULL
  UNION ALL SELECT p.id, w.root_id, w.depth + 1, w.path || '>' || p.id FROM par p JOIN walk w ON p.parent = w.id),
lost AS (SELECT p.* FROM par p LEFT JOIN walk w ON w.id = p.id WHERE w.id IS NULL),
orbit AS (SELECT id, parent here, 1 steps FROM lost UNION SELECT o.id, p.parent, steps + 1 FROM orbit o JOIN lost p ON p.id = o.here WHERE steps < 200),
ring AS (SELECT DISTINCT id FROM orbit WHERE id = here),
ringed AS (SELECT o.id, min(o.here) root_id FROM orbit o JOIN ring r ON r.id = o.here GROUP BY o.id),
tree AS (SELECT id, root_id, depth, path, false on_cycle FROM walk
  UNION ALL SELECT g.id, g.root_id, -1, NULL, r.id IS NOT NULL FROM ringed g LEFT JOIN ring r ON r.id = g.id)"""
)


def _dt(c: str) -> str:
    return f"""CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} || 'T00:00:00+00:00' AS timestamptz)
 WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN try_cast({c} AS timestamptz) END"""


_PERIODS = (
    _TREE
    + f""",
iv AS (SELECT t.root_id, epoch_us({_dt('valid_from')}) s, coalesce(epoch_us({_dt('valid_until')}), 4611686018427387904) e FROM live JOIN tree t USING (id)),
good AS (SELECT * FROM iv WHERE s IS NOT NULL AND s < e),
mark AS (SELECT *, max(e) OVER (PARTITION BY root_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM good),
run AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY root_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM mark),
per AS (SELECT root_id, min(s) s, max(e) e FROM run GROUP BY root_id, g)"""
)


def _txt(c: str) -> str:
    return f"strftime(make_timestamp(CASE WHEN {c} < 4611686018427387904 THEN {c} END), '%Y-%m-%dT%H:%M:%SZ')"


_REFS = (
    _LIVE
    + f""",
nodes AS (SELECT node_key FROM (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY {_dt('updated_at')} DESC NULLS LAST, row_no DESC) rn FROM graph_nodes) WHERE rn = 1 AND NOT is_deleted),
edge AS (SELECT DISTINCT edge_key, source_key, target_key, strftime(make_timestamp(epoch_us({_dt('created_at')})), '%Y-%m') m FROM graph_edges),
ends AS (SELECT edge_key, 'source_key' f, source_key k, m FROM edge UNION ALL SELECT edge_key, 'target_key', target_key, m FROM edge),
links AS (SELECT DISTINCT link_id, regexp_replace(replace(path, '\\', '/'), '^\\./', '') p, strftime(loaded_at, '%Y-%m') m FROM linked_notes),
orphans AS (
 SELECT 'graph_edges' ref_table, edge_key record_key, f ref_field, m created_month, k FROM ends
  WHERE k IS NOT NULL AND NOT starts_with(k, '{EXTERNAL_LINK}') AND k NOT IN (SELECT node_key FROM nodes)
 UNION ALL SELECT 'graph_edges', edge_key, f, m, substr(k, {len(EXTERNAL_LINK) + 1}) FROM ends
  WHERE starts_with(k, '{EXTERNAL_LINK}') AND substr(k, {len(EXTERNAL_LINK) + 1}) NOT IN (SELECT path FROM live WHERE path IS NOT NULL)
 UNION ALL SELECT 'linked_notes', link_id::varchar, 'path', m, p FROM links WHERE p IS NOT NULL AND p NOT IN (SELECT path FROM live WHERE path IS NOT NULL))"""
)

SQL = {
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT id, root_id, depth FROM tree WHERE id IN (SELECT id FROM par WHERE parent IS NOT NULL) OR id IN (SELECT parent FROM par WHERE parent IS NOT NULL)",
    "p2_paths": f"WITH RECURSIVE {_TREE} SELECT id, root_id, depth, path, on_cycle FROM tree",
    "p2_descendants": f"""WITH RECURSIVE {_TREE}, up AS (SELECT id descendant, parent ancestor, 1 distance, [id, parent] seen FROM par WHERE parent IS NOT NULL AND parent <> id
  UNION ALL SELECT u.descendant, p.parent, u.distance + 1, list_append(u.seen, p.parent) FROM up u JOIN par p ON p.id = u.ancestor WHERE p.parent IS NOT NULL AND NOT list_contains(u.seen, p.parent)) SELECT ancestor, descendant, distance FROM up""",
    "p4_found": f"WITH RECURSIVE {_PERIODS}, g AS (SELECT root_id, lag(e) OVER (PARTITION BY root_id ORDER BY s) a, s b FROM per) SELECT root_id, {_txt('a')} gap_from, {_txt('b')} gap_to FROM g WHERE a < b",
    "p4_periods": f"WITH RECURSIVE {_PERIODS} SELECT root_id, {_txt('s')} period_from, {_txt('e')} period_to FROM per",
    "p5_found": f"WITH {_REFS} SELECT DISTINCT ref_table, record_key, ref_field, created_month FROM orphans",
    "p5_report": f"WITH {_REFS} SELECT ref_table, ref_field, created_month, count(*) orphans, count(DISTINCT k) missing_keys FROM (SELECT DISTINCT * FROM orphans) GROUP BY ALL",
    "p6_found": """WITH done AS (SELECT DISTINCT job_id, project, corpus, started_at FROM index_jobs WHERE status = 'succeeded' AND started_at IS NOT NULL),
job AS (SELECT *, lag(job_id) OVER (PARTITION BY project, corpus ORDER BY started_at, job_id) prev FROM done),
state AS (SELECT j.job_id, c.path, arg_max(coalesce(c.content_hash, ''), (c.modified_at, c.change_id)) h
  FROM job j JOIN file_changes c ON c.project = j.project AND c.corpus = j.corpus AND c.arrived_at <= j.started_at GROUP BY ALL)
SELECT s.job_id, s.path FROM state s JOIN job j USING (job_id) LEFT JOIN state p ON p.job_id = j.prev AND p.path = s.path WHERE s.h <> '' AND s.h <> coalesce(p.h, '')""",
    "p6_store": """WITH f AS (SELECT *, concat_ws(chr(9), project, corpus, path) AS key FROM file_changes WHERE path IS NOT NULL AND arrived_at IS NOT NULL),
s AS (SELECT key, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) digest FROM f GROUP BY key),
w AS (SELECT key, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) was FROM f WHERE epoch_us(arrived_at) <= (SELECT (min(epoch_us(arrived_at)) + max(epoch_us(arrived_at))) // 2 FROM f) GROUP BY key)
SELECT key, nullif(digest, '') digest, nullif(was, '') was FROM s FULL JOIN w USING (key) WHERE coalesce(digest, '') <> coalesce(was, '')""",
}
