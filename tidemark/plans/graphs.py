"""Queries of the property graph, the joins, the sinks and the deduplications."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import folder_chain, json_ok
from tidemark.functions.timestamps import parse_instant
from tidemark.operators import tables as T
from tidemark.operators.retrieval import exact_neighbours, semantic_graph
from tidemark.session import ensure_checkpoint_dir, read_table

QUERIES, SQL = {}, {}
C = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def edges(spark, sf):
    """Edges as stored: the last row of a key wins."""
    return T.last_per_key(read_table(spark, sf, "graph_edges"), "edge_key", ["row_no"])


def nodes(spark, sf):
    return T.last_per_key(read_table(spark, sf, "graph_nodes"), "node_key", ["row_no"])


def overrides(spark, sf):
    """What users would set: unresolved derived edges suppressed, their own restored, with as many revisions as arrivals."""
    e = T.last_per_key(read_table(spark, sf, "graph_edges").select("edge_key", "row_no", "origin", "resolution"), "edge_key", ["row_no"])
    n = read_table(spark, sf, "graph_edges").groupBy("edge_key").agg(F.count("*").alias("revision"))
    action = F.when(C("origin") == "user", "restore").when(C("resolution") == "unresolved", "suppress")
    return e.join(n, "edge_key").select("edge_key", action.alias("action"), "revision").filter("action is not null")


_E = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_key ORDER BY row_no DESC) rn FROM graph_edges) WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY row_no DESC) rn FROM graph_nodes) WHERE rn = 1),
o AS (SELECT edge_key, CASE WHEN origin = 'user' THEN 'restore' WHEN resolution = 'unresolved' THEN 'suppress' END action, revision FROM e JOIN (SELECT edge_key, count(*) revision FROM graph_edges GROUP BY edge_key) USING (edge_key) WHERE origin = 'user' OR resolution = 'unresolved')"""
GONE = "array_contains(split(path, '/'), 'services')"
_GONE = "list_contains(string_split(path, '/'), 'services')"


def _table(spark, key=None, parts=16):
    """A table of its own in the shared folder."""
    return T.SnapshotTable(spark, f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}", key, parts)


@query("snk01_append", "SELECT edge_key, row_no FROM graph_edges")
def snk01(spark, sf):
    """Edges of each origin appended to a table, one batch after the other."""
    e, t = read_table(spark, sf, "graph_edges").select("edge_key", "row_no", "origin"), _table(spark, "edge_key")
    user = F.coalesce(C("origin") == "user", F.lit(False))
    t.append(e.filter(user).drop("origin"))
    t.append(e.filter(~user).drop("origin"))
    return t.read()


@query("snk02_upsert", f"WITH {_E} SELECT node_key, row_no, label FROM n")
def snk02(spark, sf):
    """Nodes after the second half of the arrivals is upserted into the first."""
    t = read_table(spark, sf, "graph_nodes").select("node_key", "row_no", "label")
    half = t.agg(F.expr("max(row_no) div 2").alias("half"))
    parted = t.join(F.broadcast(half))  # one row
    old = T.last_per_key(parted.filter("row_no <= half").drop("half"), "node_key", ["row_no"])
    return T.upsert(old, T.last_per_key(parted.filter("row_no > half").drop("half"), "node_key", ["row_no"]), "node_key")


@query("snk03_compare_and_set", f"""WITH {_E}, r AS (SELECT edge_key, 'restore' asked, 1 expected FROM e JOIN (SELECT edge_key, count(*) n FROM graph_edges GROUP BY edge_key) USING (edge_key) WHERE origin = 'user' OR n > 1) SELECT edge_key, CASE WHEN coalesce(revision, 0) = expected THEN asked ELSE action END action,
 CASE WHEN coalesce(revision, 0) = expected THEN expected + 1 ELSE revision END revision, coalesce(asked IS NOT NULL AND coalesce(revision, 0) <> expected, false) conflict FROM r FULL JOIN o USING (edge_key)""")
def snk03(spark, sf):
    """Users restore their own edges, and those that arrived again, expecting the first revision."""
    n = read_table(spark, sf, "graph_edges").groupBy("edge_key").agg(F.count("*").alias("n"))
    asked = edges(spark, sf).join(n, "edge_key").filter("origin = 'user' or n > 1").select("edge_key", F.lit("restore").alias("action"), F.lit(1).cast("long").alias("expected"))
    return T.compare_and_set(overrides(spark, sf), asked)


@query("snk04_delete_paths", f"SELECT DISTINCT id FROM code_chunks WHERE NOT {_GONE.replace('path', 'file_path')}")
def snk04(spark, sf):
    c = read_table(spark, sf, "code_chunks").select("id", "file_path")
    gone = c.filter(GONE.replace("path", "file_path")).select("file_path").distinct()
    return T.delete_keys(c, gone, "file_path").select("id").distinct()


@query("snk05_delete_nodes", f"""WITH {_E}, g AS (SELECT node_key FROM n WHERE path IS NOT NULL AND {_GONE}), k AS (SELECT * FROM e WHERE source_key NOT IN (SELECT node_key FROM g) AND target_key NOT IN (SELECT node_key FROM g))
SELECT 'node' kind, node_key AS key FROM n WHERE node_key NOT IN (SELECT node_key FROM g) UNION ALL SELECT 'edge', edge_key FROM k UNION ALL SELECT 'override', edge_key FROM o WHERE edge_key IN (SELECT edge_key FROM k)""")
def snk05(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    gone = n.filter(GONE).select("node_key")
    a, b, c = T.delete_nodes(n, e, overrides(spark, sf), gone)
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), C(key).alias("key"))
    return named(a, "node", "node_key").unionByName(named(b, "edge", "edge_key")).unionByName(named(c, "override", "edge_key"))


@query("snk06_prune", f"WITH {_E} SELECT edge_key FROM e WHERE NOT coalesce(origin = 'derived' AND extractor = 'semantic-v1' AND generation < 30, false)")
def snk06(spark, sf):
    return T.prune(edges(spark, sf), "semantic-v1", 30).select("edge_key")


@query("snk07_recreate", "SELECT DISTINCT id FROM code_chunks")
def snk07(spark, sf):
    """A full index run: a table that held the notes' ids is dropped and written anew with those of the segments."""
    t = _table(spark, "id")
    t.replace(read_table(spark, sf, "vault_notes").select("id"))
    t.replace(read_table(spark, sf, "code_chunks").select("id").distinct())
    return t.read()


@query("snk02_table_upsert", f"WITH {_E} SELECT node_key, row_no, label FROM n")
def snk02_table(spark, sf):
    """The same through a table: nodes of the vault first, then all others, then all newest rows once more."""
    n, t = nodes(spark, sf).select("node_key", "row_no", "label", "corpus"), _table(spark, "node_key")
    t.append(n.filter("corpus = 'vault'").withColumn("label", F.lit("stale")).drop("corpus"))
    t.upsert(n.drop("corpus"), "node_key")
    return t.read()


@query("snk09_export_index", """SELECT path, coalesce(max(alias), regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) title FROM vault_notes WHERE path IS NOT NULL GROUP BY path""")
def snk09(spark, sf):
    n = read_table(spark, sf, "vault_notes").filter("path is not null")
    return n.groupBy("path").agg(F.coalesce(F.max("alias"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("title"))


@query("snk13_unused_folders", "SELECT DISTINCT sha256(project) folder FROM file_changes WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM index_jobs WHERE status = 'succeeded' AND corpus = 'vault' AND project IS NOT NULL)")
def snk13(spark, sf):
    """Folders of projects that have no index of notes."""
    active = read_table(spark, sf, "index_jobs").filter("status = 'succeeded' and corpus = 'vault'").select("project").distinct()
    return read_table(spark, sf, "file_changes").filter("project is not null").select("project").distinct().join(active, "project", "left_anti").select(F.sha2("project", 256).alias("folder"))


@query("flt08_visible_edges", f"WITH {_E} SELECT edge_key FROM e WHERE edge_key NOT IN (SELECT edge_key FROM o WHERE action = 'suppress')")
def flt08(spark, sf):
    return T.visible_edges(edges(spark, sf), overrides(spark, sf)).select("edge_key")


QUERIES["jn06_override_anti_join"], SQL["jn06_override_anti_join"] = flt08, SQL["flt08_visible_edges"]
_LIVE = "held AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC, row_no DESC) rn FROM vault_notes WHERE id IS NOT NULL), live AS (SELECT * FROM held WHERE rn = 1 AND NOT is_deleted)"


def live(spark, sf, *columns):
    from tidemark.operators.notes import live_notes

    return live_notes(read_table(spark, sf, "vault_notes"), list(columns))


@query("jn01_link_resolution", f"""WITH {_LIVE}, l AS (SELECT DISTINCT id, unnest(links) link FROM live WHERE links IS NOT NULL)
SELECT l.id, CASE WHEN p.path IS NOT NULL THEN 'vault:' || p.id ELSE 'external:vault-link:' || l.link END target_key, CASE WHEN p.path IS NOT NULL THEN 'resolved' ELSE 'unresolved' END resolution
FROM l LEFT JOIN (SELECT path, min(id) id FROM live GROUP BY path) p ON p.path = l.link WHERE l.link IS NOT NULL""")
def jn01(spark, sf):
    n = live(spark, sf, "path", "links")
    links = n.select("id", F.explode("links").alias("link")).filter("link is not null").distinct()
    known = n.filter("path is not null").groupBy(C("path").alias("link")).agg(F.min("id").alias("to"))
    return links.join(known, "link", "left").select("id", F.when(C("to").isNotNull(), F.concat(F.lit("vault:"), "to")).otherwise(F.concat(F.lit("external:vault-link:"), "link")).alias("target_key"), F.when(C("to").isNotNull(), "resolved").otherwise("unresolved").alias("resolution"))


QUERIES["grf03_note_links"] = lambda spark, sf: jn01(spark, sf).select(F.sha2(F.concat_ws("\0", F.lit("derived"), F.lit("markdown-links-v1"), F.concat(F.lit("vault:"), "id"), "target_key", F.lit("links_to")), 256).alias("edge_key"), "target_key", "resolution")
SQL["grf03_note_links"] = "SELECT sha256(concat_ws(chr(0), 'derived', 'markdown-links-v1', 'vault:' || id, target_key, 'links_to')) edge_key, target_key, resolution FROM (" + SQL["jn01_link_resolution"] + ")"

_SEG = "seg AS (SELECT id, max(content_hash) content_hash, max(indexed_at) indexed_at, max(file_path) file_path FROM code_chunks GROUP BY id)"


def segments(spark, sf):
    return read_table(spark, sf, "code_chunks").groupBy("id").agg(*[F.max(c).alias(c) for c in ("content_hash", "indexed_at", "file_path")])


def file_states(spark, sf, half=False):
    """``id, digest`` of the code files that exist, at the end of all changes or of what arrived in the first half of time."""
    d = read_table(spark, sf, "file_changes").filter("corpus = 'code' and path is not null").withColumn("at", F.unix_micros(C("arrived_at").cast("timestamp")))
    if half:
        d = d.join(F.broadcast(d.agg(F.expr("(min(at) + max(at)) div 2").alias("half"))), C("at") <= C("half"))  # one row
    held = d.groupBy(C("path").alias("id")).agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s"))
    return held.select("id", C("s.content_hash").alias("digest")).filter("digest is not null")


_STATES = """fc AS (SELECT *, epoch_us(arrived_at) AS t_us FROM file_changes WHERE corpus = 'code' AND path IS NOT NULL),
pend AS (SELECT path id, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) content_hash FROM fc GROUP BY path HAVING content_hash <> ''),
st AS (SELECT path id, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) stored_hash FROM fc WHERE t_us <= (SELECT (min(t_us) + max(t_us)) // 2 FROM fc) GROUP BY path HAVING stored_hash <> '')"""


@query("jn02_vector_reuse", f"WITH {_STATES} SELECT id, CASE WHEN stored_hash IS NULL THEN 'embed_new' WHEN stored_hash = content_hash THEN 'reuse' ELSE 'embed_changed' END action FROM pend LEFT JOIN st USING (id)")
def jn02(spark, sf):
    """What is there now beside what an index of the first half of time has stored."""
    old = file_states(spark, sf, half=True).withColumnRenamed("digest", "stored")
    return file_states(spark, sf).join(old, "id", "left").select("id", F.when(C("stored").isNull(), "embed_new").when(C("stored") == C("digest"), "reuse").otherwise("embed_changed").alias("action"))


QUERIES["str09_vector_reuse"], SQL["str09_vector_reuse"] = jn02, SQL["jn02_vector_reuse"]


@query("jn03_stale_segments", f"WITH {_SEG}, gone AS (SELECT path FROM file_changes WHERE corpus = 'code' GROUP BY path HAVING arg_max(coalesce(content_hash, ''), (modified_at, change_id)) = '') SELECT id FROM seg WHERE file_path IN (SELECT path FROM gone)")
def jn03(spark, sf):
    """Stored segments that a parse of the changed files doesn't give any more: the scope are the files with changes, and
    current are the segments of those that still exist."""
    s, d = segments(spark, sf), read_table(spark, sf, "file_changes").filter("corpus = 'code'")
    dirty = d.select(C("path").alias("file_path")).distinct()
    current = s.join(file_states(spark, sf).select(C("id").alias("file_path")), "file_path", "left_semi").select("id")
    return s.join(dirty, "file_path", "left_semi").join(current, "id", "left_anti").select("id")


@query("jn04_removed_notes", f"WITH {_LIVE} SELECT DISTINCT path FROM vault_notes WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM live WHERE path IS NOT NULL)")
def jn04(spark, sf):
    stored = read_table(spark, sf, "vault_notes").filter("path is not null").select("path").distinct()
    return stored.join(live(spark, sf, "path").select("path").distinct(), "path", "left_anti")


QUERIES["set03_difference"], SQL["set03_difference"] = jn04, SQL["jn04_removed_notes"]


@query("jn05_newer_files", """WITH f AS (SELECT project, path, max(modified_at) m FROM file_changes GROUP BY ALL), d AS (SELECT path, max(synced_at) s FROM vault_notes WHERE path IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN s IS NULL THEN 'new' WHEN m > s THEN 'changed' ELSE 'skip' END action FROM f LEFT JOIN d USING (path)""")
def jn05(spark, sf):
    files = read_table(spark, sf, "file_changes").groupBy("project", "path").agg(F.max("modified_at").alias("m"))
    docs = read_table(spark, sf, "vault_notes").filter("path is not null").groupBy("path").agg(F.max("synced_at").alias("s"))
    return files.join(docs, "path", "left").select("path", F.when(C("s").isNull(), "new").when(C("m") > C("s"), "changed").otherwise("skip").alias("action"))


@query("jn07_touching_edges", f"WITH {_E}, g AS (SELECT node_key FROM n WHERE kind = 'function') SELECT edge_key FROM e WHERE source_key IN (SELECT node_key FROM g) OR target_key IN (SELECT node_key FROM g)")
def jn07(spark, sf):
    return T.touching(nodes(spark, sf).filter("kind = 'function'"), edges(spark, sf)).select("edge_key")


@query("jn08_smallest_enclosing", """WITH s AS (SELECT DISTINCT id, file_path, start_line a, end_line z FROM code_chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL)
SELECT c.id, arg_min(p.id, (p.z - p.a, p.id)) owner FROM s c JOIN s p ON p.file_path = c.file_path AND p.a <= c.a AND p.z >= c.z AND p.id <> c.id GROUP BY c.id""")
def jn08(spark, sf):
    """The smallest other segment of the file that encloses a segment's lines."""
    s = read_table(spark, sf, "code_chunks").filter("start_line is not null and end_line is not null").select("id", "file_path", C("start_line").alias("a"), C("end_line").alias("z"))
    return T.smallest_enclosing(s, "file_path", "id", "a", "z")


@query("jn09_hits_to_nodes", f"""WITH {_E}, h AS (SELECT DISTINCT hit_id, source, path, qualified_symbol FROM search_hits) SELECT hit_id, node_key FROM h JOIN n ON n.path = h.path AND n.corpus = 'vault' WHERE source = 'vault'
UNION SELECT hit_id, node_key FROM h JOIN n ON n.path = h.path AND n.label = h.qualified_symbol AND n.corpus = 'code' WHERE source = 'code'""")
def jn09(spark, sf):
    h = read_table(spark, sf, "search_hits").select("hit_id", "source", "path", "qualified_symbol").distinct()
    n = nodes(spark, sf).select("node_key", "corpus", C("path").alias("np"), "label")
    vault = h.filter("source = 'vault'").join(n.filter("corpus = 'vault'"), C("path") == C("np")).select("hit_id", "node_key")
    code = h.filter("source = 'code'").join(n.filter("corpus = 'code'"), (C("path") == C("np")) & (C("qualified_symbol") == C("label"))).select("hit_id", "node_key")
    return vault.unionByName(code).distinct()


@query("jn10_broken_links", f"WITH {_LIVE} SELECT DISTINCT id, link FROM (SELECT id, unnest(links) link FROM live) WHERE link IS NOT NULL AND link NOT IN (SELECT path FROM live WHERE path IS NOT NULL)")
def jn10(spark, sf):
    n = live(spark, sf, "path", "links")
    return n.select("id", F.explode("links").alias("link")).filter("link is not null").join(n.select(C("path").alias("link")), "link", "left_anti").select("id", "link").distinct()


@query("jn11_broken_supersedes", f"WITH {_LIVE} SELECT id, supersedes FROM live WHERE supersedes IS NOT NULL AND NOT starts_with(supersedes, 'path:') AND supersedes NOT IN (SELECT id FROM live)")
def jn11(spark, sf):
    n = live(spark, sf, "supersedes")
    named = n.filter("supersedes is not null").filter(~C("supersedes").startswith("path:"))
    return named.join(n.select(C("id").alias("k")), C("supersedes") == C("k"), "left_anti").select("id", "supersedes")


@query("jn12_checkpoint_links", f"""WITH {_LIVE}, t AS (SELECT path, max(title) title FROM live WHERE path IS NOT NULL GROUP BY path)
SELECT DISTINCT link_id, l.path, t.path IS NOT NULL AS found, coalesce(l.title, t.title) title FROM linked_notes l LEFT JOIN t ON t.path = l.path""")
def jn12(spark, sf):
    known = live(spark, sf, "path", "title").filter("path is not null").groupBy(C("path").alias("p")).agg(F.max("title").alias("t"))
    links = read_table(spark, sf, "linked_notes").select("link_id", "path", "title").distinct()
    return links.join(known, C("path") == C("p"), "left").select("link_id", "path", C("p").isNotNull().alias("found"), F.coalesce("title", "t").alias("title")).distinct()


_REDIR = "proj AS (SELECT DISTINCT project k FROM index_jobs), red AS (SELECT k old, lead(k) OVER (ORDER BY k) new, row_number() OVER (ORDER BY k) i FROM proj), r AS (SELECT old, new FROM red WHERE i % 3 <> 0 AND new IS NOT NULL)"


@query("jn13_redirect_chains", f"""WITH RECURSIVE {_REDIR}, w AS (SELECT old AS key, new AS here, 1 d FROM r UNION ALL SELECT w.key, r.new, d + 1 FROM w JOIN r ON r.old = w.here WHERE d < 50) SELECT key, arg_max(here, d) target FROM w GROUP BY key""")
def jn13(spark, sf):
    """Where chains of renamed projects end; a circle ends nowhere. The chains are trees, so the hierarchy finds them."""
    from tidemark.operators.hierarchy import resolve_hierarchy

    one = Window.orderBy("k")  # a few dozen projects
    p = read_table(spark, sf, "index_jobs").select(C("project").alias("k")).distinct().withColumn("new", F.lead("k").over(one)).withColumn("i", F.row_number().over(one))
    moved = p.filter("i % 3 <> 0 and new is not null").select(C("k").alias("id"), C("new").alias("parent"))
    all_ids = p.select(C("k").alias("id")).join(moved, "id", "left")
    return resolve_hierarchy(all_ids).filter("depth > 0").select(C("id").alias("key"), C("root_id").alias("target"))


@query("jn14_longest_prefix", """WITH r AS (SELECT DISTINCT regexp_extract(file_path, '^[^/]+/[^/]+', 0) root FROM code_chunks UNION SELECT DISTINCT split_part(file_path, '/', 1) FROM code_chunks),
p AS (SELECT DISTINCT path FROM file_changes WHERE path IS NOT NULL) SELECT path, arg_max(root, length(root)) root FROM p JOIN r ON path = root OR starts_with(path, root || '/') WHERE root <> '' GROUP BY path""")
def jn14(spark, sf):
    """The longest root above a path: paths are opened into their prefixes, and these meet the roots by equality."""
    files = read_table(spark, sf, "code_chunks").select("file_path").distinct()
    roots = files.select(F.regexp_extract("file_path", r"^[^/]+/[^/]+", 0).alias("root")).union(files.select(F.split_part("file_path", F.lit("/"), F.lit(1)))).distinct()
    paths = read_table(spark, sf, "file_changes").filter("path is not null").select("path").distinct()
    opened = paths.select("path", F.explode(F.concat(folder_chain(C("path")), F.array("path"))).alias("root"))
    return opened.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


@query("jn15_all_neighbours", """SELECT vec_id, other, rank FROM (SELECT a.vec_id, b.vec_id other, row_number() OVER (PARTITION BY a.vec_id ORDER BY
 list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id)::int rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 6""")
def jn15(spark, sf):
    """The stated query set against all rows, in blocks; the first of each is the vector itself."""
    e = read_table(spark, sf, "embeddings")
    return exact_neighbours(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "q"), e, 6, "q", "vec_id", "embedding").select(C("q").alias("vec_id"), C("vec_id").alias("other"), "rank")


@query("agg02_next_generation", f"WITH {_E} SELECT coalesce(max(generation), 0) + 1 generation FROM (SELECT generation FROM e UNION ALL SELECT generation FROM n)")
def agg02(spark, sf):
    return T.next_generation(nodes(spark, sf), edges(spark, sf))


@query("agg03_index_counters", f"WITH {_STATES} SELECT count(*) segments, count(DISTINCT split_part(id, '/', 1)) projects, count_if(stored_hash IS NULL OR stored_hash <> content_hash) embedded, count_if(stored_hash = content_hash) reused FROM pend LEFT JOIN st USING (id)")
def agg03(spark, sf):
    """Counters of an index run."""
    a = jn02(spark, sf)
    return a.agg(F.count("*").alias("segments"), F.countDistinct(F.split_part("id", F.lit("/"), F.lit(1))).alias("projects"), F.count_if(C("action") != "reuse").alias("embedded"), F.count_if(C("action") == "reuse").alias("reused"))


@query("agg04_file_paths", "SELECT DISTINCT file_path FROM code_chunks")
def agg04(spark, sf):
    return read_table(spark, sf, "code_chunks").select("file_path").distinct()


@query("agg05_last_sync", "SELECT path, arg_max(id, row_no) id, max(row_no) row_no FROM vault_notes WHERE path IS NOT NULL AND id IS NOT NULL GROUP BY path")
def agg05(spark, sf):
    n = read_table(spark, sf, "vault_notes").filter("path is not null and id is not null")
    return n.groupBy("path").agg(F.max_by("id", "row_no").alias("id"), F.max("row_no").alias("row_no"))


@query("agg06_rrf_sums", "SELECT path, round(sum(1.0::double / (60 + r)), 9) rrf FROM (SELECT path, row_number() OVER (PARTITION BY query_id ORDER BY score, hit_id) r FROM (SELECT DISTINCT query_id, hit_id, path, score FROM search_hits WHERE score IS NOT NULL)) GROUP BY path")
def agg06(spark, sf):
    h = read_table(spark, sf, "search_hits").filter("score is not null").select("query_id", "hit_id", "path", "score").distinct()
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "hit_id")))
    return ranked.groupBy("path").agg(F.round(F.sum(1.0 / (60 + C("r"))), 9).alias("rrf"))


@query("agg08_undirected_pairs", f"WITH {_E} SELECT least(source_key, target_key) key_a, greatest(source_key, target_key) key_b, max(confidence)::double confidence FROM e GROUP BY ALL")
def agg08(spark, sf):
    return T.pairs_once(edges(spark, sf), "source_key", "target_key", "confidence").withColumn("confidence", C("confidence").cast("double"))


@query("agg09_best_per_target", f"WITH {_E} SELECT target_key, max(confidence)::double confidence FROM e GROUP BY target_key")
def agg09(spark, sf):
    return edges(spark, sf).groupBy("target_key").agg(F.max("confidence").cast("double").alias("confidence"))


@query("agg10_rekey_collisions", """WITH r AS (SELECT item_key, content_hash, min((coalesce(segment_index, 0), id)) place FROM code_chunks GROUP BY ALL), f AS (SELECT item_key, arg_min(content_hash, (place, content_hash)) fh FROM r GROUP BY item_key)
SELECT CASE WHEN content_hash = fh THEN item_key ELSE sha256(item_key || chr(0) || content_hash) END item_key, content_hash FROM r JOIN f USING (item_key)""")
def agg10(spark, sf):
    c = read_table(spark, sf, "code_chunks").select("item_key", "content_hash", F.coalesce("segment_index", F.lit(0)).alias("at"), "id")
    return T.rekey_collisions(c, "item_key", "content_hash", ["at", "id"])


@query("agg11_first_wins", "SELECT path, min(hit_id) hit_id FROM search_hits GROUP BY path")
def agg11(spark, sf):
    return read_table(spark, sf, "search_hits").groupBy("path").agg(F.min("hit_id").alias("hit_id"))


@query("agg12_hint_dedup", "SELECT DISTINCT source_key, relation, target_key FROM graph_edges")
def agg12(spark, sf):
    return read_table(spark, sf, "graph_edges").select("source_key", "relation", "target_key").distinct()


@query("agg13_last_wins", f"WITH {_E} SELECT node_key, row_no FROM n")
def agg13(spark, sf):
    return nodes(spark, sf).select("node_key", "row_no")


@query("grf01_structure_graph", """WITH f AS (SELECT DISTINCT file_path p FROM code_chunks WHERE file_path IS NOT NULL), s AS (SELECT DISTINCT file_path p, item_key FROM code_chunks WHERE file_path IS NOT NULL),
a AS (SELECT p, string_split(p, '/') x FROM f), c AS (SELECT DISTINCT array_to_string(x[1:i], '/') parent, array_to_string(x[1:i + 1], '/') child, i + 1 = len(x) leaf FROM a, unnest(generate_series(1, len(x) - 1)) t(i))
SELECT 'structure:folder:' || parent source_key, CASE WHEN leaf THEN 'structure:file:' ELSE 'structure:folder:' END || child target_key FROM c UNION SELECT 'structure:file:' || p, 'code:' || item_key FROM s""")
def grf01(spark, sf):
    """Folders contain folders and files, files contain symbols."""
    c = read_table(spark, sf, "code_chunks").filter("file_path is not null")
    chain = c.select("file_path").distinct().select("file_path", F.posexplode(folder_chain(C("file_path"))).alias("i", "parent"), F.concat(folder_chain(C("file_path")), F.array("file_path")).alias("all"))
    child = F.get("all", C("i") + 1)
    kind = F.when(C("i") + 2 == F.size("all"), "structure:file:").otherwise("structure:folder:")
    folders = chain.select(F.concat(F.lit("structure:folder:"), "parent").alias("source_key"), F.concat(kind, child).alias("target_key"))
    symbols = c.select(F.concat(F.lit("structure:file:"), "file_path").alias("source_key"), F.concat(F.lit("code:"), "item_key").alias("target_key"))
    return folders.unionByName(symbols).distinct()


@query("grf02_hint_edges", f"WITH {_E} SELECT edge_key, 'unresolved' resolution FROM e WHERE starts_with(target_key, 'external:') AND NOT starts_with(target_key, 'external:vault-link:')")
def grf02(spark, sf):
    t = C("target_key")
    return edges(spark, sf).filter(t.startswith("external:") & ~t.startswith("external:vault-link:")).select("edge_key", F.lit("unresolved").alias("resolution"))


@query("grf04_reconcile", f"WITH {_E}, up AS (SELECT * FROM e WHERE extractor = 'semantic-v1' AND resolution = 'resolved') SELECT edge_key, CASE WHEN edge_key IN (SELECT edge_key FROM up) THEN 100 ELSE generation END generation FROM e WHERE edge_key IN (SELECT edge_key FROM up) OR NOT coalesce(origin = 'derived' AND extractor = 'semantic-v1' AND generation < 100, false)")
def grf04(spark, sf):
    """Generation 100 of one extractor finds the resolved edges again: they are upserted first, then what it didn't bring is
    pruned."""
    e = edges(spark, sf)
    new = e.filter("extractor = 'semantic-v1' and resolution = 'resolved'").withColumn("generation", F.lit(100).cast("long"))
    return T.prune(T.upsert(e, new, "edge_key"), "semantic-v1", 100).select("edge_key", "generation")


_PARTS = SQL["grf01_structure_graph"]


@query("set02_extractor_union", f"SELECT 'structure' extractor, source_key, target_key FROM ({_PARTS}) UNION ALL SELECT 'links', 'vault:' || id, target_key FROM ({SQL['jn01_link_resolution']})")
def set02(spark, sf):
    """Edges of two extractors, those of the folders and those of the notes' links, one after the other."""
    structure = grf01(spark, sf).select(F.lit("structure").alias("extractor"), "source_key", "target_key")
    return structure.unionByName(jn01(spark, sf).select(F.lit("links").alias("extractor"), F.concat(F.lit("vault:"), "id").alias("source_key"), "target_key"))


@query("grf05_path_patch", f"WITH {_E}, g AS (SELECT node_key FROM n WHERE path IS NOT NULL AND {_GONE}) SELECT edge_key FROM e WHERE source_key NOT IN (SELECT node_key FROM g) AND target_key NOT IN (SELECT node_key FROM g)")
def grf05(spark, sf):
    gone = nodes(spark, sf).filter(GONE).select("node_key")
    return T.delete_nodes(nodes(spark, sf), edges(spark, sf), overrides(spark, sf), gone)[1].select("edge_key")


QUERIES["grf06_visible_edges"], SQL["grf06_visible_edges"] = flt08, SQL["flt08_visible_edges"]


@query("grf07_user_edges", f"WITH {_E} SELECT edge_key, origin = 'user' AND extractor IS NULL AND generation IS NULL AND regexp_full_match(relation, '[a-z_]+') AND source_key <> target_key valid FROM e WHERE origin = 'user'")
def grf07(spark, sf):
    """User edges are owned by users: no extractor, no generation, a plain relation, two ends."""
    ok = C("extractor").isNull() & C("generation").isNull() & C("relation").rlike("^[a-z_]+$") & (C("source_key") != C("target_key"))
    return edges(spark, sf).filter("origin = 'user'").select("edge_key", ok.alias("valid"))


@query("fn20_edge_metadata", "SELECT row_no, metadata_json IS NOT NULL AND json_valid(metadata_json) ok FROM graph_edges")
def fn20(spark, sf):
    return read_table(spark, sf, "graph_edges").select("row_no", json_ok(C("metadata_json")).alias("ok"))


_DIST = "list_sum(list_transform(list_zip({0}::DOUBLE[], {1}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query("grf08_semantic_graph", f"""WITH {_E}, c AS (SELECT file_path, symbol_name, arg_min(vector, id) v FROM code_chunks WHERE symbol_name IS NOT NULL GROUP BY ALL),
nd AS (SELECT node_key, path, label FROM n WHERE corpus = 'code' AND NOT is_deleted), sel AS (SELECT node_key, path, label FROM nd WHERE EXISTS (SELECT 1 FROM c WHERE file_path = path AND symbol_name = label) ORDER BY node_key LIMIT 100),
sv AS (SELECT node_key, c.v FROM sel JOIN c ON file_path = path AND symbol_name = label), t AS (SELECT min(node_key) target, any_value(c.v) v FROM nd JOIN c ON file_path = path AND symbol_name = label GROUP BY file_path, symbol_name),
k AS (SELECT sv.node_key source, t.target, 1 / (1 + {_DIST.format('sv.v', 't.v')}) c FROM sv, t WHERE t.target <> sv.node_key), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, target) i FROM k WHERE c >= 0.7)
SELECT least(source, target) key_a, greatest(source, target) key_b, round(max(c), 6) confidence FROM r WHERE i <= 5 GROUP BY ALL""")
def grf08(spark, sf):
    """Links by meaning between code nodes, never stored: the first 100 nodes by key that have a vector, the five nearest
    other nodes of each with a confidence of 0.7 or more, each pair once."""
    n = nodes(spark, sf).filter("corpus = 'code' and not is_deleted").select("node_key", "path", "label")
    c = read_table(spark, sf, "code_chunks").filter("symbol_name is not null").groupBy(C("file_path").alias("path"), C("symbol_name").alias("label")).agg(F.min_by("vector", "id").alias("vector"))
    return semantic_graph(n, c, n, max_nodes=100, neighbours=5, least=0.7)


@query("top05_node_selection", f"WITH {_E} SELECT node_key FROM n ORDER BY node_key LIMIT 100")
def top05(spark, sf):
    return nodes(spark, sf).select("node_key").orderBy("node_key").limit(100)


@query("jn05_node_instants", f"SELECT row_no, epoch_us(try_cast(updated_at AS timestamptz)) micros FROM graph_nodes WHERE length(updated_at) > 10")
def instants(spark, sf):
    return read_table(spark, sf, "graph_nodes").filter("length(updated_at) > 10").select("row_no", F.unix_micros(parse_instant("updated_at")).alias("micros"))
