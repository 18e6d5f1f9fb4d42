"""Queries of sources, parsing, chunking, embedding, watching and the composite reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions.text import cut_text, project_key
from tidemark.operators import codeparse, embed, markdown, packs
from tidemark.operators import tables as T
from tidemark.operators.notes import live_notes
from tidemark.sources import files
from tidemark.session import ensure_checkpoint_dir, read_table
from tidemark.streaming import watch

QUERIES, SQL = {}, {}
C = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_LIVE = "held AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY synced_at DESC, row_no DESC) rn FROM vault_notes WHERE id IS NOT NULL), live AS (SELECT * FROM held WHERE rn = 1 AND NOT is_deleted)"
_WIKI = "lower(split_part(regexp_replace(replace(path, '\\', '/'), '^(\\./)+', ''), '/', 1)) = 'wiki'"


#: A readable date, as the notes' lints see it.
_READ = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} || 'T00:00:00+00:00' AS timestamptz) WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN try_cast({0} AS timestamptz) END"


@query("src01_note_discovery", f"SELECT DISTINCT path FROM linked_notes WHERE regexp_full_match(path, '(?:.*/)?[^/]*\\.md') AND NOT regexp_matches(path, '(^|/)(node_modules|target|\\.git)/') AND NOT {_WIKI}")
def src01(spark, sf):
    return files.select_notes(read_table(spark, sf, "linked_notes").select("path")).distinct()


@query("src03_code_discovery", "SELECT DISTINCT path FROM file_changes WHERE regexp_matches(path, '\\.(rs|go|js|mjs|cjs|jsx|ts|mts|cts|tsx|py|pyi|c|h|cc|cpp|cxx|hh|hpp|hxx|java|rb|swift|vue)$') AND NOT list_has_any(string_split(path, '/'), ['.git', 'target', 'node_modules', 'dist', 'build', '.next', '.nuxt', 'coverage'])")
def src03(spark, sf):
    return files.select_code(read_table(spark, sf, "file_changes").select("path")).distinct()


@query("src05_document_listing", "SELECT path, max(modified_at) modified_at FROM file_changes WHERE corpus = 'vault' AND ends_with(path, '.md') AND NOT contains(path, '.bak') GROUP BY path")
def src05(spark, sf):
    d = read_table(spark, sf, "file_changes").filter("corpus = 'vault'").filter(C("path").endswith(".md") & ~C("path").contains(".bak"))
    return d.groupBy("path").agg(F.max("modified_at").alias("modified_at"))


@query("src08_missing_table", "SELECT node_key, action FROM (SELECT '' node_key, '' action) WHERE false")
def src08(spark, sf):
    return files.table_or_empty(spark, f"{sf}/graph_edge_overrides.parquet", "node_key string, action string")


_FRONT = """fm AS (SELECT doc_id, text, CASE WHEN starts_with(text, '---' || chr(13) || chr(10)) THEN chr(13) || chr(10) WHEN starts_with(text, '---' || chr(10)) THEN chr(10) END nl FROM documents),
fp AS (SELECT *, 3 + length(nl) opening, instr(substr(text, 4 + length(nl)), nl || '---' || nl) e, starts_with(substr(text, 4 + length(nl)), '---' || nl) none FROM fm),
fh AS (SELECT *, CASE WHEN none THEN '' WHEN e > 0 THEN substr(text, opening + 1, e - 1) END head, CASE WHEN none THEN substr(text, opening + 4 + length(nl)) WHEN e > 0 THEN substr(text, opening + e + 3 + 2 * length(nl)) END rest FROM fp)"""


@query("fn01_front_matter", f"""WITH {_FRONT} SELECT doc_id, CASE WHEN regexp_matches(head, '(?m)^id:[ \t]*\\S') THEN regexp_extract(head, '(?m)^id:[ \t]*[\"'']?(.*?)[\"'']?[ \t\r]*$', 1) END id,
 CASE WHEN nl IS NULL THEN coalesce(text, '') WHEN head IS NULL THEN '' ELSE regexp_replace(rest, '^[\r\n]+', '') END body, CASE WHEN nl IS NOT NULL AND head IS NULL THEN 'unclosed front matter' END AS error FROM fh""")
def fn01(spark, sf):
    return markdown.front_matter(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", C("fields")["id"].alias("id"), "body", "error")


@query("fn04_note_chunks")
def fn04(spark, sf):
    return markdown.note_chunks(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


_SEGMENT_END = "CASE WHEN {a} + 600 < length(t) AND instr(substr(t, {a} + 2, 599), chr(10)) > 0 THEN {a} + 601 - instr(reverse(substr(t, {a} + 2, 599)), chr(10)) ELSE least({a} + 600, length(t)) END"


@query("fn06_code_segments", f"""WITH RECURSIVE c AS (SELECT DISTINCT id, coalesce(content, '') t FROM code_chunks),
w AS (SELECT id, t, 0 i, 0::bigint a, CASE WHEN length(t) <= 600 THEN length(t) ELSE {_SEGMENT_END.format(a='0')} END::bigint z FROM c
 UNION ALL SELECT id, t, i + 1, b, ({_SEGMENT_END.format(a='b')})::bigint FROM (SELECT *, CASE WHEN z - 80 > a THEN z - 80 ELSE z END b FROM w WHERE z < length(t)))
SELECT id, i segment_index, substr(t, a + 1, z - a) AS content, sha256(substr(t, a + 1, z - a)) content_hash FROM w""")
def fn06(spark, sf):
    c = read_table(spark, sf, "code_chunks").select("id", "content").distinct()
    return codeparse.code_segments(c, "id", "content", 600, 80)


@query("emb01_embeddings")
def emb01(spark, sf):
    return embed.embed_texts(read_table(spark, sf, "documents"), "doc_id", "text", 64).withColumn("vector", F.transform("vector", lambda x: F.round(x, 5)))


def _parse(language):
    def run(spark, sf):
        c = read_table(spark, sf, "code_chunks").withColumn("lang", P.language_name(C("language"))).filter(C("lang").isin(*language)).select("id", "file_path", "lang", "content").distinct()
        return codeparse.code_items(c, "id", "file_path", "lang", "content").select("row", "symbol_name", "qualified_symbol", "kind", "start_line", "end_line", "error")

    return run


for _name, _languages in {"par02_rust_items": ["rust"], "par03_go_items": ["go"], "par04_web_items": ["javascript", "jsx", "typescript", "tsx"], "par05_python_items": ["python"], "par06_native_items": ["c", "cpp", "java", "ruby", "swift"], "par07_vue_items": ["vue"]}.items():
    QUERIES[_name] = _parse(_languages)


@query("par01_dispatch", "SELECT language_name, count(*) files FROM (SELECT DISTINCT file_path, CASE lower(trim(language)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END language_name FROM code_chunks) GROUP BY language_name")
def par01(spark, sf):
    """Files per parser that takes them."""
    c = read_table(spark, sf, "code_chunks").select("file_path", P.language_name(C("language")).alias("language_name")).distinct()
    return c.groupBy("language_name").agg(F.count("*").alias("files"))


@query("par08_relation_hints")
def par08(spark, sf):
    c = read_table(spark, sf, "code_chunks").withColumn("lang", P.language_name(C("language"))).select("id", "file_path", "lang", "content").distinct()
    return codeparse.code_hints(c, "id", "file_path", "lang", "content")


@query("str02_debounce", """SELECT user_id, min(ts) dirty_since, max(ts) last_event, count(*) events FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) prev FROM events)) GROUP BY user_id, s""")
def str02(spark, sf):
    e = read_table(spark, sf, "events").withColumn("ts", C("ts").cast("timestamp"))
    return watch.debounce(e, "user_id", "ts", "6 hours")


_BURST = """b AS (SELECT project, min(arrived_at) dirty_since, max(arrived_at) last_event, count(*) events, count(DISTINCT path) dirty_paths FROM (SELECT *, sum(CASE WHEN prev IS NULL OR arrived_at > prev + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY arrived_at, change_id) s
 FROM (SELECT *, lag(arrived_at) OVER (PARTITION BY project ORDER BY arrived_at, change_id) prev FROM file_changes)) GROUP BY project, s)"""


def bursts(spark, sf):
    e = read_table(spark, sf, "file_changes").withColumn("arrived_at", C("arrived_at").cast("timestamp"))
    return watch.debounce(e, "project", "arrived_at", "1 hour", "path")


@query("str03_dirty_paths", f"WITH {_BURST} SELECT project, dirty_since, last_event, events, dirty_paths FROM b")
def str03(spark, sf):
    return bursts(spark, sf).select("project", "dirty_since", "last_event", "events", "dirty_paths")


@query("str04_overflow", f"WITH {_BURST} SELECT project, dirty_since, events > 20 full_walk FROM b")
def str04(spark, sf):
    return watch.overflowed(bursts(spark, sf), 20).select("project", "dirty_since", "full_walk")


@query("str05_fresh_enough", f"WITH {_BURST}, m AS (SELECT project, max(finished_at) done FROM index_jobs WHERE status = 'succeeded' GROUP BY project) SELECT project, dirty_since FROM b LEFT JOIN m USING (project) WHERE done IS NULL OR done < dirty_since")
def str05(spark, sf):
    done = read_table(spark, sf, "index_jobs").filter("status = 'succeeded' and finished_at is not null").select("project", C("finished_at").cast("timestamp").alias("completed_at"))
    return watch.stale_bursts(bursts(spark, sf), done, "project").select("project", "dirty_since")


@query("str06_scope", f"WITH {_BURST} SELECT project, dirty_since, CASE WHEN dirty_paths BETWEEN 1 AND 200 THEN 'paths' ELSE 'full' END AS scope FROM b")
def str06(spark, sf):
    return watch.index_scope(bursts(spark, sf)).select("project", "dirty_since", "scope")


@query("str11_job_lint", """SELECT job_id, problem FROM (SELECT job_id, CASE WHEN count(DISTINCT status) > 1 THEN 'several_states' WHEN max(status) IN ('succeeded', 'failed', 'cancelled') AND max(finished_at) IS NULL THEN 'no_end'
 WHEN max(finished_at) < max(started_at) THEN 'ends_before_start' WHEN max(progress) > 100 OR min(progress) < 0 THEN 'progress' END problem FROM index_jobs GROUP BY job_id) WHERE problem IS NOT NULL""")
def str11(spark, sf):
    return watch.job_lint(read_table(spark, sf, "index_jobs"))


@query("set04_dirty_union", "SELECT path, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) <> '' AS existing FROM file_changes GROUP BY path")
def set04(spark, sf):
    """Dirty paths of all events, each once, with whether the file is still there."""
    d = read_table(spark, sf, "file_changes")
    return d.groupBy("path").agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s")).select("path", C("s.content_hash").isNotNull().alias("existing"))


@query("agg01_overview", f"""WITH {_LIVE} SELECT 'folder' kind, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS name, count(*) n FROM live WHERE path IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'status', coalesce(nullif(status, ''), 'active'), count(*) FROM live GROUP BY ALL UNION ALL SELECT 'total', 'notes', count(*) FROM live""")
def agg01(spark, sf):
    """Counts by top folder and by status, and the total: one pass by grouping sets over tagged rows."""
    n = live_notes(read_table(spark, sf, "vault_notes"), ["path", "status"])
    folder = F.when(C("path").contains("/"), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("(root)")
    tags = F.array(F.struct(F.lit("folder").alias("kind"), F.when(C("path").isNotNull(), folder).alias("name")), F.struct(F.lit("status").alias("kind"), F.coalesce(F.nullif(C("status"), F.lit("")), F.lit("active")).alias("name")), F.struct(F.lit("total").alias("kind"), F.lit("notes").alias("name")))
    return n.select(F.explode(tags).alias("t")).select("t.*").filter("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))


QUERIES["cmp01_overview"], SQL["cmp01_overview"] = agg01, SQL["agg01_overview"]


@query("top03_recent_notes", f"WITH {_LIVE} SELECT id, created_at FROM (SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) r FROM live) WHERE r <= 50")
def top03(spark, sf):
    n = live_notes(read_table(spark, sf, "vault_notes"), ["created_at"])
    return n.orderBy(C("created_at").desc_nulls_last(), "id").limit(50)


@query("top04_checkpoints", f"WITH {_LIVE} SELECT id, path, status FROM live WHERE doc_type = 'checkpoint'")
def top04(spark, sf):
    return live_notes(read_table(spark, sf, "vault_notes"), ["path", "status", "doc_type"]).filter("doc_type = 'checkpoint'").select("id", "path", "status")


@query("top07_backup_rotation", "SELECT path, change_id FROM (SELECT path, change_id, row_number() OVER (PARTITION BY path ORDER BY modified_at DESC, change_id DESC) r FROM file_changes) WHERE r <= 4")
def top07(spark, sf):
    return T.keep_newest(read_table(spark, sf, "file_changes").select("path", "change_id", "modified_at"), ["path"], [C("modified_at").desc(), C("change_id").desc()], 4).select("path", "change_id")


@query("top08_least_recent", "SELECT corpus, arg_min(project, (last_used, project)) victim FROM (SELECT corpus, project, max(started_at) last_used FROM index_jobs GROUP BY ALL) GROUP BY corpus")
def top08(spark, sf):
    used = read_table(spark, sf, "index_jobs").groupBy("corpus", "project").agg(F.max("started_at").alias("used"))
    return used.groupBy("corpus").agg(F.min(F.struct("used", "project")).alias("v")).select("corpus", C("v.project").alias("victim"))


@query("top09_job_snapshots", "SELECT DISTINCT job_id, status FROM index_jobs QUALIFY dense_rank() OVER (ORDER BY started_at DESC, job_id) <= 20")
def top09(spark, sf):
    return read_table(spark, sf, "index_jobs").select("job_id", "status", "started_at").distinct().orderBy(C("started_at").desc(), "job_id").limit(20).select("job_id", "status")


@query("top11_log_tail", "SELECT change_id, path FROM file_changes ORDER BY change_id DESC LIMIT 50")
def top11(spark, sf):
    return read_table(spark, sf, "file_changes").select("change_id", "path").orderBy(C("change_id").desc()).limit(50).orderBy("change_id")


@query("agg14_doctor", f"""WITH {_LIVE}, p AS (SELECT DISTINCT path FROM live WHERE path IS NOT NULL), l AS (SELECT DISTINCT id, link FROM (SELECT id, unnest(links) link FROM live) WHERE link IS NOT NULL),
x AS (SELECT path, max(synced_at) synced FROM vault_notes WHERE path IS NOT NULL GROUP BY path), f AS (SELECT path, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) h, max(modified_at) m FROM file_changes WHERE corpus = 'vault' AND path IS NOT NULL GROUP BY path)
SELECT 'missing_id' "check", count(*) n FROM vault_notes WHERE id IS NULL UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM vault_notes WHERE id IS NOT NULL AND path IS NOT NULL GROUP BY id HAVING count(DISTINCT path) > 1)
UNION ALL SELECT 'shared_path', count(*) FROM (SELECT path FROM live WHERE path IS NOT NULL GROUP BY path HAVING count(DISTINCT id) > 1) UNION ALL SELECT 'bad_path', count(*) FROM live WHERE path IS NULL OR NOT ends_with(path, '.md')
UNION ALL SELECT 'broken_links', count(*) FROM l WHERE link NOT IN (SELECT path FROM p) UNION ALL SELECT 'broken_supersedes', count(*) FROM live WHERE supersedes IS NOT NULL AND NOT starts_with(supersedes, 'path:') AND supersedes NOT IN (SELECT id FROM live)
UNION ALL SELECT 'bad_dates', count(*) FROM live WHERE (valid_from IS NOT NULL AND {_READ.format('valid_from')} IS NULL) OR (valid_until IS NOT NULL AND {_READ.format('valid_until')} IS NULL)
UNION ALL SELECT 'wiki_leakage', count(*) FROM live WHERE {_WIKI} UNION ALL SELECT 'no_project', count(*) FROM live WHERE project IS NULL
UNION ALL SELECT 'unregistered_project', count(DISTINCT project) FROM live WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM index_jobs WHERE project IS NOT NULL)
UNION ALL SELECT 'not_indexed', count(*) FROM f LEFT JOIN x USING (path) WHERE h <> '' AND synced IS NULL UNION ALL SELECT 'outdated_index', count(*) FROM f JOIN x USING (path) WHERE h <> '' AND synced < m
UNION ALL SELECT 'index_of_deleted', count(*) FROM p JOIN f USING (path) WHERE h = ''""")
def agg14(spark, sf):
    """Numbers of issues by check: identities, paths, links, dates, generated notes, registry and freshness of the index."""
    from tidemark import api

    jobs = read_table(spark, sf, "index_jobs").filter("project is not null").select("project").distinct()
    d = read_table(spark, sf, "file_changes").filter("corpus = 'vault' and path is not null")
    return api.doctor(read_table(spark, sf, "vault_notes"), jobs, d)


QUERIES["cmp08_doctor"], SQL["cmp08_doctor"] = agg14, SQL["agg14_doctor"]


@query("agg15_pack_totals", "SELECT source, count(*) items, coalesce(sum(length(text)), 0) chars FROM documents GROUP BY source")
def agg15(spark, sf):
    return read_table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query("cmp02_checkpoint_merge", """SELECT id, arg_min(created_at, row_no) created_at, arg_max(coalesce(title, ''), CASE WHEN title IS NOT NULL THEN row_no ELSE -row_no END) title, max(row_no) row_no FROM vault_notes WHERE id IS NOT NULL AND doc_type = 'checkpoint' GROUP BY id""")
def cmp02(spark, sf):
    """Saves of one checkpoint merged: the first keeps its time of creation, omitted fields keep what was said last."""
    n = read_table(spark, sf, "vault_notes").filter("id is not null and doc_type = 'checkpoint'")
    return n.groupBy("id").agg(F.min_by("created_at", "row_no").alias("created_at"), F.coalesce(F.max_by("title", F.when(C("title").isNotNull(), C("row_no"))), F.lit("")).alias("title"), F.max("row_no").alias("row_no"))


@query("cmp04_checkpoint_query", f"WITH {_LIVE} SELECT id FROM live WHERE doc_type = 'checkpoint' AND coalesce(status, 'active') = 'active'")
def cmp04(spark, sf):
    return live_notes(read_table(spark, sf, "vault_notes"), ["status", "doc_type"]).filter("doc_type = 'checkpoint' and coalesce(status, 'active') = 'active'").select("id")


SECTION, ITEM = 30_000, 2_000


@query("fn17_section_budget", f"""WITH RECURSIVE d AS (SELECT project, doc_id, least(length(text), {ITEM}) sz, row_number() OVER (PARTITION BY project ORDER BY doc_id) i FROM documents WHERE text IS NOT NULL AND project IS NOT NULL),
w AS (SELECT project, 0::bigint i, 0::bigint total, false stop, NULL::bigint doc_id FROM (SELECT DISTINCT project FROM d) UNION ALL SELECT d.project, d.i, CASE WHEN w.stop OR (w.total + d.sz > {SECTION} AND {SECTION} - w.total < 100) THEN w.total ELSE w.total + least(d.sz, {SECTION} - w.total) END,
 w.stop OR (w.total + d.sz > {SECTION} AND {SECTION} - w.total < 100), CASE WHEN w.stop OR (w.total + d.sz > {SECTION} AND {SECTION} - w.total < 100) THEN NULL ELSE d.doc_id END FROM w JOIN d ON d.project = w.project AND d.i = w.i + 1) SELECT project, doc_id FROM w WHERE doc_id IS NOT NULL""")
def fn17(spark, sf):
    """Documents of a project in order while its budget lasts: one is cut to 2,000 characters or to what is left, and
    the section ends when less than 100 are. Sizes are summed over ranges of ids first and inside a range then, so a
    project with a third of all documents is no single task; all before the budget ends keep their whole size, so the
    greedy fold equals a running sum."""
    d = read_table(spark, sf, "documents").filter("text is not null and project is not null").select("project", "doc_id", F.least(F.length("text"), F.lit(ITEM)).alias("sz")).withColumn("range", F.expr("doc_id div 1024"))
    per = d.groupBy("project", "range").agg(F.sum("sz").alias("in_range"))
    before = Window.partitionBy("project").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0))).filter(C("offset") < SECTION).select("project", "range", "offset")
    inside = Window.partitionBy("project", "range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = d.join(per, ["project", "range"]).withColumn("total", C("offset") + F.coalesce(F.sum("sz").over(inside), F.lit(0)))
    fits = (C("total") + C("sz") <= SECTION) | ((C("total") < SECTION) & (F.lit(SECTION) - C("total") >= 100))
    return run.filter(fits).select("project", "doc_id")


def _pack_items(spark, sf):
    """Sections of every project's pack: its decisions and issues, its code docs, and its live notes' titles."""
    d = read_table(spark, sf, "documents").filter("project is not null").withColumn("s", F.lower(F.trim("source")))
    texts = d.select(F.concat_ws("/", "project", F.when(C("s") == "code_docs", "code").otherwise("decisions")).alias("section"), C("s").alias("source"), "path", C("doc_id").alias("ord"), C("text").alias("content"))
    n = live_notes(read_table(spark, sf, "vault_notes"), ["path", "project", "title"]).filter("project is not null")
    return texts.unionByName(n.select(F.concat_ws("/", "project", F.lit("overview")).alias("section"), F.lit("vault").alias("source"), "path", F.lit(0).cast("long").alias("ord"), C("title").alias("content")))


def _cut_sql(x: str, most: str) -> str:
    """The semantic cut of a text in SQL."""

    def last(b):
        """Place of a boundary's last occurrence, counted from 0; -1 if there is none."""
        code, part = " || ".join(f"chr({ord(c)})" for c in b), f"substr({x}, 1, ({most})::bigint + {len(b)})"
        return f"CASE WHEN instr({part}, {code}) = 0 THEN -1 ELSE length({part}) - instr(reverse({part}), reverse({code})) - {len(b) - 1} END"

    at = f"greatest({', '.join(last(b) for b in packs.BOUNDARIES)})"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE substr({x}, 1, CASE WHEN {at} >= 0 THEN {at} ELSE {most} END::bigint) || E'\\n... [truncated]\\n' END"


_PACKED = f"""WITH RECURSIVE {_LIVE}, doc AS (SELECT *, lower(trim(source)) s FROM documents WHERE project IS NOT NULL),
it AS (SELECT concat_ws('/', project, CASE WHEN s = 'code_docs' THEN 'code' ELSE 'decisions' END) section, s AS source, path, doc_id AS ord, text AS content FROM doc
 UNION ALL SELECT concat_ws('/', project, 'overview'), 'vault', path, 0, title FROM live WHERE project IS NOT NULL),
un AS (SELECT * FROM it WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY section, CASE WHEN path IS NOT NULL THEN concat_ws(':', source, path) ELSE sha256(content) END ORDER BY ord, path NULLS FIRST, content, source) = 1),
d AS (SELECT section, source, path, length(content) size, {_cut_sql('content', str(packs.MAX_ITEM))} t1, row_number() OVER (PARTITION BY section ORDER BY ord, path NULLS FIRST, content, source) i FROM un),
w AS (SELECT section, 0::bigint i, 0::bigint total, false stop, NULL::varchar source, NULL::varchar path, false AS cut, NULL::varchar content FROM (SELECT DISTINCT section FROM d)
 UNION ALL SELECT section, i, total + CASE WHEN stop2 THEN 0 ELSE length(t2) END, stop2, source, path, length(t2) <> size, CASE WHEN stop2 THEN NULL ELSE t2 END FROM (SELECT *, CASE WHEN stop2 OR fits THEN t1 ELSE {_cut_sql('t1', f'({packs.MAX_SECTION} - total)')} END t2 FROM (
  SELECT d.*, w.total, w.total + length(d.t1) <= {packs.MAX_SECTION} fits, w.stop OR (w.total + length(d.t1) > {packs.MAX_SECTION} AND {packs.MAX_SECTION} - w.total < {packs.LEAST_ROOM}) stop2 FROM w JOIN d ON d.section = w.section AND d.i = w.i + 1))),
pk AS (SELECT * FROM w WHERE content IS NOT NULL)"""


@query("cmp06_context_pack", _PACKED + " SELECT section, (row_number() OVER (PARTITION BY section ORDER BY i) - 1)::int pos, source, path, cut, sha256(content) AS content FROM pk")
def cmp06(spark, sf):
    """What the packs of all projects hold, with where it comes from."""
    return packs.compose(_pack_items(spark, sf)).withColumn("content", F.sha2("content", 256))


@query("cmp06_diagnostics", _PACKED + """ SELECT section, given, coalesce(kept, 0) kept, coalesce(cuts, 0) AS cut, coalesce(chars, 0) chars FROM (SELECT section, count(*) given FROM it GROUP BY section)
 LEFT JOIN (SELECT section, count(*) kept, count_if(cut) cuts, sum(length(content)) chars FROM pk GROUP BY section) USING (section)""")
def cmp06_diagnostics(spark, sf):
    items = _pack_items(spark, sf)
    return packs.diagnostics(items, packs.compose(items))


@query("fn16_semantic_cut", f"SELECT doc_id, {_cut_sql('text', '600')} AS text FROM documents")
def fn16(spark, sf):
    from tidemark.operators.packs import cut_semantically

    d = read_table(spark, sf, "documents").select("doc_id", "text")

    def run(frames):
        for pdf in frames:
            yield pdf.assign(text=[None if t is None else cut_semantically(t, 600) for t in pdf["text"]])

    return d.mapInPandas(run, "doc_id long, text string")


@query("fn23_note_repair", f"""WITH {_FRONT} SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN nl IS NULL THEN '---' || chr(10) || 'id: doc-' || doc_id || chr(10) || '---' || chr(10) || chr(10) || text
 WHEN regexp_matches(head, '(?m)^id:[ \t]*\\S') THEN text WHEN head IS NOT NULL THEN '---' || nl || head || nl || 'id: doc-' || doc_id || substr(text, opening + e) END AS text FROM fh""")
def fn23(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")

    def run(frames):
        for pdf in frames:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                try:
                    out.append(None if t is None else markdown.repair_note(t, f"doc-{i}"))
                except ValueError:
                    out.append(None)
            yield pdf.assign(text=out)

    return d.mapInPandas(run, "doc_id long, text string")


@query("cmp09_stamp_project", "SELECT row_no, split_part(path, '/', 1) project FROM vault_notes WHERE path IS NOT NULL AND project IS NULL")
def cmp09(spark, sf):
    """Notes without project and the one their path gives."""
    return read_table(spark, sf, "vault_notes").filter("path is not null and project is null").select("row_no", F.split_part("path", F.lit("/"), F.lit(1)).alias("project"))


@query("cmp10_supersede_stamps", f"WITH {_LIVE} SELECT a.id AS new_id, b.id AS old_id FROM live a JOIN live b ON a.supersedes = b.id WHERE b.superseded_by IS DISTINCT FROM a.id")
def cmp10(spark, sf):
    """Pairs in which the older note doesn't name the newer one yet."""
    n = live_notes(read_table(spark, sf, "vault_notes"), ["supersedes", "superseded_by"])
    old = n.select(C("id").alias("old_id"), C("superseded_by").alias("said"))
    return n.join(old, C("supersedes") == C("old_id")).filter(~C("said").eqNullSafe(C("id"))).select(C("id").alias("new_id"), "old_id")


_MOVE = f"""{_LIVE}, home AS (SELECT project old, CASE WHEN project = (SELECT min(project) FROM live WHERE project IS NOT NULL) THEN NULL ELSE (SELECT min(project) FROM live WHERE project IS NOT NULL) END new FROM (SELECT DISTINCT project FROM live WHERE project IS NOT NULL)),
mv AS (SELECT id, path, project, links, new, new || substr(path, length(split_part(path, '/', 1)) + 1) target FROM live JOIN home ON old = project WHERE path IS NOT NULL AND new IS NOT NULL AND contains(path, '/')),
tg AS (SELECT target, count(*) n FROM mv GROUP BY target), busy AS (SELECT DISTINCT path FROM live WHERE path IS NOT NULL AND id NOT IN (SELECT id FROM mv))"""


@query("cmp12_migration_plan", f"""WITH {_MOVE} SELECT 'move' step, id, target AS subject, CASE WHEN n > 1 OR target IN (SELECT path FROM busy) THEN 'collision' END warning FROM mv JOIN tg USING (target)
UNION ALL SELECT 'stamp', id, new, CASE WHEN split_part(path, '/', 1) <> project THEN 'path of another project' END FROM mv
UNION ALL SELECT DISTINCT 'link', l.id, l.link, CASE WHEN mv.path IS NULL THEN 'missing' END FROM (SELECT id, unnest(links) link FROM live) l LEFT JOIN mv ON mv.path = l.link WHERE mv.path IS NOT NULL OR (l.id IN (SELECT id FROM mv) AND l.link NOT IN (SELECT path FROM live WHERE path IS NOT NULL))""")
def cmp12(spark, sf):
    """The plan that moves every project into the first one: notes with their new places, projects to be stamped, links to
    be written anew, with what stands in the way."""
    from tidemark import api

    n = live_notes(read_table(spark, sf, "vault_notes"), ["path", "project", "links"])
    return api.migration_plan(n, n.filter("project is not null").agg(F.min("project").alias("new")))


@query("cmp14_projects", "SELECT DISTINCT project FROM index_jobs ORDER BY project")
def cmp14(spark, sf):
    return read_table(spark, sf, "index_jobs").select("project").distinct().orderBy("project")


@query("cmp15_register", "SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(project)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') key, '**/*.md' include, false code_indexing FROM documents WHERE project IS NOT NULL")
def cmp15(spark, sf):
    """A registry row per project with the default settings."""
    return read_table(spark, sf, "documents").filter("project is not null").select(project_key(C("project")).alias("key"), F.lit(P.INCLUDE_GLOBS[0]).alias("include"), F.lit(False).alias("code_indexing")).distinct()


_KNOWN = "CASE lower(trim(language)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"


@query("cmp16_config_merge", f"""WITH st AS (SELECT DISTINCT project AS key FROM documents WHERE project IS NOT NULL), g AS (SELECT split_part(file_path, '/', 1) AS key, list_sort(list_distinct(list(trim(lower(language))))) languages, bool_or({_KNOWN} IS NULL) bad FROM code_chunks WHERE language IS NOT NULL GROUP BY 1)
SELECT key, '**/*.md' include, coalesce(bad IS NOT NULL AND NOT bad, false) code_indexing, CASE WHEN NOT bad THEN array_to_string(languages, ',') ELSE '' END languages, CASE WHEN bad THEN 'unknown language' END error FROM st LEFT JOIN g USING (key)""")
def cmp16(spark, sf):
    """Settings of the projects after flags that turn code indexing on for the languages they have; other fields stay, and
    flags with an unknown language change nothing."""
    from tidemark import api

    stored = read_table(spark, sf, "documents").filter("project is not null").select(C("project").alias("key")).distinct()
    stored = stored.select("key", F.array(F.lit(P.INCLUDE_GLOBS[0])).alias("include"), F.lit(False).alias("code_indexing"), F.array().cast("array<string>").alias("languages"))
    c = read_table(spark, sf, "code_chunks").filter("language is not null")
    given = c.groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("key")).agg(F.array_sort(F.collect_set(F.trim(F.lower("language")))).alias("languages"))
    flags = given.select("key", F.lit(None).cast("array<string>").alias("include"), F.lit(True).alias("code_indexing"), "languages")
    return api.merge_settings(stored, flags).select("key", F.array_join("include", ",").alias("include"), "code_indexing", F.array_join("languages", ",").alias("languages"), "error")


@query("str08_incremental_sync", "SELECT path, m modified_at FROM (SELECT path, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) h, max(modified_at) m FROM file_changes WHERE corpus = 'vault' AND path IS NOT NULL GROUP BY path) WHERE h <> ''")
def str08(spark, sf):
    """A table of notes after two syncs: of what was on disk in the first half of time, and of what is there at the end."""
    d = read_table(spark, sf, "file_changes").filter("corpus = 'vault' and path is not null").withColumn("at", F.unix_micros(C("arrived_at").cast("timestamp")))
    half = d.join(F.broadcast(d.agg(F.expr("(min(at) + max(at)) div 2").alias("half"))), C("at") <= C("half"))  # one row
    held = lambda rows: rows.groupBy("path").agg(F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s")).filter("s.content_hash is not null").select("path", C("s.modified_at").alias("modified_at"), C("s.content_hash").alias("digest"))
    t = T.SnapshotTable(spark, f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}", "path", 16)
    for listing in (held(half), held(d)):
        watch.sync_snapshot(t, listing, lambda dirty: dirty.select("path", "modified_at", "digest"))
    return t.read().select("path", "modified_at")


@query("str08_stream_upserts", "SELECT path, nullif(arg_max(coalesce(content_hash, ''), (modified_at, change_id)), '') content_hash FROM file_changes WHERE path IS NOT NULL GROUP BY path")
def str08_stream(spark, sf):
    """The newest state of each path, in a table that a stream of changes is upserted into."""
    at, name = f"{sf}/file_changes.parquet", "file_changes.parquet"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(at)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(at).schema)
    stream = reader.parquet(at) if folder else reader.option("pathGlobFilter", name).parquet(sf)
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream.filter("path is not null").select("path", F.struct("modified_at", "change_id").alias("version"), "content_hash")
    watch.stream_upserts(rows, f"{root}/table", "path", "version", f"{root}/log").awaitTermination()
    return T.SnapshotTable(spark, f"{root}/table").read().select("path", "content_hash")


@query("src02_default_globs", "SELECT * FROM (VALUES ('include', '**/*.md'), ('exclude', '**/node_modules/**'), ('exclude', '**/target/**'), ('exclude', '**/.git/**')) t(kind, pattern)")
def src02(spark, sf):
    return spark.createDataFrame([("include", g) for g in P.INCLUDE_GLOBS] + [("exclude", g) for g in P.EXCLUDE_GLOBS], "kind string, pattern string")


def _help():
    """Usage and purpose of the tools."""
    import inspect

    from tidemark import api

    found = {n: f for n, f in vars(api).items() if inspect.isfunction(f) and f.__module__ == api.__name__ and f.__doc__}
    return {n: f"usage: {n}({', '.join(inspect.signature(f).parameters)})\n\n{' '.join(f.__doc__.split())}\n" for n, f in found.items()}


@query("src11_help_texts", "SELECT * FROM (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in _help().items()) + ") t(command, content)")
def src11(spark, sf):
    """Help texts of the tools as a source of context packs."""
    return files.help_texts(spark, _help())


@query("set05_section_concat", "SELECT 'decisions' section, doc_id FROM documents WHERE trim(lower(source)) = 'vault_export' UNION ALL SELECT 'code', doc_id FROM documents WHERE trim(lower(source)) = 'code_docs'")
def set05(spark, sf):
    """Sources of a pack's sections, one after the other."""
    d = read_table(spark, sf, "documents").withColumn("s", F.lower(F.trim("source")))
    part = lambda name, source: d.filter(C("s") == source).select(F.lit(name).alias("section"), "doc_id")
    return part("decisions", "vault_export").unionByName(part("code", "code_docs"))


_BLANK = "[\\s\\v\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: What ends a line, as Python sees it.
_ENDS = "\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


@query("fn05_long_blocks", f"""WITH RECURSIVE l AS (SELECT doc_id, string_split_regex(regexp_replace(text, '({_ENDS})$', ''), '{_ENDS}') ls FROM documents WHERE strlen(text) > {markdown.CHUNK_BYTES}),
c AS (SELECT doc_id, ls, len(ls) n, list_transform(ls, lambda x, i: list_sum(list_transform(ls[1:i], lambda y: strlen(y) + 1))) cum FROM l),
w AS (SELECT doc_id, 0 part, 0::bigint a, least(len(list_filter(cum, lambda x: x < {markdown.CHUNK_BYTES})) + 1, n) z FROM c
 UNION ALL SELECT doc_id, part + 1, b, least(len(list_filter(cum, lambda x: x < coalesce(cum[b], 0) + {markdown.CHUNK_BYTES})) + 1, n) FROM (
  SELECT w.doc_id, part, cum, n, greatest(CASE WHEN greatest(len(list_filter(cum, lambda x: x < coalesce(cum[a], 0) + {markdown.OVERLAP_FROM})), a + 1) < z THEN greatest(len(list_filter(cum, lambda x: x < coalesce(cum[a], 0) + {markdown.OVERLAP_FROM})), a + 1) ELSE z END, a + 1) b FROM w JOIN c USING (doc_id) WHERE z < n))
SELECT doc_id, part, regexp_replace(array_to_string(ls[a + 1:z], chr(10)), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS text FROM w JOIN c USING (doc_id)""")
def fn05(spark, sf):
    """Texts larger than a chunk, cut at lines with an overlap."""
    d = read_table(spark, sf, "documents").filter(F.octet_length("text") > markdown.CHUNK_BYTES).select("doc_id", "text")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = [(i, n, p) for i, t in zip(pdf["doc_id"], pdf["text"]) for n, p in enumerate(markdown.cut_lines(t))]
            yield pd.DataFrame(out, columns=["doc_id", "part", "text"]).astype({"part": "int32"})

    return d.mapInPandas(run, "doc_id long, part int, text string")


def _fails_on_control(texts, dim):
    if any("\x00" in t or "\x07" in t for t in texts):
        raise ValueError("control character")
    return embed.hashed_words(texts, dim)


@query("emb02_whole_documents")
def emb02(spark, sf):
    """Documents of which every chunk was embedded, by a provider that refuses control characters."""
    chunks = markdown.note_chunks(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").filter("error is null")
    keyed = chunks.select(F.struct("doc_id", "chunk_index").alias("chunk"), "text")
    got = embed.embed_texts(keyed, "chunk", "text", 32, _fails_on_control).select("chunk.doc_id", "chunk.chunk_index", "error")
    return embed.whole_documents(got, "doc_id").select("doc_id", "chunk_index")


@query("str01_note_events", "SELECT change_id, path, CASE WHEN content_hash IS NULL THEN 'removed' ELSE 'written' END AS event FROM file_changes WHERE corpus = 'vault' AND ends_with(path, '.md') AND NOT contains(path, '.bak') AND NOT contains(path, '/logs/')")
def str01(spark, sf):
    d = read_table(spark, sf, "file_changes").filter(C("corpus") == "vault").filter(C("path").endswith(".md") & ~C("path").contains(".bak") & ~C("path").contains("/logs/"))
    return d.select("change_id", "path", F.when(C("content_hash").isNull(), "removed").otherwise("written").alias("event"))


_BUSY = """jb AS (SELECT DISTINCT project, epoch_us(started_at) s, epoch_us(finished_at) + 3000000 e FROM index_jobs WHERE finished_at IS NOT NULL AND project IS NOT NULL AND started_at <= finished_at),
jm AS (SELECT *, max(e) OVER (PARTITION BY project ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM jb), jr AS (SELECT *, sum(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM jm),
busy AS (SELECT project, min(s) s, max(e) - 3000000 e FROM jr GROUP BY project, g)"""


@query("str07_second_tries", f"""WITH {_BURST}, {_BUSY}, a AS (SELECT project, dirty_since, epoch_us(last_event) + 3000000 AS asks FROM b), w AS (SELECT a.*, coalesce(max(CASE WHEN e > asks THEN ceil((e - asks) / 3000000) END), 0)::bigint again FROM a LEFT JOIN busy ON busy.project = a.project AND s <= asks GROUP BY ALL)
SELECT project, dirty_since, make_timestamp(asks + again * 3000000) fires_at, (again + 1)::int tries FROM w""")
def str07(spark, sf):
    """When each burst's run gets its turn: a project that is busy is asked again every three seconds."""
    jobs = read_table(spark, sf, "index_jobs").filter("project is not null").select("project", "started_at", "finished_at")
    return watch.requeue(bursts(spark, sf), jobs, "project")


@query("cmp03_checkpoint_load", f"""WITH {_LIVE}, t AS (SELECT path, max(title) title FROM live WHERE path IS NOT NULL GROUP BY path)
SELECT DISTINCT checkpoint_path, l.path, t.path IS NOT NULL AS found, t.title, substr(trim(l.preview, ' '), 1, 400) preview FROM linked_notes l LEFT JOIN t ON t.path = l.path""")
def cmp03(spark, sf):
    known = live_notes(read_table(spark, sf, "vault_notes"), ["path", "title"]).filter("path is not null").groupBy(C("path").alias("p")).agg(F.max("title").alias("title"))
    links = read_table(spark, sf, "linked_notes").select("checkpoint_path", "path", F.substring(F.trim("preview"), 1, 400).alias("preview"))
    return links.join(known, C("path") == C("p"), "left").select("checkpoint_path", "path", C("p").isNotNull().alias("found"), "title", "preview").distinct()


@query("cmp05_session_start", f"WITH {_LIVE} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END folder, coalesce(nullif(status, ''), 'active') status, count(*) \"count\" FROM live GROUP BY ALL")
def cmp05(spark, sf):
    from tidemark import api

    return api.session_hook("session_start", None, live_notes(read_table(spark, sf, "vault_notes"), ["path", "status", "created_at"]))[0]


@query("cmp11_project_list", f"WITH {_LIVE}, j AS (SELECT project, count(DISTINCT job_id) jobs FROM index_jobs GROUP BY project), n AS (SELECT project, count(*) notes FROM live WHERE project IS NOT NULL GROUP BY project) SELECT project, coalesce(notes, 0) notes, coalesce(jobs, 0) jobs FROM n FULL JOIN j USING (project)")
def cmp11(spark, sf):
    n = live_notes(read_table(spark, sf, "vault_notes"), ["project"]).filter("project is not null").groupBy("project").agg(F.count("*").alias("notes"))
    j = read_table(spark, sf, "index_jobs").groupBy("project").agg(F.countDistinct("job_id").alias("jobs"))
    return n.join(j, "project", "full").select("project", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("jobs", F.lit(0)).alias("jobs"))
