"""Queries of the filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.functions.timestamps import parse_instant, utc_text
from tidemark.session import read_table

NOW, LEAST = "2025-01-01T00:00:00Z", 0.5
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def notes(spark, sf):
    return read_table(spark, sf, "vault_notes")


def over(name: str, table: str, key: str, column, sql: str, out: str = "v"):
    """A scalar function over a whole table."""
    QUERIES[name] = lambda spark, sf: read_table(spark, sf, table).select(key, column().alias(out))
    SQL[name] = f"SELECT {key}, {sql} AS {out} FROM {table}"


C = F.col
over("flt01_status_gate", "vault_notes", "row_no", lambda: P.status_shown(C("status")), "status IS NULL OR status IN ('', 'active', 'draft')")


@query("flt02_recall_gate", f"""SELECT row_no FROM vault_notes WHERE (status IS NULL OR status IN ('', 'active', 'draft')) AND (coalesce(pinned, false)
 OR ((valid_from IS NULL OR valid_from = '' OR valid_from <= '{NOW}') AND (valid_until IS NULL OR valid_until = '' OR valid_until >= '{NOW}') AND (confidence IS NULL OR confidence >= {LEAST})))""")
def flt02(spark, sf):
    gate = P.recallable(C("status"), C("pinned"), C("valid_from"), C("valid_until"), C("confidence"), NOW, LEAST)
    return notes(spark, sf).filter(gate).select("row_no")


_WIKI = "lower(split_part(regexp_replace(replace({0}, '\\', '/'), '^(\\./)+', ''), '/', 1)) = 'wiki'"
_PATH = "regexp_replace({0}, '^[^/\\\\]*[/\\\\]', '')"
over("flt03_wiki_paths", "linked_notes", "link_id", lambda: P.in_wiki(C("path")), _WIKI.format("path"))
over("flt05_literals", "vault_notes", "row_no", lambda: T.sql_literal(C("title")), "'''' || replace(title, '''', '''''') || ''''")
over(
    "flt06_query_router", "search_hits", "hit_id", lambda: P.prefers_text_search(C("heading")),
    "coalesce(length(trim(heading)) BETWEEN 1 AND 48 AND len(regexp_split_to_array(trim(heading), '\\s+')) <= 3 AND regexp_full_match(trim(heading), '[\\p{L}\\p{N}\\-_./:#@\\s]+'), false)",
)
_LANG = "CASE lower(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"
over("flt09_language_enabled", "code_chunks", "id", lambda: P.language_enabled(C("language"), ["Rust", "py", "c++"]), f"coalesce({_LANG.format('language')} IN ('rust', 'python', 'cpp'), false)")
over("flt09_language_name", "code_chunks", "id", lambda: P.language_name(C("language")), _LANG.format("language"))
_OUT = lambda dirs: f"NOT list_has_any(string_split(path, '/'), {list(dirs)!r})"
_EXT = "regexp_extract({0}, '[^/]\\.([A-Za-z0-9]+)$', 1)"
_BYPATH = f"CASE WHEN lower({_EXT}) = 'rs' THEN 'rust' WHEN lower({_EXT}) = 'go' THEN 'go' ELSE CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EXTENSIONS.items()) + " END END"


@query("flt10_watched_paths", f"SELECT DISTINCT path FROM file_changes WHERE corpus = 'code' AND {_OUT(P.UNWATCHED_DIRS)} AND NOT ({_WIKI.format('path')}) AND {_BYPATH.format('path')} IS NOT NULL")
def flt10(spark, sf):
    d = read_table(spark, sf, "file_changes").filter((C("corpus") == "code") & P.outside_dirs(C("path"), P.UNWATCHED_DIRS) & ~P.in_wiki(C("path")) & P.language_of_path(C("path")).isNotNull())
    return d.select("path").distinct()


@query("flt11_cross_project_policy", """SELECT query_id, CASE WHEN count(DISTINCT project) > 1 AND bool_or(source = 'vault') AND NOT bool_and(length(project) % 2 = 0) THEN 'error' ELSE 'ok' END verdict
FROM search_hits WHERE project IS NOT NULL GROUP BY query_id""")
def flt11(spark, sf):
    """Several projects in one vault search: each must have opted in (here: those with an even name length)."""
    opted = F.length("project") % 2 == 0
    bad = (F.countDistinct("project") > 1) & F.bool_or(C("source") == "vault") & ~F.bool_and(opted)
    return read_table(spark, sf, "search_hits").filter("project is not null").groupBy("query_id").agg(F.when(bad, "error").otherwise("ok").alias("verdict"))


@query("flt12_stale_paths", f"SELECT DISTINCT path, coalesce({_WIKI.format(_PATH.format('path'))}, false) purge FROM vault_notes WHERE path IS NOT NULL")
def flt12(spark, sf):
    """Paths (inside their project) that a purge of the generated namespace takes."""
    inside = F.regexp_replace("path", r"^[^/\\]*[/\\]", "")
    return notes(spark, sf).filter("path is not null").select("path", F.coalesce(P.in_wiki(inside), F.lit(False)).alias("purge")).distinct()


@query("flt13_projection", "SELECT id, item_hash, content_hash FROM code_chunks")
def flt13(spark, sf):
    return read_table(spark, sf, "code_chunks").select("id", "item_hash", "content_hash")


over("fn02_link_targets", "documents", "doc_id", lambda: T.link_targets(C("text")), """list_filter(list_transform(list_filter(regexp_extract_all(text, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2),
 lambda x: NOT starts_with(x, 'http') AND NOT starts_with(x, 'mailto:') AND NOT starts_with(x, '#')), lambda x: split_part(x, '#', 1)), lambda x: x <> '')""")


@query("fn03_resolved_links", """WITH RECURSIVE l AS (SELECT row_no, i, path, 'x/../' || link link FROM (SELECT row_no, path, unnest(links) link, generate_subscripts(links, 1) i FROM vault_notes WHERE links IS NOT NULL)),
s AS (SELECT row_no, i, list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '') here, string_split(link, '/') todo FROM l WHERE link IS NOT NULL AND path IS NOT NULL
 UNION ALL SELECT row_no, i, CASE WHEN todo[1] IN ('.', '') THEN here WHEN todo[1] = '..' THEN here[1:len(here) - 1] ELSE list_append(here, todo[1]) END, todo[2:] FROM s WHERE len(todo) > 0)
SELECT row_no, (i - 1)::int pos, array_to_string(here, '/') target FROM s WHERE len(todo) = 0""")
def fn03(spark, sf):
    links = notes(spark, sf).select("row_no", "path", F.posexplode("links").alias("pos", "link")).filter("link is not null and path is not null")
    return links.select("row_no", "pos", T.resolve_link(C("path"), F.concat(F.lit("x/../"), C("link"))).alias("target"))


@query("fn07_normal_paths", """WITH RECURSIVE s AS (SELECT link_id, replace(path, '\\', '/') p, []::varchar[] here, true ok, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')) todo FROM (SELECT DISTINCT link_id, path FROM linked_notes)
 UNION ALL SELECT link_id, p, CASE WHEN todo[1] = '..' THEN here[1:len(here) - 1] ELSE list_append(here, todo[1]) END, ok AND (todo[1] <> '..' OR len(here) > 0), todo[2:] FROM s WHERE len(todo) > 0)
SELECT link_id, CASE WHEN ok AND NOT starts_with(p, '/') THEN array_to_string(here, '/') END v FROM s WHERE len(todo) = 0""")
def fn07(spark, sf):
    return read_table(spark, sf, "linked_notes").select("link_id", "path").distinct().select("link_id", T.normal_path(C("path")).alias("v"))


over("fn08_language_of_path", "code_chunks", "id", lambda: P.language_of_path(C("file_path")), _BYPATH.format("file_path"))


@query("fn09_folders", """SELECT DISTINCT array_to_string(string_split(file_path, '/')[1:i], '/') folder FROM (SELECT file_path, unnest(generate_series(1, len(string_split(file_path, '/')) - 1)) i FROM code_chunks WHERE file_path IS NOT NULL)""")
def fn09(spark, sf):
    return read_table(spark, sf, "code_chunks").select("file_path").distinct().select(F.explode(T.folder_chain(C("file_path"))).alias("folder")).distinct()


over("fn10_first_heading", "documents", "doc_id", lambda: T.first_heading(C("text")), "nullif(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '#'))[1], '^#+', ''), ' '), '')")
over("fn11_checkpoint_names", "vault_notes", "row_no", lambda: T.checkpoint_name_ok(C("alias")), "coalesce(regexp_full_match(alias, '[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}'), false)")
over("fn12_relation_names", "graph_edges", "row_no", lambda: T.relation_name_ok(C("relation")), "coalesce(regexp_full_match(relation, '[a-z_]+'), false)")
over("fn13_note_paths", "linked_notes", "link_id", lambda: T.note_path_ok(C("path")), "coalesce(regexp_full_match(path, '[^/\\\\][^\\\\]*\\.md') AND NOT list_contains(string_split(path, '/'), '..'), false)")


@query("fn14_import_categories", f"""WITH p AS (SELECT DISTINCT path, lower({_PATH.format('path')}) p FROM vault_notes WHERE path IS NOT NULL) SELECT path, CASE WHEN starts_with(p, 'readme') THEN 'guides' WHEN starts_with(p, 'adr') OR starts_with(p, 'decisions') THEN 'decisions'
 WHEN starts_with(p, 'docs/api') THEN 'api' WHEN starts_with(p, 'docs/architecture') THEN 'architecture' WHEN regexp_matches(p, '\\.(cursorrules|windsurfrules|clinerules|rules)$') OR contains(p, 'claude.md') OR contains(p, 'gemini.md') OR contains(p, 'agent') THEN 'rules'
 WHEN contains(p, 'plan') OR contains(p, 'roadmap') THEN 'architecture' WHEN contains(p, 'changelog') OR contains(p, 'history') OR contains(p, 'walkthrough') OR contains(p, 'task.md') THEN 'artifacts' ELSE 'docs' END category FROM p""")
def fn14(spark, sf):
    return notes(spark, sf).filter("path is not null").select("path").distinct().select("path", T.import_category(F.regexp_replace("path", r"^[^/\\]*[/\\]", "")).alias("category"))


over("fn15_previews", "documents", "doc_id", lambda: T.preview(C("text")), "substr(trim(text, ' '), 1, 400)")
_DT = lambda c: f"""CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({c} || 'T00:00:00+00:00' AS timestamptz)
 WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN try_cast({c} AS timestamptz) END"""  # noqa: E731
over("fn18_dates", "vault_notes", "row_no", lambda: utc_text(parse_instant("valid_from")), f"strftime(make_timestamp(epoch_us({_DT('valid_from')})), '%Y-%m-%dT%H:%M:%SZ')")


@query("fn19_age_lints", f"""SELECT row_no, 'old' lint FROM vault_notes WHERE epoch_us({_DT('created_at')}) < epoch_us(timestamptz '{NOW}') - 365 * 86400000000
UNION ALL SELECT row_no, 'expired' FROM vault_notes WHERE epoch_us({_DT('valid_until')}) < epoch_us(timestamptz '{NOW}')
UNION ALL SELECT row_no, 'broken_supersedes' FROM vault_notes WHERE supersedes IS NOT NULL AND supersedes <> '' AND NOT starts_with(supersedes, 'path:') AND supersedes NOT IN (SELECT id FROM vault_notes WHERE id IS NOT NULL)""")
def fn19(spark, sf):
    n, now = notes(spark, sf), F.lit(NOW).cast("timestamp")
    ids = n.select(C("id").alias("known")).filter("known is not null").distinct()
    old = n.filter(F.unix_micros(parse_instant("created_at")) < F.unix_micros(now) - 365 * 86_400_000_000).select("row_no", F.lit("old").alias("lint"))
    expired = n.filter(parse_instant("valid_until") < now).select("row_no", F.lit("expired").alias("lint"))
    named = n.filter("supersedes is not null and supersedes <> ''").filter(~C("supersedes").startswith("path:"))
    return old.unionByName(expired).unionByName(named.join(ids, C("supersedes") == C("known"), "left_anti").select("row_no", F.lit("broken_supersedes").alias("lint")))


over("fn20_json_validity", "graph_nodes", "row_no", lambda: T.json_ok(C("metadata_json")), "metadata_json IS NOT NULL AND json_valid(metadata_json)")
over("fn21_json_metadata", "code_chunks", "id", lambda: F.to_json(F.struct(C("language"), C("start_line"))), "'{\"language\":\"' || language || '\",\"start_line\":' || start_line || '}'")


@query("fn22_metadata_merge", """SELECT row_no, coalesce(status, 'active') status, coalesce(doc_type, 'note') doc_type, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END confidence, coalesce(learned_at, created_at) learned_at FROM vault_notes""")
def fn22(spark, sf):
    """Defaults where a note says nothing; a confidence outside of 0..1 is dropped."""
    return notes(spark, sf).select("row_no", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("doc_type", F.lit("note")).alias("doc_type"), F.when(C("confidence").between(0, 1), C("confidence")).alias("confidence"), F.coalesce("learned_at", "created_at").alias("learned_at"))


over("fn25_file_uris", "vault_notes", "row_no", lambda: T.uri_path(F.concat(F.lit("file:///"), F.replace(C("path"), F.lit("-"), F.lit("%2D")))), "'/' || path")
over("fn26_semantic_text", "graph_nodes", "row_no", lambda: F.concat_ws("\n", "label", "path"), "concat_ws(chr(10), label, path)")
over("fn27_project_keys", "vault_notes", "row_no", lambda: T.project_key(C("title")), "regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
over("fn28_content_hashes", "documents", "doc_id", lambda: T.content_hash(C("text")), "sha256(text)")
over("fn28_identities", "graph_edges", "row_no", lambda: T.identity(F.lit("derived"), C("extractor"), C("source_key"), C("target_key"), C("relation")), "sha256(concat_ws(chr(0), 'derived', extractor, source_key, target_key, relation))")


@query("src04_size_gate", f"SELECT file_path, count(*) FILTER (content IS NULL) unreadable, coalesce(sum(strlen(content)), 0) > {P.MAX_FILE_BYTES} too_large FROM code_chunks GROUP BY file_path")
def src04(spark, sf):
    return read_table(spark, sf, "code_chunks").groupBy("file_path").agg(F.count_if(C("content").isNull()).alias("unreadable"), (F.coalesce(F.sum(F.octet_length("content")), F.lit(0)) > P.MAX_FILE_BYTES).alias("too_large"))


@query("src06_secret_names", "SELECT DISTINCT path FROM file_changes WHERE NOT regexp_matches(lower(path), '(^|/)(\\.env[^/]*|[^/]*(secret|credential|password|private_key)[^/]*|[^/]*\\.(pem|key|p12))$')")
def src06(spark, sf):
    return read_table(spark, sf, "file_changes").select("path").distinct().filter(~F.lower("path").rlike(r"(^|/)(\.env[^/]*|[^/]*(secret|credential|password|private_key)[^/]*|[^/]*\.(pem|key|p12))$"))


@query("src07_table_scan", "SELECT node_key, corpus, kind, label, path FROM graph_nodes")
def src07(spark, sf):
    return read_table(spark, sf, "graph_nodes").select("node_key", "corpus", "kind", "label", "path")
