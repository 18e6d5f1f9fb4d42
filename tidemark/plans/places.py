"""Queries of files, places and settings: imports, registry, scopes, deletion, manifests, packs, guarded writes, links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import notes, packs, tables
from tidemark.plans import corpus
from tidemark.session import ensure_checkpoint_dir, read_table
from tidemark.sources import files

QUERIES, SQL = {}, {}
C = F.col


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_DIRS = "('docs', 'ADR', 'adr', 'architecture', 'decisions')"
_TEST = {"starts": "starts_with(lower(path), '{}')", "ends": "ends_with(lower(path), '{}')", "holds": "contains(lower(path), '{}')"}
_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(_TEST[how].format(w) for w in words)} THEN '{folder}'" for folder, how, words in T.IMPORT_RULES) + f" ELSE '{T.OTHER_IMPORTS}' END"
_PLAN = f"""f AS (SELECT DISTINCT split_part(path, '/', 1) project, substr(path, length(split_part(path, '/', 1)) + 2) path FROM file_changes WHERE contains(path, '/')),
p AS (SELECT project, split_part(path, '/', 1) entry, path, 'vault/' || path copied, 'vault/' || {_KIND} || '/' || regexp_extract(path, '[^/]*$', 0) organised, '../../' || path link FROM f WHERE ends_with(path, '.md') AND (NOT contains(path, '/') OR split_part(path, '/', 1) IN {_DIRS}))"""


def _listing(spark, sf):
    d = read_table(spark, sf, "file_changes").filter(C("path").contains("/")).select(F.regexp_extract("path", "^([^/]*)/", 1).alias("project"), F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    return d.distinct()


@query("src09_importable", f"WITH {_PLAN} SELECT DISTINCT project, entry FROM p")
def src09(spark, sf):
    """What each project's root has that is worth importing."""
    return files.import_plan(_listing(spark, sf)).select("project", "entry").distinct()


@query("snk12_import_plan", f"WITH {_PLAN} SELECT project, path, copied, organised, link FROM p")
def snk12(spark, sf):
    """Where files go that are imported as they lie, by kind, or as links."""
    return files.import_plan(_listing(spark, sf)).drop("entry")


@query("src10_registry", "SELECT project AS key, name, CASE name WHEN 'path' THEN '/srv/' || project ELSE 'True' END AS value FROM (SELECT DISTINCT project FROM index_jobs WHERE project IS NOT NULL), (VALUES ('path'), ('indexed')) v(name)")
def src10(spark, sf):
    """A registry of all projects, written and read."""
    entry = F.format_string('[projects."%s"]\npath = "/srv/%s"\nindexed = true\n', C("project"), C("project"))
    text = read_table(spark, sf, "index_jobs").filter("project is not null").select("project").distinct().agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("value"))
    at = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    text.coalesce(1).write.text(at)
    return files.read_registry(spark, at)


@query("fn29_list_arguments", """SELECT row_no, list_filter(l, lambda x, i: list_position(l, x) = i) AS "values" FROM (SELECT row_no, list_filter(list_transform(string_split(array_to_string(links, ' , '), ','), lambda x: trim(x)), lambda x: x <> '') l FROM vault_notes WHERE links IS NOT NULL)""")
def fn29(spark, sf):
    return read_table(spark, sf, "vault_notes").filter("links is not null").select("row_no", T.list_values(F.array_join("links", " , ")).alias("values"))


@query("cmp17_scopes", """SELECT change_id, '/home/scopes/' || sha256(project) word, '/srv/' || path absolute, '/work/' || path relative FROM file_changes""")
def cmp17(spark, sf):
    """Vault folders of words, absolute and relative paths."""
    of = lambda c: T.scope_folder(c, "/home", "/work")
    d = read_table(spark, sf, "file_changes")
    return d.select("change_id", of(C("project")).alias("word"), of(F.concat(F.lit("/srv/./x/../"), "path")).alias("absolute"), of(F.concat(F.lit("./"), "path")).alias("relative"))


@query("cmp13_deletions", "SELECT folder, starts_with(folder, '/data/') AND NOT contains(folder, '..') deletable FROM (SELECT DISTINCT unnest(['/data/' || project, '/data/../' || project, '/srv/' || project, 'data/' || project]) folder FROM index_jobs WHERE project IS NOT NULL UNION SELECT '/data')")
def cmp13(spark, sf):
    """Which folders may be deleted: only those strictly below the data folder."""
    p = read_table(spark, sf, "index_jobs").filter("project is not null").select("project").distinct()
    made = p.select(F.explode(F.array(*[F.concat(F.lit(x), "project") for x in ("/data/", "/data/../", "/srv/", "data/")])).alias("folder")).unionByName(spark.createDataFrame([("/data",)], "folder string"))
    return made.select("folder", T.deletable(C("folder"), "/data").alias("deletable"))


_TYPE = "CASE lower(trim(source)) WHEN 'vault_export' THEN 'vault_search' WHEN 'code_docs' THEN 'code_search' ELSE lower(trim(source)) END"


@query("cmp07_manifest_problems", f"SELECT DISTINCT project manifest, CASE WHEN lang IS NULL THEN 'a section has no id' ELSE 'section ' || lang || ': unknown source ' || coalesce({_TYPE}, '?') END problem FROM documents WHERE project IS NOT NULL AND (lang IS NULL OR {_TYPE} IS NULL OR {_TYPE} NOT IN {packs.SOURCES})")
def cmp07(spark, sf):
    """Manifests with a section per language and the sources of its documents."""
    d = read_table(spark, sf, "documents").filter("project is not null").withColumn("s", F.lower(F.trim("source")))
    kind = F.when(C("s") == "vault_export", "vault_search").when(C("s") == "code_docs", "code_search").otherwise(C("s"))
    return packs.manifest_problems(d.select(C("project").alias("manifest"), C("lang").alias("section"), kind.alias("type")))


@query("snk08_pack_files", corpus.SQL["cmp06_context_pack"])
def snk08(spark, sf):
    """The packs of all projects as files, read back."""
    pack = packs.store(packs.compose(corpus._pack_items(spark, sf)), f"{ensure_checkpoint_dir(spark)}/pack-{uuid.uuid4().hex}")
    return pack.withColumn("content", F.sha2("content", 256))


_VAULT = """fc AS (SELECT *, epoch_us(arrived_at) t_us FROM file_changes WHERE corpus = 'vault' AND path IS NOT NULL),
st AS (SELECT path, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) h FROM fc WHERE t_us <= (SELECT (min(t_us) + max(t_us)) // 2 FROM fc) GROUP BY path HAVING h <> ''),
rq AS (SELECT path, nullif(arg_min(coalesce(content_hash, ''), change_id), '') expected, arg_max(coalesce(content_hash, ''), (modified_at, change_id)) h FROM fc GROUP BY path HAVING h <> '')"""


@query("snk11_guarded_writes", f"""WITH {_VAULT} SELECT path, CASE WHEN outcome IN ('created', 'written') THEN new ELSE old END content_hash, outcome FROM (SELECT path, st.h old, rq.h new,
 CASE WHEN rq.path IS NULL THEN 'kept' WHEN expected IS NULL AND st.h IS NULL THEN 'created' WHEN expected = st.h THEN 'written' ELSE 'conflict' END outcome FROM rq FULL JOIN st USING (path))""")
def snk11(spark, sf):
    """Notes of the first half of time, written by clients that read what was observed first."""
    d = read_table(spark, sf, "file_changes").filter("corpus = 'vault' and path is not null").withColumn("at", F.unix_micros(C("arrived_at").cast("timestamp")))
    half = d.join(F.broadcast(d.agg(F.expr("(min(at) + max(at)) div 2").alias("half"))), C("at") <= C("half"))  # one row
    last = F.max(F.struct("modified_at", "change_id", "content_hash")).alias("s")
    held = lambda rows, *more: rows.groupBy("path").agg(last, *more).filter("s.content_hash is not null").withColumn("content_hash", C("s.content_hash")).drop("s")
    asked = held(d, F.min(F.struct("change_id", "content_hash")).alias("first")).withColumn("expected", C("first.content_hash")).drop("first")
    return tables.guarded_writes(held(half), asked)


@query("fn24_linked_contents", """WITH n AS (SELECT DISTINCT link_id, split_part(checkpoint_path, '/', 1) root, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') link, preview FROM linked_notes), t AS (SELECT path, min(text) AS content FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path)
SELECT link_id, sha256(coalesce(t.content, preview)) content_hash, t.path IS NOT NULL linked FROM n LEFT JOIN t ON t.path = n.link AND starts_with(n.link, n.root || '/')""")
def fn24(spark, sf):
    """Texts that checkpoints link, from documents of the same project."""
    n = read_table(spark, sf, "linked_notes").select(C("link_id").alias("note"), F.split_part("checkpoint_path", F.lit("/"), F.lit(1)).alias("root"), C("path").alias("link"), C("preview").alias("content")).distinct()
    d = read_table(spark, sf, "documents").select("path", C("text").alias("content"))
    return notes.linked_contents(n, d).select(C("note").alias("link_id"), F.sha2("content", 256).alias("content_hash"), "linked").distinct()
