"""File sources: notes and code as DataFrames of path, content, size and time of change."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import EXCLUDE_GLOBS, EXCLUDED_DIRS, INCLUDE_GLOBS, MAX_FILE_BYTES, glob_regex, in_wiki, language_of_path, matches_any, outside_dirs
from tidemark.functions.text import import_category
from tidemark.session import spread

FILE_SCHEMA = "path string, size long, modified_at timestamp, content string"
#: Folders and rule files worth importing into a vault.
IMPORTABLE = ("docs", "ADR", "adr", ".cursorrules", ".windsurfrules", ".clinerules", ".rules", "architecture", "decisions")


def _files(spark: SparkSession, root: str, pattern: str, ignore: bool = False) -> DataFrame:
    """All files below a folder, hidden ones too; with ``ignore`` not those that .gitignore files leave out. Names are
    listed by the driver, contents are read by the tasks, and only if a plan asks for them.

    Folders of other file systems are listed by Spark, which leaves out hidden names and knows no ignore files."""
    if "://" in root and not root.startswith("file:"):
        return _remote_files(spark, root, pattern)
    base = "/" + root.removeprefix("file:").strip("/")
    rows = [(p, os.path.getsize(at), os.path.getmtime(at)) for p in walk_files(base, ignore) if fnmatch.fnmatch(p.rsplit("/", 1)[-1], pattern) and os.path.isfile(at := f"{base}/{p}")]
    listed = spread(spark.createDataFrame(rows, "path string, size long, modified double"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            data = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{base}/{path}", "rb") as f:
                    data.append(f.read() if size <= MAX_FILE_BYTES else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "bytes"])

    return listed.mapInArrow(read, "path string, size long, modified double, bytes binary").select("path", "size", F.timestamp_seconds("modified").alias("modified_at"), "bytes")


def _remote_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base)
    path = F.substring("path", len(base) + 2, 2**30)
    return raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("bytes"))


def walk_files(base: str, ignore: bool = False):
    """Paths of the files below a folder, in order. Folders never indexed aren't entered. With ``ignore`` the rules of all
    .gitignore files hold below where they lie, the last that fits decides, and nothing comes back from below a folder
    that is left out."""
    known: dict = {}
    for folder, folders, names in os.walk(base):
        at = os.path.relpath(folder, base).replace(os.sep, "/")
        at = "" if at == "." else f"{at}/"
        parent = at.rstrip("/").rpartition("/")[0]
        rules = known.get(f"{parent}/" if parent else "", []) if at else []
        if ignore and ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules = [*rules, *ignore_rules(f.read(), at)]
        known[at] = rules
        folders[:] = sorted(d for d in folders if d not in EXCLUDED_DIRS and not _ignored(f"{at}{d}", True, rules))
        yield from (f"{at}{n}" for n in sorted(names) if not _ignored(f"{at}{n}", False, rules))


def ignore_rules(text: str, at: str = "") -> list[tuple]:
    """Rules of an ignore file that lies in the folder ``at``: pattern, whether it takes back, whether for folders only."""
    out = []
    for line in text.splitlines():
        rule = re.sub(r"(?<!\\)\s+$", "", line)
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
        only, bare = rule.endswith("/"), rule.strip("/")
        anywhere = "/" not in rule.rstrip("/")
        pattern = glob_regex(("**/" if anywhere else "") + bare).removeprefix("^")
        out.append((re.compile("^" + re.escape(at) + pattern), back, only))
    return out


def _ignored(path: str, folder: bool, rules: list[tuple]) -> bool:
    hit = False
    for pattern, back, only in rules:
        if (folder or not only) and pattern.match(path):
            hit = not back
    return hit


def select_notes(paths: DataFrame, include=INCLUDE_GLOBS, exclude=EXCLUDE_GLOBS) -> DataFrame:
    """Of a listing with ``path`` the notes: included, not excluded, outside the generated namespace."""
    p = F.col("path")
    return paths.filter(matches_any(p, include) & ~matches_any(p, exclude) & ~in_wiki(p))


def select_code(paths: DataFrame) -> DataFrame:
    """Of a listing with ``path`` the source files: a known language, no excluded folder, not generated notes."""
    p = F.col("path")
    return paths.filter(language_of_path(p).isNotNull() & outside_dirs(p, EXCLUDED_DIRS) & ~in_wiki(p))


def read_notes(spark: SparkSession, root: str, include=INCLUDE_GLOBS, exclude=EXCLUDE_GLOBS) -> DataFrame:
    """Notes below a folder with their text; ``error`` where it isn't UTF-8."""
    return _decoded(select_notes(_files(spark, root, "*.md"), include, exclude))


def read_code(spark: SparkSession, root: str) -> DataFrame:
    """Source files below a folder; ``error`` where one is too large or not UTF-8. Ignore files hold, hidden files count."""
    return _decoded(select_code(_files(spark, root, "*", ignore=True)))


def _decoded(files: DataFrame) -> DataFrame:
    large = F.col("size") > MAX_FILE_BYTES
    ok = F.is_valid_utf8("bytes")
    error = F.when(large, "too large").when(~ok, "not UTF-8")
    return files.select("path", "size", "modified_at", F.when(error.isNull(), F.decode("bytes", "UTF-8")).alias("content"), error.alias("error"))


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """``path, modified_at, size`` of the notes, without backups and generated ones, ordered by path."""
    notes = select_notes(_files(spark, root, "*.md")).filter(~F.col("path").contains(".bak"))
    return notes.select("path", "modified_at", "size").orderBy("path")


def importable_documents(root: str) -> list[str]:
    """What a project's root has that is worth importing: known folders and rule files first, then its Markdown files."""
    names = sorted(n for n in os.listdir(root) if os.path.isfile(os.path.join(root, n)) and n.endswith(".md"))
    return [n for n in IMPORTABLE if os.path.exists(os.path.join(root, n))] + names


def import_plan(listing: DataFrame, vault: str = "vault") -> DataFrame:
    """Of the files (project, path) below projects' roots those worth importing: ``project, entry`` (what of the root they
    belong to) ``, path, copied, organised`` (places in the vault, a folder of the root) ``, link`` (what a stub there
    names)."""
    entry, name = F.split_part("path", F.lit("/"), F.lit(1)), F.element_at(F.split("path", "/"), -1)
    ruled = name.rlike(r"^\.(cursorrules|windsurfrules|clinerules)") | (name == ".rules")
    nested = F.col("path").contains("/")
    there = F.when(nested, entry.isin(*IMPORTABLE)).otherwise(entry.isin(*IMPORTABLE) | name.endswith(".md"))
    files = listing.filter(there & (name.endswith(".md") | ruled)).withColumn("entry", entry).withColumn("name", F.when(ruled & ~name.endswith(".md"), F.concat(name, F.lit(".md"))).otherwise(name))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    kind = import_category(F.col("path"))
    return files.select(
        "project", "entry", "path", F.concat(F.lit(f"{vault}/"), folder, "name").alias("copied"), F.concat_ws("/", F.lit(vault), kind, "name").alias("organised"),
        F.concat(F.lit("../" * (vault.strip("/").count("/") + 2)), "path").alias("link"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``key, name, value`` of the projects in a TOML registry; an absent file is an empty registry."""
    rows, at = [], spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        for key, config in tomllib.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())).get("projects", {}).items():
            rows += [(key, n, v if isinstance(v, str) else str(v)) for n, v in config.items()]
    return spark.createDataFrame(rows, "key string, name string, value string")


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one of the schema if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def help_texts(spark: SparkSession, commands: dict[str, str]) -> DataFrame:
    """``command, content`` of given help texts, as a source of context packs."""
    return spark.createDataFrame(sorted(commands.items()), "command string, content string")
