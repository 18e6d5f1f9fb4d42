"""Scalar text and path functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "\n... [truncated]\n"
#: Folders that imported files go to, by the first rule that fits the lower-case path: it starts with, ends
#: with or holds one of the texts.
IMPORT_RULES = (
    ("guides", "starts", ("readme",)),
    ("decisions", "starts", ("adr", "decisions")),
    ("api", "starts", ("docs/api",)),
    ("architecture", "starts", ("docs/architecture",)),
    ("rules", "ends", (".cursorrules", ".windsurfrules", ".clinerules", ".rules")),
    ("rules", "holds", ("claude.md", "gemini.md", "agent")),
    ("architecture", "holds", ("plan", "roadmap")),
    ("artifacts", "holds", ("changelog", "history", "walkthrough", "task.md", "implementation_plan", "architecture_analysis")),
)
OTHER_IMPORTS = "docs"


def sql_literal(text: Column) -> Column:
    """A text as a quoted literal of a filter string."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def link_targets(text: Column) -> Column:
    """Targets of Markdown links in order: no http, mailto and fragment-only ones, fragments cut off, none empty."""
    found = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), 2)
    kept = F.filter(found, lambda x: ~x.startswith("http") & ~x.startswith("mailto:") & ~x.startswith("#"))
    return F.filter(F.transform(kept, lambda x: F.split_part(x, F.lit("#"), F.lit(1))), lambda x: x != "")


def resolve_link(source: Column, link: Column) -> Column:
    """A link relative to the directory of the note it stands in; ``.`` and ``..`` are followed, never above the root."""
    start = F.filter(F.split(F.regexp_replace(source, r"[^/]*$", ""), "/"), lambda x: x != "")
    step = lambda at, part: F.when((part == ".") | (part == ""), at).when(part == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(part)))
    return F.array_join(F.aggregate(F.split(link, "/"), start, step), "/")


def normal_path(path: Column) -> Column:
    """Slashes, without ``.`` and ``..``; null if it is absolute or leaves its root."""
    p = F.translate(path, "\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    state = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    step = lambda s, x: F.struct(
        F.when(x == "..", F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(x))).alias("at"),
        (s["ok"] & ((x != "..") | (F.size(s["at"]) > 0))).alias("ok"),
    )
    return F.when(~p.startswith("/"), F.aggregate(parts, state, step, lambda s: F.when(s["ok"], F.array_join(s["at"], "/"))))


def folder_chain(path: Column) -> Column:
    """All folders above a path, from the outermost; none for a bare name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def first_heading(text: Column) -> Column:
    """First line that begins with ``#``, without its signs; null if it is empty or there is none."""
    head = F.get(F.filter(F.split(text, "\n"), lambda x: x.startswith("#")), F.lit(0))
    name = F.trim(F.regexp_replace(head, r"^#+", ""))
    return F.when(name != "", name)


def checkpoint_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def relation_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-z_]+$"), F.lit(False))


def note_path_ok(path: Column) -> Column:
    """Relative, no ``..``, no backslash, ends in ``.md``."""
    return F.coalesce(path.rlike(r"^[^/\\][^\\]*\.md$") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def import_category(path: Column) -> Column:
    """Folder an imported file goes to: the first of IMPORT_RULES that fits its lower-case path."""
    p = F.lower(path)
    tests = {"starts": p.startswith, "ends": p.endswith, "holds": p.contains}
    out = F.lit(OTHER_IMPORTS)
    for folder, how, words in reversed(IMPORT_RULES):
        out = F.when(reduce(lambda a, b: a | b, [tests[how](w) for w in words]), folder).otherwise(out)
    return out


def import_folder(path: str) -> str:
    """The same of one path."""
    p = path.lower()
    tests = {"starts": p.startswith, "ends": p.endswith, "holds": p.__contains__}
    return next((folder for folder, how, words in IMPORT_RULES if any(tests[how](w) for w in words)), OTHER_IMPORTS)


def preview(text: Column, length: int = 400) -> Column:
    return F.substring(F.trim(text), 1, length)


def cut_text(text: Column, most: Column) -> Column:
    """A longer text keeps ``most - 18`` characters and gets a marker of 17."""
    keep = F.greatest(most - 18, F.lit(0))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), keep), F.lit(MARKER)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identity(*parts: Column) -> Column:
    """Hash of NUL-joined parts."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def json_ok(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def uri_path(uri: Column) -> Column:
    """Path of a file URI, decoded; null for other schemes."""
    return F.when(uri.startswith("file://"), F.url_decode(F.replace(F.substring(uri, 8, 2**30), F.lit("+"), F.lit("%2B"))))


def project_key(name: Column) -> Column:
    """Suggested key: lower case, runs of other characters as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def list_values(text: Column) -> Column:
    """Values of an argument separated by commas or lines: trimmed, none empty, each once in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def scope_folder(scope: Column, home: str, cwd: str) -> Column:
    """Vault folder of a scope: an absolute or relative path is made canonical, any other word gets a private folder named
    by its hash; null for blank ones, longer ones than 512 bytes and paths above the root."""
    relative = normal_path(F.concat(F.lit(cwd.strip("/") + "/"), scope))
    place = F.when(scope.startswith("/"), normal_path(F.substring(scope, 2, 2**30))).when(scope.startswith("."), relative)
    hashed = F.concat(F.lit(f"{home}/scopes/"), F.sha2(scope, 256))
    fits = (F.trim(scope) != "") & (F.octet_length(scope) <= 512)
    return F.when(fits, F.when(scope.startswith("/") | scope.startswith("."), F.concat(F.lit("/"), place)).otherwise(hashed))


def deletable(path: Column, home: str) -> Column:
    """Whether a folder, by its canonical path, lies strictly below the data folder."""
    at = F.concat(F.lit("/"), normal_path(F.substring(path, 2, 2**30)))
    return F.coalesce(path.startswith("/") & at.startswith(home.rstrip("/") + "/"), F.lit(False))
