"""Predicates of retrieval and indexing as Column expressions, so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses a search shows, languages with their other spellings, directories never indexed or watched.
SHOWN_STATUSES = ("", "active", "draft")
LANGUAGES = {
    "rust": "rust", "go": "go", "javascript": "javascript", "js": "javascript", "jsx": "jsx", "typescript": "typescript", "ts": "typescript",
    "tsx": "tsx", "python": "python", "py": "python", "c": "c", "cpp": "cpp", "c++": "cpp", "java": "java", "ruby": "ruby", "rb": "ruby",
    "swift": "swift", "vue": "vue",
}
EXTENSIONS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "py": "python", "pyi": "python", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "java": "java", "rb": "ruby", "swift": "swift", "vue": "vue",
}
EXCLUDED_DIRS = (".git", "target", "node_modules", "dist", "build", ".next", ".nuxt", "coverage")
UNWATCHED_DIRS = (".git", "target", "node_modules", "dist", "build")
INCLUDE_GLOBS = ("**/*.md",)
EXCLUDE_GLOBS = ("**/node_modules/**", "**/target/**", "**/.git/**")
MAX_FILE_BYTES = 512 * 1024


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def status_shown(status: Column) -> Column:
    """Null, empty, active and draft pass; case counts."""
    return status.isNull() | status.isin(*SHOWN_STATUSES)


def recallable(status: Column, pinned: Column, valid_from: Column, valid_until: Column, confidence: Column, now: str, least: float | None) -> Column:
    """The recall gate. Validity compares texts, as stored; pinned rows pass time and confidence, never status; a null
    confidence passes."""
    blank = lambda c: c.isNull() | (c == "")
    timely = (blank(valid_from) | (valid_from <= now)) & (blank(valid_until) | (valid_until >= now))
    sure = F.lit(True) if least is None else confidence.isNull() | (confidence >= least)
    return status_shown(status) & (F.coalesce(pinned, F.lit(False)) | (timely & sure))


def in_wiki(path: Column) -> Column:
    """First segment is ``wiki`` in any case, after backslashes and a leading ``./``."""
    return F.lower(F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", ""), "/")[0]) == "wiki"


def prefers_text_search(query: Column) -> Column:
    """Short keyword-like queries: 1 to 48 characters, at most 3 words, letters, digits and ``-_./:#@`` only."""
    q = F.trim(query)
    return F.coalesce(F.length(q).between(1, 48) & (F.size(F.split(q, r"\s+")) <= 3) & q.rlike(r"^[\p{L}\p{N}\-_./:#@\s]+$"), F.lit(False))


def language_name(value: Column) -> Column:
    """Canonical language of a spelling, or null."""
    return F.element_at(_map(LANGUAGES), F.lower(F.trim(value)))


def language_enabled(value: Column, configured: list[str]) -> Column:
    """An empty list or ``auto`` enables all."""
    if not configured or any(c.lower() == "auto" for c in configured):
        return F.lit(True)
    return F.coalesce(language_name(value).isin(*{LANGUAGES[c.strip().lower()] for c in configured if c.strip().lower() in LANGUAGES}), F.lit(False))


def language_of_path(path: Column) -> Column:
    """By extension: rs and go in any case, the others as written."""
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)
    return F.when(F.lower(ext) == "rs", "rust").when(F.lower(ext) == "go", "go").otherwise(F.element_at(_map(EXTENSIONS), ext))


def outside_dirs(path: Column, dirs: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in dirs]))


def glob_regex(glob: str) -> str:
    """Regular expression of a path glob with ``**``, ``*`` and ``?``."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, globs) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found
