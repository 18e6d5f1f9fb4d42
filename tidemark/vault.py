"""One vault on disk: writing, importing and locating notes. These are single-file operations of the driver; whatever
looks at many notes is a DataFrame operator."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from tidemark.functions.text import import_folder
from tidemark.operators.markdown import split_front_matter

BACKUPS = 5
INTERNAL = (".index", ".trash", "wiki")
#: Names of files with rules for agents.
RULE_FILES = (".cursorrules", ".windsurfrules", ".clinerules", ".rules")


class Conflict(RuntimeError):
    """Somebody else changed what was to be written."""


def etag(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def note_path(root: str, path: str) -> Path:
    """Place of a note; ValueError for paths that are absolute, leave the vault or aren't Markdown."""
    p = path.replace("\\", "/")
    parts = p.split("/")
    if not p or p.startswith("/") or ".." in parts or not p.endswith(".md") or parts[0].lower() in INTERNAL:
        raise ValueError(f"not a note's path: {path}")
    return Path(root, *[x for x in parts if x not in ("", ".")])


def _replace(at: Path, data: bytes) -> None:
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(f".{at.name}.{uuid.uuid4().hex}.tmp")
    tmp.write_bytes(data)
    os.replace(tmp, at)


def _backup(at: Path, most: int = BACKUPS) -> None:
    """A copy beside the note; the oldest beyond ``most`` go."""
    old = sorted(at.parent.glob(f"{at.name}.bak.*"), key=lambda p: (p.stat().st_mtime_ns, p.name), reverse=True)
    for p in old[most - 1 :]:
        p.unlink()
    shutil.copy2(at, at.with_name(f"{at.name}.bak.{time.time_ns()}"))


def front_matter_text(fields: dict) -> str:
    lines = []
    for k, v in fields.items():
        if v is None:
            continue
        lines += [f"{k}:", *[f"  - {x}" for x in v]] if isinstance(v, list) else [f"{k}: {str(v).lower() if isinstance(v, bool) else v}"]
    return "---\n" + "\n".join(lines) + "\n---\n\n"


def merge_metadata(known: dict | None, given: dict, project: str, now: str) -> dict:
    """Fields of a write: given ones win, known ones stay, defaults fill. Another project's note is a conflict; a
    confidence outside 0..1 is dropped."""
    known = known or {}
    if known.get("project") not in (None, project):
        raise Conflict(f"note belongs to {known['project']}")
    out = {"id": known.get("id") or str(uuid.uuid4()), "project": project, "status": "active", "created_at": now} | known | {k: v for k, v in given.items() if v is not None}
    out["updated_at"] = now
    try:
        if not 0 <= float(out.get("confidence", 0)) <= 1:
            del out["confidence"]
    except (TypeError, ValueError):
        del out["confidence"]
    return out


def write_note(root: str, path: str, content: str, mode: str, project: str, now: str, supersedes: str | None = None, **given) -> dict:
    """Create, append or replace a note with audit fields; an existing one is backed up first. ``supersedes`` names a
    note that is stamped as superseded by this one."""
    at = note_path(root, path)
    if mode not in ("create", "append", "replace"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "create" and at.exists():
        raise FileExistsError(path)
    old = at.read_text(encoding="utf-8") if at.exists() else ""
    known, _, error = split_front_matter(old)
    if error:
        raise ValueError(error)
    if supersedes:
        other = note_path(root, supersedes)
        theirs, body, wrong = split_front_matter(other.read_text(encoding="utf-8"))
        if wrong or not (theirs or {}).get("id"):
            raise ValueError("the older note has no id")
        given["supersedes"] = theirs["id"]
    fields = merge_metadata(known, given, project, now)
    text = front_matter_text(fields) + content
    if at.exists():
        _backup(at)
    # Appending keeps what is there and adds the text with a block of its own.
    _replace(at, ((old.rstrip("\n") + "\n\n" + text) if mode == "append" and old else text).encode())
    if supersedes:
        _backup(other)
        _replace(other, (front_matter_text(theirs | {"status": "superseded", "superseded_by": fields["id"], "updated_at": now}) + body).encode())
    return {"path": path, "id": fields["id"], "etag": etag(at.read_bytes())}


class Documents:
    """Create, write, rename and delete notes, guarded by etags."""

    def __init__(self, root: str):
        self.root = root

    def read(self, path: str) -> tuple[str, str]:
        data = note_path(self.root, path).read_bytes()
        return data.decode(), etag(data)

    def _guard(self, at: Path, expected: str | None) -> None:
        if expected is not None and etag(at.read_bytes()) != expected:
            raise Conflict(str(at))

    def create(self, path: str, text: str) -> str:
        at = note_path(self.root, path)
        if at.exists():
            raise FileExistsError(path)
        _replace(at, text.encode())
        return etag(text.encode())

    def write(self, path: str, text: str, expected: str) -> str:
        at = note_path(self.root, path)
        self._guard(at, expected)
        _backup(at)
        _replace(at, text.encode())
        return etag(text.encode())

    def rename(self, path: str, to: str, expected: str | None = None) -> None:
        at, new = note_path(self.root, path), note_path(self.root, to)
        self._guard(at, expected)
        if new.exists():
            raise FileExistsError(to)
        new.parent.mkdir(parents=True, exist_ok=True)
        os.replace(at, new)

    def delete(self, path: str, expected: str | None = None) -> str:
        """Moves the note into the trash; returns its place there."""
        at = note_path(self.root, path)
        self._guard(at, expected)
        gone = Path(self.root, ".trash", f"{time.time_ns()}-{at.name}")
        gone.parent.mkdir(exist_ok=True)
        os.replace(at, gone)
        return str(gone)


def importable(name: str) -> bool:
    """Markdown and rule files."""
    return name.endswith(".md") or name.startswith(RULE_FILES[:3]) or name == RULE_FILES[3]


def import_documents(source: str, workspace: str, root: str, organise: bool = False, link: bool = False) -> list[str]:
    """Bring a file, or all Markdown and rule files below a folder, into the vault; returns their places there. A copy keeps
    its folder in the workspace, or with ``organise`` goes to the folder of its kind; ``link`` leaves a note there instead,
    which names the file relative to itself. A name that is taken gets a number."""
    src, out = Path(source), []
    files = [src] if src.is_file() else sorted(p for p in src.rglob("*") if p.is_file())
    for file in (f for f in files if importable(f.name)):
        inside = file.resolve().relative_to(Path(workspace).resolve()) if file.resolve().is_relative_to(Path(workspace).resolve()) else Path(file.name)
        kind = import_folder(inside.as_posix())
        folder = Path(root, kind) if organise or link else Path(root, inside.parent)
        name = file.name if file.name.endswith(".md") else f"{file.name}.md"
        at, n = folder / name, 1
        while at.exists():
            at, n = folder / f"{name.removesuffix('.md')}-{n}.md", n + 1
        if link:
            target = Path(os.path.relpath(file.resolve(), folder.resolve())).as_posix()
            data = front_matter_text({"memory_version": 1, "id": str(uuid.uuid4()), "type": kind, "link": target}).rstrip("\n") + "\n"
            _replace(at, data.encode())
        else:
            _replace(at, file.read_bytes())
        out.append(at.relative_to(root).as_posix())
    return out


def linked_content(note: str, fields: dict | None, body: str, allowed: list[str]) -> str:
    """Text of the file a note points to, relative to itself, if it lies in an allowed folder, links followed; else the
    note's own. Absolute targets and URIs are none."""
    target = (fields or {}).get("link")
    if not isinstance(target, str) or not target or target.startswith("/"):
        return body
    at = Path(note).parent.joinpath(target).resolve()
    if not any(at.is_relative_to(Path(a).resolve()) for a in allowed):
        return body
    try:
        return at.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return body


def resolve_scope(scope: str, home: str) -> str:
    """Vault folder of a scope: a path is made canonical, any other word gets a private folder named by its hash."""
    if not scope.strip() or len(scope.encode()) > 512:
        raise ValueError("a scope has 1 to 512 bytes")
    if scope.startswith((".", "~", "/")):
        return str(Path(scope).expanduser().resolve())
    return str(Path(home, "scopes", hashlib.sha256(scope.encode()).hexdigest()))


def resolve_project(name: str, projects: list[str], redirects: dict[str, str]) -> str | None:
    """Key of a project: as written, in any case, or where a chain of redirects ends; circles end nowhere."""
    seen: set[str] = set()
    while name not in projects:
        alike = [p for p in projects if p.lower() == name.lower()]
        if alike:
            return alike[0]
        if name in seen or name not in redirects:
            return None
        seen.add(name)
        name = redirects[name]
    return name


def locate_project(cwd: str, roots: dict[str, str]) -> str | None:
    """Project whose root is the longest prefix, by path components, of a folder."""
    at = Path(cwd)
    inside = [(len(Path(r).parts), k) for k, r in roots.items() if at.is_relative_to(r)]
    return max(inside)[1] if inside else None


def may_delete(path: str, data_home: str) -> bool:
    """Only folders strictly below the data folder, and never a link, are deleted."""
    p, home = Path(path), Path(data_home).resolve()
    return p.exists() and not p.is_symlink() and p.resolve() != home and p.resolve().is_relative_to(home)


class Config:
    """A JSON file with a revision: a write names the revision it has read."""

    def __init__(self, path: str):
        self.path = Path(path)

    def read(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {"revision": 0}

    def update(self, expected: int, **given) -> dict:
        """Only the given fields change; None leaves a field as it is."""
        now = self.read()
        if now["revision"] != expected:
            raise Conflict(f"revision is {now['revision']}")
        new = now | {k: v for k, v in given.items() if v is not None} | {"revision": expected + 1}
        _replace(self.path, json.dumps(new).encode())
        return new


@contextmanager
def index_lock(root: str):
    """One writer per index: held while the block runs; raises Conflict if another process has it."""
    import fcntl

    Path(root).mkdir(parents=True, exist_ok=True)
    with open(Path(root, "index.lock"), "a+") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            f.seek(0)
            raise Conflict(f"held by {f.read() or 'another process'}") from None
        f.truncate(0)
        f.write(str(os.getpid()))
        f.flush()
        try:
            yield
        finally:
            f.truncate(0)
            fcntl.flock(f, fcntl.LOCK_UN)


class Jobs:
    """Jobs from queued over running to an end that stays."""

    NEXT = {"queued": ("running", "cancelled"), "running": ("running", "succeeded", "failed", "cancelled")}

    def __init__(self):
        self.rows: dict[str, dict] = {}

    def submit(self, kind: str) -> str:
        ident = str(uuid.uuid4())
        self.rows[ident] = {"job_id": ident, "kind": kind, "status": "queued", "progress": 0}
        return ident

    def move(self, ident: str, status: str, progress: int | None = None) -> dict:
        row = self.rows[ident]
        if status not in self.NEXT.get(row["status"], ()):
            raise Conflict(f"{row['status']} job can't become {status}")
        row |= {"status": status} | ({"progress": max(0, min(100, progress))} if progress is not None else {})
        return dict(row)


def list_argument(text: str) -> list[str]:
    """Comma-separated values, trimmed, none empty, each once."""
    return list(dict.fromkeys(x for x in (y.strip() for y in re.split(r"[,\n]", text)) if x))
