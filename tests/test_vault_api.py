"""File operations of a vault, and the tools."""

import pytest

from tidemark import api, vault


def test_writing_and_superseding(tmp_path):
    root = str(tmp_path)
    a = vault.write_note(root, "d/a.md", "# A", "create", "p", "t1", confidence=2)
    with pytest.raises(FileExistsError):
        vault.write_note(root, "d/a.md", "x", "create", "p", "t1")
    vault.write_note(root, "d/a.md", "more", "append", "p", "t2")
    b = vault.write_note(root, "d/b.md", "# B", "create", "p", "t3", supersedes="d/a.md")
    old, body, _ = vault.split_front_matter((tmp_path / "d/a.md").read_text())
    assert old["status"] == "superseded" and old["superseded_by"] == b["id"] and "confidence" not in old and "more" in body
    assert vault.split_front_matter((tmp_path / "d/b.md").read_text())[0]["supersedes"] == a["id"]
    with pytest.raises(vault.Conflict):
        vault.write_note(root, "d/a.md", "x", "replace", "other", "t4")
    for bad in ("../x.md", "/x.md", "x.txt", "wiki/x.md", ""):
        with pytest.raises(ValueError):
            vault.note_path(root, bad)
    for i in range(8):
        vault.write_note(root, "d/b.md", str(i), "replace", "p", "t")
    assert len(list((tmp_path / "d").glob("b.md.bak.*"))) == vault.BACKUPS


def test_documents_config_lock_and_jobs(tmp_path):
    d = vault.Documents(str(tmp_path))
    tag = d.create("x.md", "one")
    new = d.write("x.md", "two", tag)
    with pytest.raises(vault.Conflict):
        d.write("x.md", "three", tag)
    d.rename("x.md", "y/z.md", new)
    assert d.read("y/z.md") == ("two", new) and "two" in open(d.delete("y/z.md")).read()
    c = vault.Config(str(tmp_path / "c.json"))
    assert c.update(0, a=1, b=None) == {"revision": 1, "a": 1} and c.update(1, b=2) == {"revision": 2, "a": 1, "b": 2}
    with pytest.raises(vault.Conflict):
        c.update(1, a=3)
    with vault.index_lock(str(tmp_path / "i")), pytest.raises(vault.Conflict), vault.index_lock(str(tmp_path / "i")):
        pass
    with vault.index_lock(str(tmp_path / "i")):
        pass
    j = vault.Jobs()
    ident = j.submit("sync")
    assert j.move(ident, "running", 140)["progress"] == 100 and j.move(ident, "cancelled")
    with pytest.raises(vault.Conflict):
        j.move(ident, "succeeded")


def test_projects_scopes_and_links(tmp_path):
    assert vault.resolve_project("A", ["b"], {"A": "x", "x": "B"}) == "b" and vault.resolve_project("a", ["b"], {"a": "c", "c": "a"}) is None
    assert vault.locate_project("/repo/x", {"r": "/repo", "s": "/repo/x/y", "t": "/repo-old"}) == "r" and vault.locate_project("/repo-old", {"r": "/repo"}) is None
    assert vault.resolve_scope("word", "/h") == vault.resolve_scope("word", "/h") != vault.resolve_scope("other", "/h")
    for bad in ("", "x" * 513):
        with pytest.raises(ValueError):
            vault.resolve_scope(bad, "/h")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.md").write_text("linked")
    note, allowed = str(tmp_path / "v/n.md"), [str(tmp_path / "in")]
    (tmp_path / "v").mkdir()
    (tmp_path / "in/out.md").symlink_to(tmp_path / "secret.md")
    (tmp_path / "secret.md").write_text("no")
    assert vault.linked_content(note, {"link": "../in/f.md"}, "own", allowed) == "linked"
    for bad in (str(tmp_path / "in/f.md"), "file://" + str(tmp_path / "in/f.md"), "../in/../x.md", "../in/out.md", "../in/none.md", "", None):
        assert vault.linked_content(note, {"link": bad}, "own", allowed) == "own"
    assert vault.linked_content(note, None, "own", []) == "own"
    for name in ("docs/api/a.md", "docs/b.md", "docs/skip.txt", ".cursorrules", "ADR/1.md", "README.md"):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(name)
    work, root = str(tmp_path / "w"), str(tmp_path / "v")
    assert vault.import_documents(f"{work}/docs", work, root) == ["docs/api/a.md", "docs/b.md"]
    assert vault.import_documents(f"{work}/docs", work, root, organise=True) == ["api/a.md", "docs/b-1.md"]
    assert [vault.import_documents(f"{work}/{n}", work, root, organise=True) for n in (".cursorrules", "ADR", "README.md")] == [["rules/.cursorrules.md"], ["decisions/1.md"], ["guides/README.md"]]
    made = vault.import_documents(f"{work}/docs/api/a.md", work, root, link=True)[0]
    fields, body, _ = vault.split_front_matter((tmp_path / "v" / made).read_text())
    assert made == "api/a-1.md" and fields["link"] == "../../w/docs/api/a.md" and fields["type"] == "api" and body == ""
    assert vault.linked_content(str(tmp_path / "v" / made), fields, body, [work]) == "docs/api/a.md"
    assert vault.may_delete(str(tmp_path / "in"), str(tmp_path)) and not vault.may_delete(str(tmp_path), str(tmp_path)) and not vault.may_delete("/", str(tmp_path))
    assert vault.list_argument(" a, b,,a ") == ["a", "b"]


def test_search_and_federation(spark):
    notes = spark.createDataFrame(
        [(1, "continuity token here", "active", None, None, None, 0.9, [1.0, 0.0]), (2, "continuity token", "done", None, None, None, 0.9, [1.0, 0.0]), (3, "other words", None, None, None, None, None, [0.0, 1.0]), (4, "continuity token", "active", None, None, None, 0.2, [1.0, 0.0])],
        "chunk_id long, text string, status string, pinned boolean, valid_from string, valid_until string, confidence double, vector array<float>",
    )
    queries = spark.createDataFrame([(1, "continuity", [0.0, 1.0]), (2, "what is other, please?", [0.0, 1.0])], "query_id long, text string, vector array<float>")
    got = [(r.query_id, r.chunk_id, r.mode) for r in api.search(notes, queries, "2024", 2, 0.8).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, "fts_prefer"), (2, 3, "hybrid"), (2, 1, "hybrid")]
    lists = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "x", 1), ("b", 1, "y", 2)], "project string, query_id int, item string, rank int")
    assert [(r.project, r.item) for r in api.federated(lists, ["b", "a", "b"]).orderBy("place").collect()] == [("a", "x"), ("b", "x"), ("b", "y")]
    assert api.federated(lists, ["b"]).count() == 2
    for bad in ([], [str(i) for i in range(9)]):
        with pytest.raises(ValueError):
            api.federated(lists, bad)
    api.check_cross_project({"a": False}, "vault")
    api.check_cross_project({"a": False, "b": False}, "code")
    with pytest.raises(PermissionError):
        api.check_cross_project({"a": True, "b": False}, "all")


def test_checkpoints(spark):
    schema = "name string, id string, created_at string, updated_at string, title string, body string"
    old = spark.createDataFrame([("c", "1", "t0", "t0", "T", "B"), ("d", "2", "t0", "t0", "T", "B")], schema)
    new = spark.createDataFrame([("c", "9", "t1", "t1", None, "B2"), ("e", "3", "t1", "t1", "E", None)], schema)
    got = {r.name: tuple(r)[1:] for r in api.checkpoint_save(old, new).collect()}
    assert got == {"c": ("1", "t0", "t1", "T", "B2"), "d": ("2", "t0", "t0", "T", "B"), "e": ("3", "t1", "t1", "E", None)}
    st = spark.createDataFrame([("c", None, "t0", ["a.md", "no.md"]), ("d", "active", "t2", [])], "name string, status string, updated_at string, links array<string>")
    notes = spark.createDataFrame([("a.md", "A", "  text ", "t", None)], "path string, title string, text string, created_at string, status string")
    assert [tuple(r) for r in api.checkpoint_load(st, notes, "c").collect()] == [(0, "a.md", True, "A", "text"), (1, "no.md", False, None, None)]
    assert [r.name for r in api.checkpoint_query(st).collect()] == ["d", "c"] and api.checkpoint_query(api.checkpoint_done(st, "c", "t3"), "done").count() == 1
    counts, newest = api.overview(notes)
    assert [tuple(r) for r in counts.collect()] == [("(root)", "active", 1)] and newest.count() == 1
    assert api.session_hook("pre_compact", st, notes).count() == 2
