"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.functions.timestamps import parse_instant, utc_text


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(column(F.col("c"))).collect()]


@pytest.mark.parametrize(
    "column,cases",
    [
        (P.status_shown, {None: True, "": True, "active": True, "draft": True, "done": False, "Active": False}),
        (P.in_wiki, {"wiki\\page.md": True, "./Wiki/page.md": True, "wiki-notes/page.md": False, "docs/wiki.md": False}),
        (P.prefers_text_search, {"bounded-recall": True, "rules/api": True, "status superseded": True, "what is it, really?": False, "": False, "a b c d": False, None: False}),
        (P.language_of_path, {"a/b.RS": "rust", "x.py": "python", "x.PY": None, "x.hpp": "cpp", "Makefile": None}),
        (P.language_name, {" Go ": "go", "c++": "cpp", "cobol": None}),
        (T.link_targets, {"[a](docs/test.md#x) [b](http://g.com) [c](#top) [d](mailto:q)": ["docs/test.md"], "": [], None: None}),
        (T.normal_path, {"a/./b/../c": "a/c", "../a": None, "/a": None, "a\\b": "a/b"}),
        (T.folder_chain, {"a/b/c.md": ["a", "a/b"], "c.md": []}),
        (T.first_heading, {"x\n## Title \ny": "Title", "none": None, "#\n": None}),
        (T.checkpoint_name_ok, {"": False, "../escape": False, "a/b": False, ".hidden": False, "name with spaces": False, "ok-1.2": True, None: False}),
        (T.relation_name_ok, {"related_to": True, "Related To": False, "calls-symbol": False}),
        (T.note_path_ok, {"a/b.md": True, "/a.md": False, "a/../b.md": False, "a.txt": False, None: False}),
        (T.import_category, {"README.md": "guides", "adr/1.md": "decisions", "docs/api/x": "api", "x.cursorrules": "rules", "roadmap.md": "architecture", "CHANGELOG.md": "artifacts", "x.md": "docs"}),
        (T.sql_literal, {"it's": "'it''s'"}),
        (T.project_key, {" My Project! ": "my-project"}),
        (T.uri_path, {"file:///a%20b/c+d": "/a b/c+d", "http://x": None}),
        (T.json_ok, {"{}": True, "{": False, None: False}),
    ],
)
def test_values(spark, column, cases):
    assert one(spark, column, *cases) == list(cases.values())


def test_instants(spark):
    cases = {"2020-01-01T00:00:00Z": "2020-01-01T00:00:00Z", "2020-01-01": "2020-01-01T00:00:00Z", "2024-03-01T01:30:00+05:30": "2024-02-29T20:00:00Z", "2023-02-29": None, "not-a-date": None, "": None, None: None, "2024/01/01": None, "2024-01-01T25:00:00Z": None, " 2024-01-01": None}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, lambda c: utc_text(parse_instant(c)), *cases) == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_links_are_resolved_from_the_note(spark):
    df = spark.createDataFrame([("a/b/c.md", "../x.md"), ("a/c.md", "./y/z.md"), ("c.md", "../../q.md")], "p string, l string")
    assert [r[0] for r in df.select(T.resolve_link(F.col("p"), F.col("l"))).collect()] == ["a/x.md", "a/y/z.md", "q.md"]


def test_recall_gate(spark):
    rows = [("active", None, None, None, None), ("done", True, None, None, None), ("active", None, None, "2020-01-01", 0.9), ("active", True, None, "2020-01-01", 0.1), (None, None, "", "", 0.2)]
    df = spark.createDataFrame(rows, "s string, p boolean, f string, u string, c double")
    gate = P.recallable(*[F.col(x) for x in "spfuc"], "2024-01-01T00:00:00Z", 0.5)
    assert [r[0] for r in df.select(gate).collect()] == [True, False, False, True, False]
    assert one(spark, lambda c: P.language_enabled(c, []), "x") == [True] and one(spark, lambda c: P.language_enabled(c, ["rs", "py"]), "python", "go", None) == [True, False, False]


def test_cutting_keeps_room_for_the_marker(spark):
    got = one(spark, lambda c: T.cut_text(c, F.lit(100)), "x" * 100, "y" * 101, None)
    assert got[0] == "x" * 100 and got[1] == "y" * 82 + T.MARKER and len(got[1]) == 99 and got[2] is None


def test_globs():
    import re

    hit = lambda g, p: bool(re.match(P.glob_regex(g), p))
    assert hit("**/*.md", "a.md") and hit("**/*.md", "x/y/a.md") and not hit("*.md", "x/a.md") and hit("a?c/[x]", "abc/[x]")
