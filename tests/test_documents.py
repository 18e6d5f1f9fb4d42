"""Notes, code, packs, embedding and file sources."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import codeparse, embed, markdown, packs
from tidemark.sources import files


def test_front_matter():
    split = markdown.split_front_matter
    assert split("---\nid: lamp 7\n---\n## Oil") == ({"id": "lamp 7"}, "## Oil", None)
    assert split("---\r\nid: 'a b'\r\nlinks:\r\n  - x\r\n  - y\r\n---\r\nB")[0] == {"id": "a b", "links": ["x", "y"]}
    assert split("plain")[0] is None and split("")[1] == ""
    for bad in ("---\nid: 1\nid: 2\n---\n", "---\nid: 1\n", "---\n: x\n---\n"):
        assert split(bad)[2]


def test_front_matter_is_yaml():
    text = "id: 7 # seven\ntitle: 'it''s'\nnote: \"a\\tb\"\nmap:\n  x: 1\n  y:\n    - p\n    - q: 2\n      r: 3\nlist: [a, 'b, c', {d: e}]\nlit: |\n  one\n    two\n\n  three\nfold: >-\n  one\n  two\nlong: first\n  second\nnone:\ntilde: ~\nflow: {a: 1,\n  b: [2, 3]}\nurl: https://x.example/a:b\nitems:\n- i\n- j\n"
    assert markdown.parse_fields(text.split("\n")) == {
        "id": "7", "title": "it's", "note": "a\tb", "map": {"x": "1", "y": ["p", {"q": "2", "r": "3"}]}, "list": ["a", "b, c", {"d": "e"}], "lit": "one\n  two\n\nthree\n", "fold": "one two",
        "long": "first second", "none": None, "tilde": None, "flow": {"a": "1", "b": ["2", "3"]}, "url": "https://x.example/a:b", "items": ["i", "j"],
    }
    for bad in ("a: 1\na: 2", "a: b: c", "\ta: 1", "a: [1", "a: 'x", "a: {b: 1, b: 2}", "a: *x", "- a", "word", "a:\n   b: 1\n  c: 2", "a: 'x' y", "a: [1] 2", "a: ]"):
        with pytest.raises(ValueError):
            markdown.parse_fields(bad.split("\n"))
    assert markdown.parse_fields(["", "# c"]) == {}


def test_repair():
    fix = lambda t: markdown.repair_note(t, "new")
    assert fix("---\nid: a\nid: b\n---\nx") == "---\nid: a\n---\nx"
    assert fix("---\nid: a\nsource: v---\n\n# Body") == "---\nid: a\nsource: v\n---\n\n# Body"
    assert fix("---\ntitle: t\n---\nx") == "---\ntitle: t\nid: new\n---\nx"
    assert fix("# x") == "---\nid: new\n---\n\n# x" and fix("---\nid: a\n---\nx") == "---\nid: a\n---\nx"
    with pytest.raises(ValueError):
        fix("---\nid: a\nno end")


def test_chunks():
    text = "intro\n\n# One\n\npara a\n\n- item\n\n  more\n- item 2\n\nTwo\n===\n\n```\n# not a heading\n```\n"
    assert markdown.chunk_markdown(text) == [("", "intro"), ("One", "# One\npara a\n\n- item\n\n  more\n- item 2"), ("Two", "Two\n===\n```\n# not a heading\n```")]
    assert markdown.chunk_markdown(None) == [] and markdown.chunk_markdown(" \n ") == []
    long = "\n".join(f"line {i:03d} " + "x" * 40 for i in range(120))
    parts = markdown.chunk_markdown(long)
    assert len(parts) > 3 and parts[0][1].split("\n")[-2:] [0] in parts[1][1]
    seen = {x for _, p in parts for x in p.split("\n")}
    assert seen == set(long.split("\n"))
    assert len(markdown.chunk_markdown("é" * 5000)) == 1


def test_chunks_as_rows(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, "---\nid: 1\nid: 2\n---\nx"), (4, "---\nid: 1\n---\n\nbody")], "d long, t string")
    got = [tuple(r) for r in markdown.note_chunks(df, "d", "t").orderBy("d").collect()]
    assert got == [(1, 0, "A", "# A\nx", None), (3, 0, None, None, "repeated field: id"), (4, 0, "", "body", None)]


RUST = """//! Module.

use std::fmt::{self, Display};

/// Greets.
/// Twice.
pub fn greet(name: &str) -> String {
    format!("{{ {}", helper(name))
}

struct User { id: u32 }

impl Display for User {
    fn fmt(&self) -> u32 { self.id.abs() }
}

mod api {
    pub fn load() { inner() }
}
"""


def by_name(items):
    return {i[3]: i for i in items}


def test_rust_items():
    items, hints = codeparse.parse_file("rust", "src/a.rs", RUST)
    got = {(i[3], i[4], i[5], i[6]) for i in items}
    assert got == {("<module_doc>", "module_doc", 1, 1), ("greet", "function", 5, 9), ("User", "struct", 11, 11), ("impl Display for User", "impl", 13, 15), ("api::load", "function", 18, 18)}
    assert by_name(items)["greet"][7] == "/// Greets.\n/// Twice." and by_name(items)["greet"][8].endswith("String {") and by_name(items)["<module_doc>"][2] == ""
    targets = {h[2] for h in hints}
    assert {"rust-symbol:helper", "rust-symbol:self.id.abs", "rust-symbol:inner", "rust-use:std::fmt::{self, Display}", "rust-trait:Display"} <= targets


def test_rust_impls_of_one_type_are_several_items():
    source = "/// Makes.\nimpl Lamp {\n fn new() -> Self { Lamp }\n}\n// plain\nimpl Lamp { fn lit(&self) -> bool { true } }\n#[cfg(test)]\npub struct Wick<T: Into<u8>> { x: T }\n"
    items, _ = codeparse.parse_file("rust", "a.rs", source)
    assert [(i[2], i[7]) for i in items] == [("impl Lamp", "/// Makes."), ("impl Lamp", ""), ("Wick", "#[cfg(test)]")]
    assert len({i[0] for i in items}) == 3
    later, _ = codeparse.parse_file("rust", "a.rs", "fn other() {}\n" + source)
    assert {i[0] for i in items} <= {i[0] for i in later}


def test_go_groups_receivers_and_package_docs():
    source = "// Package lamp lights.\npackage lamp\n\nimport (\n\t\"context\"\n\tf \"fmt\"\n)\n\n// Lamp burns.\ntype Lamp struct {\n\toil int\n}\n\ntype (\n\tAge int\n\tLit interface { Burn(a int) }\n\tSame = Age\n)\n\n// Sizes.\nconst (\n\tOne = iota\n\tTwo\n)\n\nfunc (l *Lamp) Burn(c context.Context) error {\n\treturn l.wick.Draw(c, func() struct{} { return struct{}{} })\n}\n"
    items, hints = codeparse.parse_file("go", "x/lamp.go", source)
    got = {k: (i[4], i[7]) for k, i in by_name(items).items()}
    assert got == {
        "lamp::<package_doc>": ("module_doc", ""), "lamp::Lamp": ("struct", "// Lamp burns."), "lamp::Age": ("type_alias", ""), "lamp::Lit": ("interface", ""),
        "lamp::One": ("constant", "// Sizes."), "lamp::Two": ("constant", "// Sizes."), "lamp::Lamp.Burn": ("function", ""),
    }
    assert by_name(items)["lamp::Lamp"][9].startswith("type Lamp struct")
    assert {h[2] for h in hints} == {"go-import:context", "go-import:fmt", "go-symbol:l.wick.Draw"}


@pytest.mark.parametrize(
    "language,source,names,targets",
    [
        ("typescript", "import { b } from './b';\nexport class A extends B<C> {\n  run(x: number): Promise<{a: number}> {\n    go(x);\n  }\n}\nexport const f = async (a) => {\n  return 1;\n}, g = b => h(b);\ninterface I {\n  x: string;\n}\ntype U = 'a' | 'b';\nenum E { A }\n", {"A", "A.run", "f", "g", "I", "U", "E"}, {"typescript-import:import { b } from './b';", "typescript-symbol:go", "typescript-symbol:h"}),
        ("javascript", "var p=/[\"'{]/;function a(b){if(c){d()}}class K{m(){return e(`x${1}`)}}", {"a", "K", "K.m"}, {"javascript-symbol:d", "javascript-symbol:e"}),
        ("python", "import os\n\n@deco\ndef f(a):\n    '''doc'''\n    def inner(): pass\n    return os.getcwd()\n\nclass C:\n    def m(self):\n        return f(1)\n", {"f", "inner", "C", "C.m"}, {"python-import:import os", "python-symbol:os.getcwd", "python-symbol:f"}),
        ("c", "#include <stdio.h>\n#define X(a) do { f(a); } while (0)\nstatic int add(int a, int b) {\n  return sub(a, b);\n}\nstruct P {\n  int x;\n};\ntypedef int num;\n", {"add", "P", "num"}, {"c-import:#include <stdio.h>", "c-symbol:sub"}),
        ("cpp", "template <class T> class A { public: A() : x(1) {} int get() const { return f(x); } };\nint A::go(P p) { return 1; }\n", {"A", "get", "A::go"}, {"cpp-symbol:f"}),
        ("java", "import a.B; class K { K() { init(); } void run() { work(); } public List<X> size(int x) throws E { return x; } interface I { int f(); } }", {"K", "run", "size", "I", "f"}, {"java-import:import a.B;", "java-symbol:work", "java-symbol:init"}),
        ("ruby", "class A\n  def run\n    if x\n      go(1)\n    end\n  end\nend\ndef top; end\n", {"A", "run", "top"}, {"ruby-symbol:go"}),
        ("swift", "import Foundation\nstruct S {\n  func go() -> Int { return 1 }\n}\nfunc run() { print(\"ok\") }\n", {"S", "go", "run"}, {"swift-import:import Foundation", "swift-symbol:print"}),
        ("vue", "<template/>\n<script lang=\"ts\">\nfunction hi(): void {\n  return 1\n}\n</script>\n<script>\nconst h = () => 1\n</script>\n", {"hi", "h"}, set()),
    ],
)
def test_other_languages(language, source, names, targets):
    items, hints = codeparse.parse_file(language, "dir/x.y", source)
    assert {i[3] for i in items} == {f"dir::x::{n}" for n in names} and {h[2] for h in hints} == targets


@pytest.mark.parametrize("language,source", [("rust", "fn f() {"), ("go", "func f( {"), ("java", 'class A { String s = "a; }'), ("typescript", "/* x"), ("c", "int a) {"), ("ruby", "class A\n"), ("python", "def f(:")])
def test_broken_files_are_rejected(language, source):
    with pytest.raises(SyntaxError):
        codeparse.parse_file(language, "x", source)


@pytest.mark.parametrize("language,source", [("javascript", "function a(b){return c(d)};var e=f=>g(h);" * 2000), ("c", "int a(int b){return c(d);}\n" * 3000), ("rust", "fn a(b: u8) -> u8 {c(d)}\n" * 3000), ("javascript", "a(" * 20000 + ")" * 20000), ("typescript", "const a = " * 9000), ("java", "A<" * 30000), ("go", "x := a.b().c()\n" * 6000)])
def test_large_files_take_linear_time(language, source):
    import time

    began = time.process_time()
    codeparse.parse_file(language, "x", source)
    assert time.process_time() - began < 2.5


def test_vue_lines_are_those_of_the_file():
    items, hints = codeparse.parse_file("vue", "x.vue", "<template/>\n\n<script>\nfunction hi() { go() }\n</script>")
    assert items[0][5] == 4 and hints == []


def test_items_as_rows(spark):
    df = spark.createDataFrame([("1", "a.py", "python", "def f(:"), ("2", "b.py", "python", "def g(): pass"), ("3", "c", "cobol", "x"), ("4", "d.rs", "rust", None)], "i string, p string, l string, t string")
    got = [(r.row, r.symbol_name, r.error) for r in codeparse.code_items(df, "i", "p", "l", "t").orderBy("row").collect()]
    assert got == [("1", None, "SyntaxError"), ("2", "g", None)]
    assert codeparse.code_hints(df, "i", "p", "l", "t").count() == 0


def test_segments():
    body = "fn f() {\n" + "".join(f"    let v{i} = {i};\n" for i in range(60)) + "}"
    parts = codeparse.segment("/// d\n" + body, "/// d", "fn f() {", body, 260, 40)
    assert len(parts) > 2 and all(len(p) <= 260 and p.startswith("/// d\nfn f() {") for p in parts)
    assert parts[0][-40:] in parts[1] and codeparse.segment("short") == ["short"]
    assert "".join(codeparse.segment("a" * 10, most=4, overlap=0)) == "a" * 10


def test_packs(tmp_path):
    assert packs.cut_semantically("a" * 10 + "\n\n" + "b" * 50, 30) == "a" * 10 + packs.MARKER
    assert packs.cut_semantically("x" * 40, 30) == "x" * 30 + packs.MARKER and packs.cut_semantically("é", 1) == "é"
    items = [packs.PackItem("files", "a" * 500, "p"), packs.PackItem("files", "again", "p"), packs.PackItem("x", "b" * 900), packs.PackItem("x", "c" * 900)]
    kept = packs.allocate(items, 800, 1000)
    assert [i.content[0] for i in kept] == ["a", "b"]
    assert packs.validate_manifest({"sections": [{"id": "a", "sources": [{"type": "files"}]}]}) == [] and len(packs.validate_manifest({"sections": [{"id": "a"}, {"id": "a", "sources": [{"type": "?"}]}]})) == 2
    ident = packs.write_pack(str(tmp_path / "w"), "s", {"code": kept})
    assert ident == packs.write_pack(str(tmp_path / "w"), "s", {"code": kept}) and sorted(p.name for p in (tmp_path / "w").iterdir()) == ["context-pack.md", "diagnostics.json", "sources.json"]


def test_embedding(spark):
    df = spark.createDataFrame([(i, "same words" if i % 2 else None) for i in range(40)], "i long, t string")
    got = {r.i: r for r in embed.embed_texts(df, "i", "t", 16).collect()}
    assert got[1].vector == got[3].vector and abs(sum(x * x for x in got[1].vector) - 1) < 1e-5 and got[0].vector == [0.0] * 16

    def fails(texts, dim):
        raise OSError

    bad = embed.embed_texts(df, "i", "t", 16, fails)
    assert {r.error for r in bad.collect()} == {"OSError"} and embed.whole_documents(bad, "i").count() == 0


def test_file_sources(spark, tmp_path):
    for name, text in {"a b.md": "# x", "wiki/n.md": "x", "node_modules/m.md": "x", "src/m.rs": "fn f() {}", "target/t.rs": "x", "gen/skip.py": "x", "s/x.py": "1", ".gitignore": "gen/\n*.tmp\n!gen/skip.py\n/top.py\n", "p/__init__.py": "2", "p/.hid.py": "3", "p/.gitignore": "*.go\n!keep.go\n", "p/a.go": "x", "p/q/keep.go": "4", "p/top.py": "5", "top.py": "x", "b.go": "6"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "s" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "s" / "big.py").write_bytes(b"x" * (600 * 1024))
    assert [(r.path, r.content) for r in files.read_notes(spark, str(tmp_path)).collect()] == [("a b.md", "# x")]
    code = {r.path: (r.content, r.error) for r in files.read_code(spark, str(tmp_path)).collect()}
    assert code == {"src/m.rs": ("fn f() {}", None), "s/x.py": ("1", None), "p/__init__.py": ("2", None), "p/.hid.py": ("3", None), "p/q/keep.go": ("4", None), "p/top.py": ("5", None), "b.go": ("6", None), "s/bad.py": (None, "not UTF-8"), "s/big.py": (None, "too large")}
    assert [r.path for r in files.list_documents(spark, str(tmp_path)).collect()] == ["a b.md"]
    (tmp_path / "docs").mkdir()
    (tmp_path / ".rules").write_text("x")
    assert files.importable_documents(str(tmp_path)) == ["docs", ".rules", "a b.md"]
    (tmp_path / "r.toml").write_text('[projects.p]\npath = "/x"\n')
    assert [tuple(r) for r in files.read_registry(spark, str(tmp_path / "r.toml")).collect()] == [("p", "path", "/x")]
    assert files.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_composed_packs_equal_the_fold(spark):
    import random

    rng = random.Random(4)
    rows = []
    for section, n in (("a", 400), ("b", 3), ("c", 900)):
        for i in range(n):
            text = rng.choice([None, "", "word " * rng.randrange(1, 60), "x" * rng.randrange(1, 200) + "\n\n" + "y" * rng.randrange(1, 300), f"t{i}"])
            rows.append((section, rng.choice(["files", "vault"]), rng.choice([None, f"p{rng.randrange(n)}"]), rng.randrange(3 * n), text))
    df = spark.createDataFrame(rows, "section string, source string, path string, ord long, content string").repartition(4)
    for most_item, most in ((100, 2000), (500, 300), (300, 20_000)):
        got = packs.compose(df, most_item, most)
        have = {s: [(r.pos, r.source, r.path, r.content) for r in sorted(got.filter(F.col("section") == s).collect(), key=lambda r: r.pos)] for s in "abc"}
        for s in "abc":
            mine = sorted((r for r in rows if r[0] == s and r[4]), key=lambda r: (r[3], r[2] or "", r[4], r[1]))
            want = packs.allocate([packs.PackItem(r[1], r[4], r[2]) for r in mine], most_item, most)
            assert have[s] == [(n, i.source, i.path, i.content) for n, i in enumerate(want)]
    told = {r.section: r for r in packs.diagnostics(df, packs.compose(df, 100, 2000)).collect()}
    assert told["c"].given == 900 and told["c"].chars >= 1900 and told["c"].kept >= told["c"].cut > 0
    assert packs.compose(df.limit(0)).count() == 0
