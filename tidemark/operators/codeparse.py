"""Code files to items (functions, types, docs of modules) and relation hints.

Python is read by its own parser, Ruby line by line, all others as tokens with matched brackets (``syntax``). A file that
doesn't close what it opens is rejected as a whole. Files run in Arrow batches, one file at a time.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import syntax

SEGMENT_CHARS, SEGMENT_OVERLAP = 1500, 200
ITEMS = "item_key string, module_path string, symbol_name string, qualified_symbol string, kind string, start_line int, end_line int, preamble string, signature string, body string"
HINTS = "source_item_key string, relation string, target string"


@dataclass
class Item:
    name: str
    kind: str
    start: int
    end: int
    container: str = ""
    preamble: str = ""
    signature: str = ""
    body: str = ""
    hints: list = field(default_factory=list)


#: Patterns of Ruby's definitions.
RUBY = [("class", re.compile(r"^\s*(?:class|module)\s+([A-Z][\w:]*)")), ("function", re.compile(r"^\s*def\s+((?:self\.)?[\w?!=]+)"))]
LANGUAGES = (*syntax.READ, "ruby", "python", "vue")


def digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def blank_ruby(source: str) -> str:
    """The source with strings and comments as spaces, lines kept, so that words count as code."""
    return re.sub(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", lambda m: " " * len(m.group()), source)


_OPENS = re.compile(r"^(?:class|module|def|if|unless|case|while|until|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b")


def parse_ruby(source: str) -> list[Item]:
    """Classes, modules and methods, each up to the ``end`` that closes it; SyntaxError if one has none."""
    lines, code = source.split("\n"), blank_ruby(source).split("\n")
    found, open_ = [], []
    for i, line in enumerate(code):
        kind, name = next(((k, m.group(1)) for k, p in RUBY if (m := p.match(line))), (None, None))
        bare = line.strip()
        depth = len(_OPENS.findall(bare)) - bool(re.search(r"\bend\s*$", bare) and _OPENS.search(bare))
        for _ in range(depth):
            open_.append((kind, name, i))
            kind = None
        if re.match(r"end\b", bare):
            if not open_:
                raise SyntaxError("end without beginning")
            k, n, at = open_.pop()
            if k:
                found.append(_ruby_item(lines, code, k, n, at, i))
        elif kind and not depth:
            found.append(_ruby_item(lines, code, kind, name, i, i))
    if open_:
        raise SyntaxError("no end")
    return sorted(found, key=lambda x: (x.start, -x.end))


def _ruby_item(lines, code, kind, name, at, end) -> Item:
    top = at
    while top > 0 and lines[top - 1].lstrip().startswith("#"):
        top -= 1
    item = Item(name, kind, at + 1, end + 1, "", "\n".join(lines[top:at]), lines[at], "\n".join(lines[at : end + 1]))
    item.hints = calls("\n".join(code[at + 1 : end]))
    return item


def parse_python(source: str) -> list[Item]:
    """SyntaxError (or its kin) where the source isn't Python. Functions and classes at any depth; containers are the
    classes around."""
    lines = source.split("\n")
    found: list[Item] = []

    def visit(node, container):
        for n in ast.iter_child_nodes(node):
            inside = container
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                above = syntax.doc_above(source, sum(len(x) + 1 for x in lines[: n.lineno - 1]))
                doc = n.body[0] if isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str) else None
                said = ast.get_source_segment(source, doc) if doc else None
                signature = "\n".join(lines[n.lineno - 1 : max(n.lineno, n.body[0].lineno - 1)])
                item = Item(n.name, kind, n.lineno, n.end_lineno, container, "\n".join(x for x in (above, said) if x), signature, "\n".join(lines[n.lineno - 1 : n.end_lineno]))
                found.append(item)
                if kind == "class":
                    inside = f"{container}.{n.name}".lstrip(".")
            visit(n, inside)

    visit(ast.parse(source), "")
    return found


def calls(code: str) -> list[str]:
    names = re.findall(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::))*[A-Za-z_$][\w$]*)\s*\(", code)
    return sorted({n for n in names if n.split(".")[-1].split("::")[-1] not in syntax.NOT_CALLS})


def _smallest(items: list[tuple], line: int, last: int, otherwise: str) -> str:
    """Key of the smallest item around some lines."""
    around = [(z - a, key) for a, z, key in items if a <= line and last <= z]
    return min(around)[1] if around else otherwise


def parse_file(language: str, path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Items and hints in the order of ITEMS and HINTS. Vue files give the items of their scripts, without hints. Items are
    qualified by their module: the path for most languages, the package in Go, the modules inside the file in Rust."""
    if language == "vue":
        return _parse_vue(path, source), []
    module = re.sub(r"\.[^./\\]+$", "", path).replace("\\", "/").replace("/", "::")
    qualify = lambda m, name: f"{m}::{name}" if m and name else m or name
    items, hints = [], []
    if language in ("python", "ruby"):
        found = parse_python(source) if language == "python" else parse_ruby(source)
        for it in found:
            name = ".".join(x for x in (it.container, it.name) if x)
            key = digest(language, path, module, it.kind, name)
            items.append((key, module, it.name, qualify(module, name), it.kind, it.start, it.end, it.preamble, it.signature, it.body))
            hints += [(key, "calls_symbol", f"{language}-symbol:{c}") for c in it.hints]
        if language == "python":
            spans = [(i[5], i[6], i[0]) for i in items]
            for n in ast.walk(ast.parse(source)):
                what = "uses" if isinstance(n, (ast.Import, ast.ImportFrom)) else "calls_symbol" if isinstance(n, ast.Call) else None
                if what:
                    text = ast.get_source_segment(source, n if what == "uses" else n.func) or ""
                    owner = _smallest(spans, n.lineno, n.end_lineno, digest(language, path, "module"))
                    hints.append((owner, what, f"python-{'import' if what == 'uses' else 'symbol'}:{text.strip()}"))
        return items, sorted(set(hints))
    src = syntax.scan(source, language)
    spans = []
    for d in syntax.READ[language](src):
        own = {"rust": d.module, "go": d.module}.get(language, module)
        name = d.identity if d.kind == "module_doc" else ".".join(x for x in (d.container, d.name) if x)
        key = digest(language, path, own, d.kind, d.identity or name)
        text = d.prefix if d.kind == "module_doc" else d.prefix + source[d.start : d.end]
        signature = "" if d.kind == "module_doc" else source[d.start : src.tokens[d.body].end] if d.body is not None else text
        first = d.first if d.first is not None and language in ("rust", "go") else d.start
        items.append((key, own, d.name, qualify(own, name), d.kind, src.line(first), src.line(d.end - 1), d.preamble, signature, text))
        spans.append((first, d.end, key, d))
    imports = {"rust": "rust-use", "go": "go-import"}.get(language, f"{language}-import")
    said = [(at, "uses", f"{imports}:{x}") for at, x in syntax.imported(src)]
    said += [(at, "calls_symbol", f"{language}-symbol:{x}") for at, x in syntax.called(src, _names(src, spans))]
    hints += [(key, what, x) for key, what, x in _owned(spans, said, digest(language, path, "module"))]
    if language == "rust":
        hints += [(k, "implements", f"rust-trait:{m.group(1)}") for _, _, k, d in spans if d.kind == "impl" and (m := re.match(r"impl (.+) for ", d.name))]
    return items, sorted(set(hints))


def _names(src: syntax.Source, spans: list) -> set:
    """Places of the names of functions where they are defined, and of what interfaces ask for."""
    starts = [t.start for t in src.tokens]
    out: set = set()
    for a, z, _, d in spans:
        i = bisect_left(starts, d.start)
        if d.kind == "function":
            stop = d.body if d.body is not None else bisect_left(starts, z)
            out |= {t.start for t in src.tokens[i:stop] if t.text == d.name.split("::")[-1]}
        elif d.kind == "interface" and (brace := next((k for k in range(i, len(starts)) if src.is_(k, "{")), None)) is not None:
            out |= {src.tokens[k].start for k in syntax._top(src, brace + 1, src.match[brace]) if src.is_(k + 1, "(")}
    return out


def _owned(spans: list, said: list, otherwise: str):
    """Hints with the key of the smallest item around their places; spans lie inside each other or apart."""
    edges, around, n = sorted(spans, key=lambda x: (x[0], -x[1])), [], 0
    for at, what, x in sorted(said):
        while n < len(edges) and edges[n][0] <= at:
            around.append(edges[n])
            n += 1
        # Items that end before a place end before all later ones.
        while around and around[-1][1] <= at:
            around.pop()
        yield next((e[2] for e in reversed(around) if at < e[1]), otherwise), what, x


def _parse_vue(path: str, source: str) -> list[tuple]:
    """Items of all scripts of a component, at its lines; a segment of one may hold a part of its script only."""
    blocks = list(re.finditer(r"<script\b([^>]*)>(.*?)</script>", source, re.S))
    if not blocks:
        return [] if re.search(r"<(?:template|style)\b", source) else parse_file("typescript", path, source)[0]
    out = []
    for m in blocks:
        shift = source[: m.start(2)].count("\n")
        typed = re.search(r"lang=[\"']tsx?[\"']", m.group(1))
        out += [(*i[:5], i[5] + shift, i[6] + shift, *i[7:]) for i in parse_file("typescript" if typed else "javascript", path, m.group(2))[0]]
    return out


def _parser(which: int, columns: str):
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for row, path, language, text in zip(pdf["row"], pdf["path"], pdf["language"], pdf["text"]):
                try:
                    out += [(row, *x, None) for x in parse_file(language, path or "", text or "")[which]]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    out.append((row, *[None] * len(names), type(e).__name__))
            yield pd.DataFrame(out, columns=["row", *names, "error"]).astype({n: "Int32" for n in names if n.endswith("_line")})

    return run


def _rows(files: DataFrame, row: str, path: str, language: str, text: str) -> DataFrame:
    return files.select(F.col(row).cast("string").alias("row"), F.col(path).alias("path"), F.col(language).alias("language"), F.col(text).alias("text")).filter(F.col("language").isin(*LANGUAGES))


def code_items(files: DataFrame, row: str, path: str, language: str, text: str) -> DataFrame:
    """Items of each file; one that can't be read gives one row with ``error``. Unknown languages give nothing."""
    return _rows(files, row, path, language, text).mapInPandas(_parser(0, ITEMS), f"row string, {ITEMS}, error string")


def code_hints(files: DataFrame, row: str, path: str, language: str, text: str) -> DataFrame:
    return _rows(files, row, path, language, text).mapInPandas(_parser(1, HINTS), f"row string, {HINTS}, error string").filter("error is null").drop("error")


def segment(content: str, preamble: str = "", signature: str = "", body: str | None = None, most: int = SEGMENT_CHARS, overlap: int = SEGMENT_OVERLAP) -> list[str]:
    """An item's text in segments of at most ``most`` characters (unless its head alone is longer): the head is repeated,
    the body is cut behind its last line end that fits, and neighbours share ``overlap`` characters."""
    if len(content) <= most:
        return [content]
    head = "\n".join(x for x in (preamble, signature) if x)
    rest = content if body is None else body
    rest = rest.removeprefix(signature)
    room = max(most - len(head), 1)
    shared = min(overlap, room - 1)
    parts, at = [], 0
    while True:
        end = min(at + room, len(rest))
        if end < len(rest):
            cut = rest.rfind("\n", at, end)
            end = cut + 1 if cut > at else end
        parts.append(head + rest[at:end])
        if end >= len(rest):
            return parts
        at = end - shared if end - shared > at else end


def code_segments(items: DataFrame, key: str, text: str, most: int = SEGMENT_CHARS, overlap: int = SEGMENT_OVERLAP) -> DataFrame:
    """``key, segment_index, content, content_hash`` of texts cut into segments."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("text"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = [(k, i, s) for k, t in zip(pdf["k"], pdf["text"]) for i, s in enumerate(segment(t or "", most=most, overlap=overlap))]
            yield pd.DataFrame(out, columns=["k", "segment_index", "content"]).astype({"segment_index": "int32"})

    cut = rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, segment_index int, content string")
    return cut.select(F.col("k").alias(key), "segment_index", "content", F.sha2("content", 256).alias("content_hash"))
