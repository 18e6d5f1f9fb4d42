"""Source files to tokens, and tokens to definitions, for languages with braces.

A file becomes tokens with matched brackets; definitions are found by what stands around them, wherever lines break. A file
whose strings, comments or brackets don't close is rejected as a whole, as a parser would. Everything is one pass over
tokens, so a minified file of one line takes no longer than the same on many lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

WEB = ("javascript", "jsx", "typescript", "tsx")
NATIVE = ("c", "cpp", "java", "swift")
OPEN, CLOSE = "([{", ")]}"
#: Words before a bracket that make no call.
NOT_CALLS = frozenset("if for while switch match return catch sizeof function fn func class and or not in new throw await typeof elif else unless until do case yield super delete instanceof of as let const var static async extends implements throws where import".split())
#: More of these by language.
OWN_WORDS = {"go": frozenset("go defer select range type package chan map".split()), "rust": frozenset("pub crate self loop move ref mut impl".split()), "swift": frozenset("guard init self".split())} | dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), frozenset(["void", "constructor"]))
#: Words after which a slash begins a pattern and a bracketed name no definition.
KEYWORDS = NOT_CALLS | frozenset("import export default break continue package from".split())

_COMMON = r"(?P<block>/\*)|(?P<line>//[^\n]*+)|(?P<text>\"(?:\\.|[^\"\\\n])*+\")|(?P<word>[^\W\d][\w$]*+|[$#@][\w$]++|\$)|(?P<number>\d[\w.]*+)|(?P<punct>=>|->|::|\?\.|[^\w\s])"
_RULES = {
    "rust": r"(?P<raw>b?r(?P<h>#*+)\")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<life>'[a-z_]\w*+)|(?P<attr>\#!?(?=\[))|",
    "go": r"(?P<tick>`[^`]*+`)|(?P<char>'(?:\\.|[^\\'\n])++')|", "c": r"(?P<char>'(?:\\.|[^\\'\n])++')|", "cpp": r"(?P<char>'(?:\\.|[^\\'\n])++')|", "java": r"(?P<triple>\"\"\")|(?P<char>'(?:\\.|[^\\'\n])++')|",
    "swift": r"(?P<triple>\"\"\")|", "web": r"(?P<tick>`(?:\\.|[^`\\])*+`)|(?P<char>'(?:\\.|[^\\'\n])*+')|",
}
_SCAN = {k: re.compile(rule + _COMMON, re.S) for k, rule in _RULES.items()}
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*+")
#: A line for the preprocessor, with the lines it goes on in.
_DIRECTIVE = re.compile(r"#(?:[^\n\\]|\\\r?\n|\\)*+")
_SPACE = re.compile(r"\s++")


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    body: int | None = None
    module: str = ""
    container: str = ""
    preamble: str = ""
    first: int | None = None
    prefix: str = ""
    identity: str | None = None


@dataclass
class Source:
    text: str
    language: str
    tokens: list
    comments: list
    match: dict
    lines: list = field(default_factory=list)
    opened: dict = field(default_factory=dict)

    def line(self, at: int) -> int:
        """Number of the line of a place, from 1."""
        if not self.lines:
            self.lines = [0, *[m.end() for m in re.finditer("\n", self.text)]]
        return bisect_right(self.lines, at)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind in ("word", "punct")

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def skip(self, i: int) -> int:
        """The token after one, or after the bracket it opens."""
        return self.match.get(i, i) + 1


def scan(text: str, language: str) -> Source:
    """Tokens, comments and matching brackets; SyntaxError if something isn't closed."""
    rule = _SCAN["web" if language in WEB else language]
    tokens, comments, match, stack, at = [], [], {}, [], 0
    while at < len(text):
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        if language in WEB and text[at] == "/" and (not tokens or tokens[-1].text in KEYWORDS or tokens[-1].kind == "punct" and tokens[-1].text not in (")", "]", "}")) and (p := _PATTERN.match(text, at)):
            tokens.append(Token("text", p.group(), at, p.end()))
            at = p.end()
            continue
        if text[at] == "#" and language in ("c", "cpp") and (d := _DIRECTIVE.match(text, at)) and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            at = d.end()
            continue
        m = rule.match(text, at)
        if m is None:
            raise SyntaxError(f"character {at}")
        kind, end = m.lastgroup, m.end()
        if kind == "h":
            kind = "raw"
        if kind in ("block", "raw", "triple"):
            stop = {"block": "*/", "triple": '"""'}.get(kind) or '"' + m.group("h")
            end = text.find(stop, end)
            if end < 0:
                raise SyntaxError("text or comment without end")
            end += len(stop)
        if kind in ("block", "line"):
            comments.append(Token(kind, text[at:end], at, end))
        else:
            if kind == "punct" and m.group() == '"':
                raise SyntaxError("text without end")
            if kind == "punct" and m.group() in OPEN:
                stack.append(len(tokens))
            elif kind == "punct" and m.group() in CLOSE:
                if not stack or OPEN[CLOSE.index(m.group())] != tokens[stack[-1]].text:
                    raise SyntaxError("brackets don't match")
                match[stack.pop()] = len(tokens)
            tokens.append(Token(kind if kind in ("word", "number", "punct", "attr") else "text", text[at:end], at, end))
        at = end
    if stack:
        raise SyntaxError("bracket without end")
    return Source(text, language, tokens, comments, match, opened={z: a for a, z in match.items()})


def doc_above(text: str, at: int) -> str:
    """Comments, attributes and decorators on the lines right above a place, blank lines between left out."""
    lines = text[:at].split("\n")
    i = len(lines)
    while i > 0 and not lines[i - 1].strip():
        i -= 1
    end = i
    while i > 0 and (x := lines[i - 1].strip()) and (x.startswith(("@", "//", "*", "/**")) or x.endswith("*/")):
        i -= 1
    return "\n".join(x.rstrip() for x in lines[i:end])


# Rust


def rust(src: Source) -> list[Definition]:
    """Functions, structs, enums, traits and impls of the file and its modules, and the docs of modules."""
    found: list[Definition] = []
    _rust_items(src, 0, len(src.tokens), 0, len(src.text), [], found)
    return found


def _rust_items(src: Source, i: int, stop: int, begin: int, close: int, mods: list, found: list) -> None:
    pending: list = []
    inner: list = []
    heading, module, t = True, "::".join(mods), src.tokens
    notes = [c for c in src.comments if begin <= c.start < close]
    n = 0
    while True:
        here = t[i].start if i < stop else close
        while n < len(notes) and notes[n].start < here:
            c = notes[n].text
            if c.startswith("///") and not c.startswith("////") or c.startswith("/**") and not c.startswith(("/***", "/**/")):
                pending.append(notes[n])
                heading = False
            elif c.startswith(("//!", "/*!")) and heading:
                pending = []
                inner.append(notes[n])
            else:
                pending, heading = [], False
            n += 1
        if i >= stop:
            break
        if t[i].kind == "attr":
            end = src.skip(i + 1)
            pending = [] if t[i].text == "#!" else [*pending, Token("attr", src.text[t[i].start : t[end - 1].end], t[i].start, t[end - 1].end)]
            i, heading = end, False
            continue
        heading, at = False, i
        while src.is_(i, "pub", "const", "async", "unsafe", "extern", "default") or i < stop and t[i].kind == "text":
            i = src.skip(i + 1) if src.is_(i, "pub") and src.is_(i + 1, "(") else i + 1
        what = t[i].text if i < stop else ""
        kind = {"fn": "function"}.get(what, what)
        whole = what in ("fn", "struct", "enum", "trait", "impl", "mod")
        end, body, j = None, None, i
        # Other statements may hold braces before their semicolon.
        semicolon = not whole and any(src.is_(k, "use", "static", "const", "type", "let", "crate") for k in range(at, min(i + 1, stop)))
        while j < stop and end is None:
            if src.is_(j, ";"):
                end = j
            elif src.is_(j, "{") and not semicolon:
                end, body = src.match[j], j
            j = src.skip(j)
        end = stop - 1 if end is None else end
        if whole and i < stop:
            docs = [p for p in pending if p.kind != "attr"]
            if what == "mod" and src.word(i + 1):
                below = [*mods, t[i + 1].text]
                if docs:
                    found.append(_module_doc(src, docs, "::".join(below)))
                if body is not None:
                    _rust_items(src, body + 1, end, t[body].end, t[end].start, below, found)
            elif what != "mod":
                name, identity = (t[i + 1].text if i + 1 < stop else "", None) if what != "impl" else _impl_name(src, i, body if body is not None else end, end)
                found.append(Definition(name, kind, t[at].start, t[end].end, body, module, "", "\n".join(p.text.rstrip() for p in pending), pending[0].start if pending else None, identity=identity))
        # Comments inside what was passed belong to it.
        while n < len(notes) and notes[n].start < t[end].end:
            n += 1
        pending, i = [], end + 1
    if inner:
        found.append(_module_doc(src, inner, module))


def _module_doc(src: Source, docs: list, module: str, label: str = "<module_doc>") -> Definition:
    text = "\n".join(d.text.rstrip() for d in docs)
    return Definition("", "module_doc", docs[0].start, docs[-1].end, None, module, "", "", None, text, label)


def _impl_name(src: Source, i: int, body: int, end: int) -> tuple[str, str]:
    """Name of an impl, and its identity: with the names of its functions, for one type may have several."""
    j, t = i + 1, src.tokens
    if src.is_(j, "<"):
        depth = 0
        while j < body:
            depth += src.is_(j, "<") - src.is_(j, ">")
            j += 1
            if depth == 0:
                break
    where = next((k for k in range(j, body) if src.is_(k, "where")), body)
    split = next((k for k in range(j, where) if src.is_(k, "for") and not src.is_(k + 1, "<")), None)
    part = lambda a, z: src.text[t[a].start : t[z - 1].end].strip() if a < z else ""
    name = f"impl {part(j, split)} for {part(split + 1, where)}" if split else f"impl {part(j, where)}"
    members, k = [], body + 1
    while k < end:
        if src.is_(k, "fn") and src.word(k + 1):
            members.append(t[k + 1].text)
        k = src.skip(k)
    return name, f"{name}[{','.join(sorted(members))}]" if members else name


# Go


def go(src: Source) -> list[Definition]:
    """Package docs, functions, methods, types, constants and variables; each name of a group is one."""
    t, found, i, n, pending = src.tokens, [], 0, 0, []
    package = next((t[k + 1].text for k in range(len(t) - 1) if src.is_(k, "package") and src.word(k + 1)), "")

    def add(name, kind, a, z, body=None, prefix="", receiver=""):
        found.append(Definition(name, kind, t[a].start, t[z].end, body, package, receiver, "\n".join(p.text.rstrip() for p in pending), pending[0].start if pending else None, prefix))

    def spec_end(k, stop):
        """The last token of a declaration: the line ends behind it and it can end one."""
        while k < stop:
            k = src.skip(k)
            last = t[k - 1]
            if k >= stop or src.is_(k, ";") or src.line(t[k].start) > src.line(last.end - 1) and (last.kind != "punct" or last.text in CLOSE):
                return k - 1
        return stop - 1

    while i < len(t):
        while n < len(src.comments) and src.comments[n].start < t[i].start:
            pending.append(src.comments[n])
            n += 1
        end = spec_end(i, len(t))
        if src.is_(i, "package"):
            if pending:
                found.append(_module_doc(src, pending, package, "<package_doc>"))
        elif src.is_(i, "func"):
            receiver, j = "", i + 1
            if src.is_(j, "("):
                words = src.text[t[j].end : t[src.match[j]].start].split()
                receiver, j = (words[-1].lstrip("*") if words else ""), src.skip(j)
            body = next((k for k in _top(src, j, end + 1) if src.is_(k, "{") and not src.is_(k - 1, "struct", "interface")), None)
            end = src.match[body] if body is not None else end
            if src.word(j):
                add(t[j].text, "function", i, end, body, receiver=receiver)
        elif src.is_(i, "type", "const", "var"):
            what = t[i].text
            k, stop = (i + 2, src.match[i + 1]) if src.is_(i + 1, "(") else (i + 1, len(t))
            while k < stop:
                z = spec_end(k, stop)
                if src.word(k):
                    # Parameters of a type stand in brackets behind its name.
                    of = src.skip(k + 1) if src.is_(k + 1, "[") and what == "type" and src.match[k + 1] > k + 2 else k + 1
                    kind = {"const": "constant", "var": "variable"}.get(what) or {"struct": "struct", "interface": "interface"}.get(t[of].text if of < len(t) else "", "type_alias")
                    if not (what == "type" and src.is_(of, "=")):
                        add(t[k].text, kind, k, z, prefix=f"{what} ")
                        if what == "type":
                            pending = []
                k = z + 1
                while src.is_(k, ";"):
                    k += 1
                if stop == len(t):
                    break
            end = stop if stop < len(t) else k - 1
        pending = []
        while n < len(src.comments) and end < len(t) and src.comments[n].start < t[end].end:
            n += 1
        i = end + 1
    return found


def _top(src: Source, i: int, stop: int):
    """Tokens of a range, not those inside its brackets."""
    while i < stop:
        yield i
        i = src.skip(i)


# JavaScript and TypeScript


def web(src: Source) -> list[Definition]:
    """Functions, methods, classes, interfaces, enums, type aliases, and names bound to functions, at any depth."""
    t, found, classes = src.tokens, [], []
    bodies: dict = {}

    def starts(i):
        return i == 0 or src.is_(i - 1, ";", "{", "}", "export", "default", "declare", ")", "abstract", "async") or src.line(t[i].start) > src.line(t[i - 1].end - 1) and not src.is_(i - 1, "=", "(", ",", "=>", ":", "return")

    def brace(i):
        """The brace that opens a body: not one inside brackets or type arguments."""
        return next((k for k in _top(src, i, len(t)) if src.is_(k, "{", ";")), len(t))

    def body_after(i):
        """The brace behind a parameter list and a return type."""
        j = src.skip(i)
        if src.is_(j, ":"):
            j += 1
            while j < len(t) and not src.is_(j, ";", ",", ")", "=", "=>"):
                if src.is_(j, "{") and not src.is_(j - 1, ":", "|", "&", "=>", "<", ","):
                    return j
                j = src.skip(j)
            return None if not src.is_(j, "{") else j
        return j if src.is_(j, "{") else None

    def add(name, kind, a, z, body):
        found.append(Definition(name, kind, t[a].start, t[z].end, body, container=".".join(c for c, _ in classes), preamble=doc_above(src.text, t[a].start)))

    def function_value(i):
        """Last token of a function that begins here as a value, with its body; None if none does."""
        j = i + 1 if src.is_(i, "async") else i
        if src.is_(j, "function"):
            p = next((k for k in range(j, min(j + 5, len(t))) if src.is_(k, "(")), None)
            b = body_after(p) if p is not None else None
            return (src.match[b], b) if b is not None else None
        if src.is_(j, "<"):
            j = next((k for k in range(j, min(j + 60, len(t))) if src.is_(k, "(")), j)
        if not (src.is_(j, "(") or src.word(j)):
            return None
        k = src.skip(j)
        if src.is_(k, ":"):
            k = next((x for x in _top(src, k, len(t)) if src.is_(x, "=>", ";", ",", ")")), k)
        if not src.is_(k, "=>"):
            return None
        if src.is_(k + 1, "{"):
            return src.match[k + 1], k + 1
        z = k
        for x in _top(src, k + 1, len(t)):
            if src.is_(x, ";", ",", ")", "]", "}") or x > k + 1 and src.line(t[x].start) > src.line(t[z].end - 1) and t[x].kind == "word" and t[z].kind != "punct":
                break
            z = src.match.get(x, x)
        return z, None

    for i, tok in enumerate(t):
        while classes and i > classes[-1][1]:
            classes.pop()
        if tok.kind != "word" and not src.is_(i, "[", "*"):
            continue
        if src.is_(i, "class") and starts(i) and src.word(i + 1) and not src.is_(i + 1, "extends"):
            b = brace(i + 2)
            if b < len(t) and src.is_(b, "{"):
                a = i - 1 if src.is_(i - 1, "abstract") else i
                add(t[i + 1].text, "class", a, src.match[b], b)
                classes.append((t[i + 1].text, src.match[b]))
                bodies[b] = True
        elif src.is_(i, "interface") and starts(i) and src.word(i + 1) and src.is_((b := brace(i + 2)), "{"):
            add(t[i + 1].text, "interface", i, src.match[b], b)
        elif src.is_(i, "enum") and src.word(i + 1) and src.is_(i + 2, "{"):
            add(t[i + 1].text, "enum", i - 1 if src.is_(i - 1, "const") else i, src.match[i + 2], i + 2)
        elif src.is_(i, "type") and starts(i) and src.word(i + 1) and (src.is_(i + 2, "=", "<")):
            z = i + 2
            for x in _top(src, i + 2, len(t)):
                if src.is_(x, ";") or src.line(t[x].start) > src.line(t[z].end - 1) and t[z].kind != "punct" and t[x].kind == "word":
                    break
                z = src.match.get(x, x)
            add(t[i + 1].text, "type_alias", i, z + 1 if src.is_(z + 1, ";") else z, None)
        elif src.is_(i, "function") and (starts(i) or src.is_(i - 1, "async") and starts(i - 1)):
            j = i + 2 if src.is_(i + 1, "*") else i + 1
            p = next((k for k in range(j + 1, len(t)) if src.is_(k, "(", "{")), None)
            if src.word(j) and p is not None and src.is_(p, "(") and (b := body_after(p)) is not None:
                add(t[j].text, "function", i - 1 if src.is_(i - 1, "async") else i, src.match[b], b)
        elif src.is_(i, "const", "let", "var"):
            k = i + 1
            while src.word(k):
                name, a = t[k].text, k
                eq = next((x for x in _top(src, k + 1, len(t)) if src.is_(x, "=", ";", ",", ")", "}", "in", "of", "{")), len(t))
                if not src.is_(eq, "="):
                    break
                if got := function_value(eq + 1):
                    add(name, "function", a, got[0], got[1])
                    k = got[0] + 1
                else:
                    k = next((x for x in _top(src, eq + 1, len(t)) if src.is_(x, ",", ";", ")", "}", "const", "let", "var") or x > eq + 1 and src.line(t[x].start) > src.line(t[x - 1].end - 1) and t[x].kind == "word"), len(t))
                if not src.is_(k, ","):
                    break
                k += 1
        elif tok.kind == "word" and tok.text not in KEYWORDS and (src.is_(i + 1, "(") or src.is_(i + 1, "<")) and not src.is_(i - 1, ".", "?.", "function", "*=", "=", "new", "return", "("):
            # A method: a name, parameters and a body, as a member of a class or an object.
            p = i + 1
            if src.is_(p, "<"):
                p = next((x for x in _top(src, p, min(p + 60, len(t))) if src.is_(x, "(", ";", "{")), p)
            if src.is_(p, "(") and (b := body_after(p)) is not None:
                a = i
                while src.is_(a - 1, "public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "*", "abstract"):
                    a -= 1
                if src.is_(a - 1, "{", "}", ";", ",", ")") or src.line(t[a].start) > src.line(t[a - 1].end - 1):
                    add(tok.text, "function", a, src.match[b], b)
    return found


# C, C++, Java and Swift


def native(src: Source) -> list[Definition]:
    """Classes, structs, enums, interfaces and type definitions with a body, and functions, at any depth."""
    t, found, lang = src.tokens, [], src.language
    kinds = {"c": {"struct": "struct", "enum": "enum"}, "cpp": {"struct": "struct", "enum": "enum", "class": "class"}, "java": {"class": "class", "interface": "interface"}, "swift": {"class": "class", "struct": "class", "enum": "class", "extension": "class", "actor": "class"}}[lang]

    def head(i):
        """First token of the statement a token is in."""
        while i > 0 and not src.is_(i - 1, ";", "{", "}") and not (src.is_(i - 1, ":") and src.is_(i - 2, "public", "private", "protected")):
            if src.is_(i - 1, ")"):
                i = src.opened[i - 1]
            elif lang == "swift" and src.line(t[i].start) > src.line(t[i - 1].end - 1):
                return i
            else:
                i -= 1
        return i

    def add(name, kind, a, z, body):
        found.append(Definition(name, kind, t[a].start, t[z].end, body, preamble=doc_above(src.text, t[a].start)))

    for i, tok in enumerate(t):
        if tok.kind != "word":
            continue
        if tok.text in kinds and not src.is_(i - 1, ".", "enum", "<", ","):
            j = i + 2 if src.is_(i + 1, "class", "struct") else i + 1
            b = next((k for k in _top(src, j, len(t)) if src.is_(k, "{", ";", "(", "=", ")", ",")), len(t)) if src.word(j) else j
            if b < len(t) and src.is_(b, "{"):
                a = head(i) if lang in ("java", "swift") else i
                add(t[j].text if src.word(j) else "", kinds[tok.text], a, src.match[b], b)
        elif tok.text == "typedef" and lang in ("c", "cpp"):
            z = next((k for k in _top(src, i, len(t)) if src.is_(k, ";")), None)
            if z is not None:
                names = [k for k in _top(src, i + 1, z) if src.word(k)]
                add(t[names[-1]].text if names else "", "type_alias", i, z, None)
        elif tok.text == "func" and lang == "swift" and (src.word(i + 1) or i + 1 < len(t)):
            p = next((k for k in range(i + 1, len(t)) if src.is_(k, "(", "{")), None)
            b = next((k for k in _top(src, p, len(t)) if src.is_(k, "{", "}", "func", "var", "let")), None) if p is not None else None
            if b is not None and src.is_(b, "{"):
                add(t[i + 1].text, "function", head(i), src.match[b], b)
        elif lang in ("c", "cpp", "java") and src.is_(i + 1, "(") and tok.text not in KEYWORDS:
            j = src.skip(i + 1)
            while src.is_(j, "const", "noexcept", "override", "final", "throws", "&", "->", ",", ".") or src.word(j) and src.is_(j - 1, "throws", ",", "->", ".") or src.is_(j, "::"):
                j += 1
            if lang == "cpp" and src.is_(j, ":") and not src.is_(i - 1, "case"):
                j = next((k for k in range(j, len(t)) if src.is_(k, "{", ";") and not src.word(k - 1)), j)
            typed = src.word(i - 1) and t[i - 1].text not in KEYWORDS or src.is_(i - 1, "*", "&", ">", "]", "::", "~")
            if lang == "java":
                ok = typed and not src.is_(i - 1, "public", "private", "protected", "::") and (src.is_(j, "{") or src.is_(j, ";") and _member(src, i))
            else:
                ok = (typed or lang == "cpp" and _member(src, i)) and src.is_(j, "{")
            if ok and lang == "cpp" and src.is_(i - 1, ":", ",") and not src.is_(i - 2, "public", "private", "protected"):
                ok = False
            if ok:
                first = i
                while src.is_(first - 1, "::", "~"):
                    first -= 2 if src.is_(first - 1, "::") else 1
                add("".join(x.text for x in t[first : i + 1]), "function", head(i), src.match[j] if src.is_(j, "{") else j, j if src.is_(j, "{") else None)
    return found


def _member(src: Source, i: int) -> bool:
    """Whether a token begins what stands in the body of a class, not of a function: nothing but types before it."""
    j = i
    while src.word(j - 1) and src.tokens[j - 1].text not in KEYWORDS or src.is_(j - 1, "<", ">", ",", "[", "]", "~", "@"):
        j -= 1
    return src.is_(j - 1, "{", "}", ";", ":", ")")


READ = {"rust": rust, "go": go} | dict.fromkeys(WEB, web) | dict.fromkeys(NATIVE, native)


def called(src: Source, defined: set) -> list[tuple[int, str]]:
    """Place and text of what is called: names with what they hang on. ``defined``: places of names of definitions."""
    t, out, opened = src.tokens, [], src.opened
    no, heads = NOT_CALLS | OWN_WORDS.get(src.language, frozenset()), src.language not in ("rust", "go", "swift")
    for i in range(1, len(t)):
        # Behind the parameters of a definition its body begins.
        if not src.is_(i, "(") or heads and src.is_(src.match[i] + 1, "{"):
            continue
        k = i - 1
        if src.language == "rust" and src.is_(k, ">"):
            depth, j = 0, k
            while j > max(0, k - 200):
                depth += src.is_(j, ">") - src.is_(j, "<")
                if depth == 0:
                    break
                j -= 1
            k = j - 2 if src.is_(j - 1, "::") else k
        if not src.word(k) or t[k].text in no or t[k].start in defined or src.is_(k - 1, "fn", "func", "function", "class", "struct", "enum"):
            continue
        j = k
        while src.is_(j - 1, ".", "::", "?."):
            o = j - 2
            while o in opened:
                o = opened[o] - 1
                if not src.word(o) and o not in opened:
                    o += 1
                    break
            j = max(o, 0)
            if not src.word(j) and j not in src.match:
                j += 1
                break
        out.append((t[j].start, src.text[t[j].start : t[i - 1].end].strip()))
    return out


def imported(src: Source) -> list[tuple[int, str]]:
    """Place and text of what is imported."""
    t, out, lang = src.tokens, [], src.language
    if lang in ("c", "cpp"):
        return [(m.start(), m.group().strip()) for m in re.finditer(r"^[ \t]*#[ \t]*include[^\n]*", src.text, re.M)]
    for i in range(len(t)):
        if lang == "rust" and src.is_(i, "use") and (z := next((k for k in _top(src, i, len(t)) if src.is_(k, ";")), None)):
            out.append((t[i].start, src.text[t[i].end : t[z].start].strip()))
        elif lang == "go" and src.is_(i, "import"):
            stop = src.match[i + 1] if src.is_(i + 1, "(") else i + 4
            out += [(x.start, x.text.strip('"`')) for x in t[i + 1 : stop] if x.kind == "text"][: None if src.is_(i + 1, "(") else 1]
        elif lang in ("java", "swift", *WEB) and src.is_(i, "import") and not src.is_(i - 1, ".") and not src.is_(i + 1, "(", "."):
            z = i
            for k in _top(src, i + 1, len(t)):
                if src.is_(k, ";"):
                    z = k
                    break
                if src.line(t[k].start) > src.line(t[z].end - 1) and (lang == "swift" or t[z].kind == "text"):
                    break
                z = src.match.get(k, k)
            out.append((t[i].start, src.text[t[i].start : t[z].end].strip()))
    return out
