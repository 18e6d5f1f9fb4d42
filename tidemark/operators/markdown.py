"""Markdown notes: front matter, blocks, chunks and repair. Text rules run in Arrow batches, row by row inside."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

CHUNK_BYTES, OVERLAP_FROM = 1500, 1200
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:\s|$)")
RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")


def split_front_matter(text: str) -> tuple[dict | None, str, str | None]:
    """Fields, body and error. A text without the opening line has no fields; an unclosed block, a repeated or a
    malformed field is an error, and then there is no body. Values are texts or lists of texts."""
    nl = "\r\n" if text.startswith("---\r\n") else "\n"
    if not text.startswith("---" + nl):
        return None, text, None
    opening = 3 + len(nl)
    if text.startswith("---" + nl, opening):
        return {}, text[opening + 3 + len(nl) :].lstrip("\r\n"), None
    end = text.find(f"{nl}---{nl}", opening)
    if end < 0:
        return None, "", "unclosed front matter"
    try:
        fields = parse_fields(text[opening:end].split(nl))
    except ValueError as e:
        return None, "", str(e)
    return fields, text[end + len(nl) + 3 + len(nl) :].lstrip("\r\n"), None


KEY = re.compile(r"^(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\[\]{}#&*!|>'\"%@`,?-][^:#]*?|[?-][^\s:]+)\s*:(?:\s+(.*))?$")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "/": "/", '"': '"', "\\": "\\", " ": " ", "e": "\x1b", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def parse_fields(lines: list[str]) -> dict:
    """YAML of front matter, strictly and as texts: maps and lists in block and flow form at any depth, plain, quoted and
    block scalars over several lines. Repeated fields, tabs that indent, aliases and whatever is malformed raise
    ValueError. A scalar stays a text, whatever it looks like; only ``null`` and ``~`` are None."""
    reader = _Yaml(lines)
    return reader.fields()


class _Yaml:
    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0

    def fail(self, why: str = "malformed line"):
        line = self.lines[self.at].strip() if self.at < len(self.lines) else "end"
        raise ValueError(f"{why}: {line[:60]}")

    def peek(self) -> tuple[int, str]:
        """Indent and text of the next line that says something; -1 at the end."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1
        if self.at >= len(self.lines):
            return -1, ""
        line = self.lines[self.at].rstrip("\r")
        text = line.lstrip(" ")
        if text.startswith("\t"):
            self.fail("tab")
        return len(line) - len(text), text

    def fields(self) -> dict:
        indent, text = self.peek()
        if indent < 0:
            return {}
        if text.startswith("- "):
            self.fail("no fields")
        out = self.block(indent)
        if self.peek()[0] >= 0:
            self.fail()
        if not isinstance(out, dict):
            raise ValueError("no fields")
        return out

    def block(self, indent: int):
        _, text = self.peek()
        return self.items(indent) if text == "-" or text.startswith("- ") else self.map(indent)

    def items(self, indent: int) -> list:
        out = []
        while True:
            here, text = self.peek()
            if here != indent or not (text == "-" or text.startswith("- ")):
                if here > indent:
                    self.fail("indent")
                return out
            rest = text[1:].lstrip(" ")
            if KEY.match(rest) and not rest.startswith(("[", "{")):
                # A map that begins on the line of its item.
                inner = indent + len(text) - len(rest)
                self.lines = [*self.lines]
                self.lines[self.at] = " " * inner + rest
                out.append(self.map(inner))
            else:
                self.at += 1
                out.append(self.value(rest, indent))

    def map(self, indent: int) -> dict:
        out: dict = {}
        while True:
            here, text = self.peek()
            if here != indent:
                if here > indent:
                    self.fail("indent")
                return out
            if text.startswith("- ") or not (m := KEY.match(text)):
                self.fail()
            key = scalar(m.group(1))
            if key in out:
                raise ValueError(f"repeated field: {key}")
            self.at += 1
            out[key] = self.value((m.group(2) or "").strip(), indent, listed=True)

    def value(self, text: str, indent: int, listed: bool = False):
        text = re.sub(r"^(?:[!&]\S*\s*)+", "", text)
        if text.startswith("#"):
            text = ""
        if text.startswith("*"):
            self.at -= 1
            self.fail("alias")
        if text == "":
            here, after = self.peek()
            if here > indent or listed and here == indent and (after == "-" or after.startswith("- ")):
                return self.block(here)
            return None
        if m := re.match(r"^([|>])([+-]?\d?|\d[+-]?)(?:\s+#.*)?$", text):
            return self.literal(indent, m.group(1) == ">", m.group(2))
        if text[0] in "[{":
            return self.flow(text, indent)
        if text[0] in "\"'":
            return self.quoted(text, indent)
        return self.plain(text, indent)

    def literal(self, indent: int, folded: bool, mark: str) -> str:
        taken = []
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip("\r")
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            taken.append(line)
            self.at += 1
        width = min((len(x) - len(x.lstrip(" ")) for x in taken if x.strip()), default=0)
        body = "\n".join(x[width:] for x in taken)
        text = body.rstrip("\n")
        if folded:
            text = re.sub(r"(?<=\S)\n(?=\S)", " ", text)
            text = re.sub(r"\n\n(?=\S)", "\n", text)
        return text if "-" in mark else body + "\n" if "+" in mark else text + "\n" if text else ""

    def more(self, indent: int) -> str:
        """The next line of a value that goes on."""
        here, text = self.peek()
        if here <= indent:
            self.fail("value without end")
        self.at += 1
        return text.rstrip()

    def quoted(self, text: str, indent: int) -> str:
        sign = text[0]
        while not (m := re.match(r'"(?:[^"\\]|\\.)*"' if sign == '"' else r"'(?:[^']|'')*'", text)):
            text = f"{text} {self.more(indent)}"
        if not re.fullmatch(r"\s*(?:#.*)?", text[m.end() :]):
            self.at -= 1
            self.fail()
        return scalar(m.group())

    def plain(self, text: str, indent: int):
        text = re.sub(r"\s+#.*$", "", text)
        while True:
            here, after = self.peek()
            if here <= indent:
                break
            text += " " + re.sub(r"\s+#.*$", "", after.rstrip())
            self.at += 1
        if re.search(r":(?:\s|$)", text) or text[0] in "%@`]},":
            self.at -= 1
            self.fail()
        return None if text in ("~", "null", "Null", "NULL") else text

    def flow(self, text: str, indent: int):
        tokens, at, depth, out = [], 0, 0, None
        rule = re.compile(r"\s*(?:#[^\n]*)?([\[\]{},]|:(?=\s|[\[\]{},]|$)|\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\[\]{},#][^\[\]{},\n]*?(?=\s*(?:[\[\]{},]|:(?:\s|$)|\s#|$)))")
        while True:
            while (m := rule.match(text, at)) and m.group(1):
                tokens.append(m.group(1))
                depth += (m.group(1) in "[{") - (m.group(1) in "]}")
                at = m.end()
                if depth == 0:
                    break
            if depth == 0 and tokens:
                break
            text, at = text[at:] + " " + self.more(indent), 0
        if not re.fullmatch(r"\s*(?:#.*)?", text[at:]):
            self.at -= 1
            self.fail()
        try:
            out, end = self.node(tokens, 0)
        except IndexError:
            raise ValueError("malformed list") from None
        if end != len(tokens):
            self.fail()
        return out

    def node(self, t: list, i: int):
        if t[i] == "[":
            out, i = [], i + 1
            while t[i] != "]":
                x, i = self.node(t, i)
                out.append(x)
                i = self.comma(t, i, "]")
            return out, i + 1
        if t[i] == "{":
            fields: dict = {}
            i += 1
            while t[i] != "}":
                if t[i] in "[]{},:":
                    raise ValueError("malformed map")
                key, i = scalar(t[i]), i + 1
                x = None
                if t[i] == ":":
                    x, i = self.node(t, i + 1) if t[i + 1] not in ",}" else (None, i + 1)
                if key in fields:
                    raise ValueError(f"repeated field: {key}")
                fields[key] = x
                i = self.comma(t, i, "}")
            return fields, i + 1
        if t[i] in "]},:":
            raise ValueError("malformed list")
        return (None if t[i] in ("~", "null") else scalar(t[i])), i + 1

    def comma(self, t: list, i: int, close: str) -> int:
        if t[i] == ",":
            return i + 1
        if t[i] != close:
            raise ValueError("malformed list")
        return i


def scalar(value: str) -> str:
    v = value.strip()
    if len(v) > 1 and v[0] == v[-1] == "'":
        return v[1:-1].replace("''", "'")
    if len(v) > 1 and v[0] == v[-1] == '"':
        code = r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))"
        return re.sub(code, lambda m: ESCAPES.get(m.group(4), m.group(4)) if m.group(4) else chr(int(m.group(1) or m.group(2) or m.group(3), 16)), v[1:-1])
    return v


def blocks(text: str) -> list[tuple[str | None, str]]:
    """Top-level blocks in order: (heading or None, source). Paragraphs, lists, quotes, tables, fences and headings
    (with signs or underlined) are kept whole."""
    out: list[tuple[str | None, str]] = []
    lines = text.splitlines(keepends=True)
    i = 0
    while i < len(lines):
        line = lines[i].rstrip("\r\n")
        if not line.strip():
            i += 1
            continue
        if m := HEADING.match(line):
            out.append(((m.group(2) or "").strip(), lines[i].rstrip("\r\n")))
            i += 1
            continue
        if m := FENCE.match(line):
            close = re.compile(rf"^ {{0,3}}{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}[ \t]*$")
            j = i + 1
            while j < len(lines) and not close.match(lines[j].rstrip("\r\n")):
                j += 1
            j = min(j + 1, len(lines))
            out.append((None, "".join(lines[i:j]).rstrip("\r\n")))
            i = j
            continue
        if RULE.match(line):
            out.append((None, line))
            i += 1
            continue
        j, listed = i + 1, bool(ITEM.match(line))
        while j < len(lines):
            here = lines[j].rstrip("\r\n")
            if not here.strip():
                # A list goes on behind a blank line if its next line is an item or indented.
                after = next((x.rstrip("\r\n") for x in lines[j + 1 :] if x.strip()), "")
                if listed and (ITEM.match(after) or after.startswith(("  ", "\t"))):
                    j += 1
                    continue
                break
            if not listed and j == i + 1 and re.match(r"^ {0,3}(=+|-+)[ \t]*$", here):
                out.append((line.strip(), "".join(lines[i : j + 1]).rstrip("\r\n")))
                break
            if HEADING.match(here) or FENCE.match(here) and not listed or RULE.match(here) or (not listed and ITEM.match(here)):
                break
            j += 1
        else:
            out.append((None, "".join(lines[i:j]).rstrip("\r\n")))
            i = j
            continue
        if not (out and out[-1][0] is not None and out[-1][1] == "".join(lines[i : j + 1]).rstrip("\r\n")):
            out.append((None, "".join(lines[i:j]).rstrip("\r\n")))
            i = j
        else:
            i = j + 1
    return [b for b in out if b[1].strip() or b[0] is not None]


def chunk_markdown(text: str | None) -> list[tuple[str, str]]:
    """(heading, text) per chunk: headings begin a new one, blocks are packed to 1500 bytes, a larger block is cut at
    lines, the next part starting at the line at which 1200 bytes were reached. Null and blank texts have no chunks."""
    chunks: list[tuple[str, str]] = []
    heading, packed = "", ""
    size = lambda s: len(s.encode())

    def flush():
        nonlocal packed
        body = packed.strip()
        if body:
            chunks.extend((heading, t) for t in ([body] if size(body) <= CHUNK_BYTES else cut_lines(body)))
        packed = ""

    for title, source in blocks(text or ""):
        if title is not None:
            flush()
            heading = title
            packed = source + "\n"
        else:
            if packed.strip() and size(packed) + size(source) > CHUNK_BYTES:
                flush()
            packed += source + "\n\n"
    flush()
    return chunks


def cut_lines(text: str) -> list[str]:
    """Parts of whole lines of at least 1500 bytes, each sharing its last lines, from 1200 bytes on, with the next."""
    lines, out, at = text.splitlines(), [], 0
    while at < len(lines):
        total, again, end = 0, None, at
        while end < len(lines):
            total += len(lines[end].encode()) + 1
            if again is None and total >= OVERLAP_FROM and end > at:
                again = end
            end += 1
            if total >= CHUNK_BYTES:
                break
        out.append("\n".join(lines[at:end]).strip())
        if end >= len(lines):
            break
        at = max(again if again is not None else end, at + 1)
    return out


def repair_note(text: str, new_id: str | None = None) -> str:
    """A note with one id: a missing block or id is added, of several ids the first stays, a closing line glued to the
    last field is cut free. A sound note is returned as it is; ValueError if it can't be read."""
    fresh = new_id or str(uuid.uuid4())
    nl = "\r\n" if text.startswith("---\r\n") else "\n"
    if not text.startswith("---" + nl):
        return f"---\nid: {fresh}\n---\n\n{text}"
    opening = 3 + len(nl)
    end = text.find(f"{nl}---{nl}", opening)
    if end >= 0:
        head, tail, glued = text[opening:end], text[end:], False
    else:
        stop = text.find(nl * 2, opening)
        if stop < 0 or not text[opening:stop].endswith("---"):
            raise ValueError("unclosed front matter")
        head, tail, glued = text[opening : stop - 3], f"{nl}---{nl}{nl}{text[stop + 2 * len(nl) :]}", True
    ids, kept = 0, []
    for line in head.split(nl):
        ids += line.startswith("id:")
        if not (line.startswith("id:") and ids > 1):
            kept.append(line)
    known = parse_fields(kept).get("id")
    if ids <= 1 and not glued and known:
        return text
    return "---" + nl + nl.join(kept if known else [*kept, f"id: {fresh}"]) + tail


def note_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, chunk_index, heading, text`` of all notes; front matter isn't chunked, and a note whose front matter
    can't be read gives one row with ``error``."""
    rows = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                _, body, error = split_front_matter(text or "")
                if error:
                    out.append((doc, 0, None, None, error))
                else:
                    out.extend((doc, i, h, t, None) for i, (h, t) in enumerate(chunk_markdown(body)))
            yield pd.DataFrame(out, columns=["doc", "chunk_index", "heading", "text", "error"]).astype({"chunk_index": "int32"})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, chunk_index int, heading string, text string, error string").withColumnRenamed("doc", id_col)


def _flat(value):
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return ",".join(value)
    return value if value is None or isinstance(value, str) else json.dumps(value)


def front_matter(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, fields map<string,string>, body, error``; lists of texts are joined by commas, what is nested is JSON."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            got = [split_front_matter(t or "") for t in pdf["text"]]
            flat = [None if f is None else {k: _flat(v) for k, v in f.items()} for f, _, _ in got]
            yield pd.DataFrame({"doc": pdf["doc"], "fields": flat, "body": [b for _, b, _ in got], "error": [e for _, _, e in got]})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, fields map<string,string>, body string, error string").withColumnRenamed("doc", id_col)
