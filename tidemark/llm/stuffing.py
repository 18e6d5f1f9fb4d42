"""Keyword-stuffed and link-list pages.

Each text is cut into lines (and long lines at tags and separators), and each line is reduced to its shape: whether it
reads as a sentence, how many words, how many of them capitalised or glue words of a sentence, which separators, whether
it holds links. Lines are grouped by shape. Of each group counts what isn't sentences, tables, logs or code but links,
tags, product lines or words the page keeps repeating, and sentences that do nothing but repeat them. A page is stuffed if
the few shapes that have most of this make up the greater part of its text: who stuffs a page repeats a layout, too.
Everything is decided from the page alone, in one pass over the column, so the operator needs no shuffle and behaves alike
at every size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Glue words of the eight languages of the corpus. Sentences have them, lists of keywords don't.
GLUE = frozenset(
    """the a an of to in and is was were for that with on it this by as at from or be are so not but if when
    then there we they has have been will can no after before while until
    der die das den dem des ein eine einen einem und ist war wird wurde nicht mit für auf von zu zum beim bei dass
    nach noch oder aus im wir haben hat etwa braucht ohne als wieder ob danach erst dann weil wenn bis
    el la los las un una unos de del que y en es fue está con por para se lo al más no porque hasta cuando hemos
    le les une des du et est a été qui que dans pour pas sur au aux ce cette nous avons plus puis ne il sont avec
    o os as um uma e do da dos das no na nos nas não que foi é com por para se ao antes depois já ainda de
    и в не на что с по как мы это был была было из за то для от до его их потому нужен если когда после
    的 了 是 在 和 不 我们 因为 の は を に が で と も""".split()
)
BREAKS = re.compile("[\r\n\v\f\x85\u2028\u2029]+")
CLOSES = re.compile(r"(?i)</a>|<br\s*/?>|</li>|</p>|</div>|</td>")
PARTS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|(?<!\s)\s++[/|»•·]\s+|;\s+")
FRONT = re.compile(r"\A\s*---\s*\n.*?\n---\s*(?:\n|\Z)", re.S)
URL = re.compile(r"(?i)\b(?:https?://|www\.)[^\s<>\"')\]|]+")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
SEPARATORS = re.compile(r"[|/;»•#=<>\[\]{}]")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]{8}")
WORD = re.compile(r"[^\W_]+")
#: Digits and signs that stand for letters inside a word.
LEET = str.maketrans("013457@$", "oleastas")
LEETED = re.compile(r"(?<![\w@$])(?=[a-z0-9@$]*[a-z])(?=[a-z0-9@$]*[01345@$])[a-z0-9@$]{3,}(?![\w@$])")
LEET_INSIDE = re.compile(r"[a-z][01345@$][a-z]")
LOG = re.compile(r"^\W*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d(?::\d\d)?\]?\s|(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b)")
CALL = re.compile(r"\w\(")
CODE = re.compile(r"[;{}]\s*$|^\s*(?:[})\]]|//|/\*|\*/)|[\w)\]]\s*(?:=|==|=>|:=|\+=|->)\s*\S|^\s*(?:def|fn|func|class|if|for|while|with|else|async|pub|static|guard)\b.*[)\]}:({;,]$|^\s*(?:import|from|return|raise|end|const|let|var|defer|assert)\b[^,]*$")
HASHTAG = re.compile(r"(?<![\w&])#\w")
LISTED = re.compile(r"[|/;»•]|#\w|(?:,.*){4}")
#: Shapes that may make up a stuffed page.
FEW = 4
#: Letters by which words of one beginning are known, as in glued tags.
STEM = 4
#: Share of a page's words that its three most frequent make up where it repeats keywords, and where sentences do.
FOCUS, SPOKEN_FOCUS = 0.25, 0.3
#: Share of the different words, and of their beginnings, said three times or more where they are a list of keywords.
CLOSED, CLOSED_STEMS = 0.6, 0.8
ENDS = re.compile(r"[.!?…:;。！？][\"'”’)\]]*\s*$")


def plain(text: str) -> str:
    """The text as a reader sees it: compatibility forms folded, invisible characters gone, lower case kept apart."""
    return text if text.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def words_of(line: str, leet: bool = True) -> list[str]:
    """Words in lower case of a line without links and tags, written-out leet included; a number is no word."""
    low = line.lower()
    if leet:
        low = LEETED.sub(lambda m: m.group().translate(LEET), low)
    return [w for w in WORD.findall(low) if not w.isdigit()]


def lines_of(text: str) -> list[tuple[str, bool]]:
    """Lines with whether they are inside a code fence. Front matter is left out; lines are also cut after tags that
    break one, and long ones at separators and ends of sentences."""
    text = FRONT.sub("", text)
    out, fenced = [], False
    marked = "<" in text
    for raw in BREAKS.split(text):
        if raw.lstrip().startswith("```"):
            fenced = not fenced
            continue
        parts = CLOSES.split(raw) if marked and not fenced else [raw]
        for p in parts:
            long = not fenced and len(p) > 160 and not p.lstrip().startswith("|")
            for q in PARTS.split(p) if long else [p]:
                if q.strip():
                    out.append((q, fenced))
    return out


def shape(said: str, words: list[str], glue: int, linked: bool, spoken: bool) -> tuple:
    """Whether a line is a sentence, its word count (in steps), glue words, capitals, separators, link and end."""
    names = said.split()
    caps = sum([x[0].isupper() for x in names]) * 2 > len(names)
    return (spoken, min(len(words), 15) // 3, min(glue, 3), caps, frozenset(SEPARATORS.findall(said)), linked, bool(ENDS.search(said)))


def sentence(said: str, words: list[str], glue: int) -> bool:
    """Whether a line reads as a sentence: glue words (``glue`` different ones) among its words, an end, or a run of a
    script without spaces."""
    if not said.isascii() and CJK.search(said):
        return True
    if glue >= 2 and len(words) >= 5 and sum([x in GLUE for x in words]) >= 0.15 * len(words) and ("#" not in said or not HASHTAG.search(said)):
        return True
    return len(words) >= 3 and bool(ENDS.search(said)) and said.lstrip("#*- ")[:1].isupper() and not LISTED.search(said)


def is_code(line: str) -> bool:
    """Whether a line reads as code."""
    if CODE.search(line):
        return True
    end = line.rstrip()
    end = end[:-1].rstrip() if end[-1:] in ":{;" else end
    return end.endswith(")") and CALL.search(end) is not None


def stems_of(words: Counter) -> Counter:
    """Counts of the beginnings of words."""
    begun: dict = {}
    for x, n in words.items():
        x = x[:STEM]
        begun[x] = begun.get(x, 0) + n
    return Counter(begun)


def repeated(words: Counter, least: float) -> set[str]:
    """The words said three times or more, if these are at least a share ``least`` of all different ones: in texts of
    any length a good part of the words comes only once or twice, in a list of keywords said over and over hardly any."""
    again = {x for x, n in words.items() if n >= 3}
    return again if len(again) >= least * len(words) else set()


def repeats(akin: float, own: int, alike: int, focus: float) -> bool:
    """Whether a line of ``own`` words without glue, a part ``akin`` of which are keywords, serves to repeat these."""
    return akin >= 0.5 and (own >= 3 or alike >= 5 or focus >= FOCUS) or akin >= 0.3 and alike >= 8


def stuffing(text: str | None) -> float:
    """Share of the text (in characters, a link counting as a few words) that is links, tags, product lines or repeated
    keywords, in the FEW shapes of lines that have most of these. 0 for null, empty and blank texts."""
    if not text or not text.strip():
        return 0.0
    text = plain(text)
    low = text.lower()
    tags, links, leet = "<" in text, "://" in low or "www." in low, LEET_INSIDE.search(low) is not None
    lines, every, total = [], Counter(), 0
    #: Per shape: lines, and text that is stuffed.
    groups: dict = {}
    for q, fenced in lines_of(text):
        urls = len(URL.findall(q)) if links else 0
        said = URL.sub(" ", q) if urls else q
        said = (TAG.sub(" ", said) if tags else said).strip()
        size = len(said) + 24 * urls
        total += size
        if fenced:
            continue
        w = words_of(said, leet)
        every.update(w)
        glue = len(GLUE.intersection(w))
        form = shape(said, w, glue, urls > 0, sentence(said, w, glue))
        groups.setdefault(form, [0, 0])[0] += 1
        lines.append((q, said, urls, w, form, size))
    for g in GLUE & every.keys():
        del every[g]
    spoken = sum(every.values())
    first = every.most_common(3)
    # Words the page keeps repeating: often, and a good part of all it says. Glued ones share their beginning.
    often = max(3 if spoken < 80 else 2, 0.015 * spoken)
    keys = {w for w, n in every.items() if n >= often}
    focus = sum(n for _, n in first) / spoken if spoken else 0.0
    top = {w for w, _ in first}
    stems = None
    loose, left = Counter(), []
    for q, said, urls, w, form, size in lines:
        alike, stuffed = groups[form][0], False
        if form[0]:
            # A sentence that serves to repeat keywords only; else it is what a page is for, or explains a link.
            if focus >= SPOKEN_FOCUS and spoken >= 30:
                own = [x for x in w if x not in GLUE]
                echo = sum([x in keys for x in own]) >= 0.6 * len(own) or sum([x in top for x in own]) >= len(own) / 3
                stuffed = len(own) >= 3 and echo and len(set(own)) <= 0.78 * len(own) and any(own.count(x) > 1 for x in top)
        elif LOG.match(q):
            continue
        elif urls:
            stuffed = True
        else:
            own = [x for x in w if x not in GLUE]
            if stems is None:
                stems = {x for x, n in stems_of(every).items() if n >= often}
            akin = max(sum([x in keys for x in own]), sum([x[:STEM] in stems for x in own])) / len(own) if own else 0.0
            if akin < 0.8 and (q.lstrip().startswith("|") or is_code(q)):
                continue
            loose.update(own)
            stuffed = bool(own) and repeats(akin, len(own), alike, focus) or alike >= 8 and len(w) <= 3 and not form[-1]
            if own and not stuffed:
                left.append((size, own, form))
        if stuffed:
            groups[form][1] += size
    if left:
        # Many keywords have a small share of the page each, however often they come: then the list is a closed one.
        again, begins = repeated(loose, CLOSED), repeated(stems_of(loose), CLOSED_STEMS)
        if again or begins:
            for size, own, form in left:
                if repeats(max(sum([x in again for x in own]), sum([x[:STEM] in begins for x in own])) / len(own), len(own), groups[form][0], focus):
                    groups[form][1] += size
    # Sentences are one layout, whatever their lengths.
    most = sorted([sum(n for f, (_, n) in groups.items() if f[0]), *(n for f, (_, n) in groups.items() if not f[0])], reverse=True)
    return sum(most[:FEW]) / total if total else 0.0


def stuffed_pages(docs: DataFrame, id_col: str, text_col: str, least: float = 0.5) -> DataFrame:
    """``id_col, share`` of the documents of which more than ``least`` is stuffed. Null, empty and blank texts are no
    cases; repeated rows of an id count once (the greatest share); other columns aren't read."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    rows = spread(rows)
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shares = pa.array([stuffing(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), shares], ["doc", "share"])

    found = rows.mapInArrow(run, f"doc {kind}, share double").filter(F.col("share") > least)
    return found.groupBy("doc").agg(F.max("share").alias("share")).withColumnRenamed("doc", id_col)
