"""Files nobody wrote by hand: generated, minified, vendored (altered or not) and data saved as code.

Path rules name vendored directories, lockfiles and the suffixes of generated and minified files. The comments at the
head and at the end of each segment run through a multi-pattern automaton of generation notices, and through rules for
notices of origin. Segments are also measured: how few line templates they have, how much of them is literals, how
dense their long lines are, and how many of their five-word shingles known third-party sources have. One pass over the
segments gives a few numbers each; files sum them up, so a huge file or project is no hot task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Notices of generated files, as they stand in comments, in lower case.
GENERATED_NOTICES = """
code generated by
@generated
<auto-generated
auto-generated file
auto-generated by
auto generated by
autogenerated by
autogenerated on
autogenerated file
automatically generated
generated automatically
generated-by:
generated by the protocol buffer compiler
this file was generated
this file is generated
this is a generated file
generated file, do not
generated. do not
machine-written by
machine written by
machine-generated
machine generated
edits will be overwritten
changes will be overwritten
changes will be lost
do not modify by hand
do not edit by hand
do not edit this file
do not edit manually
do not edit directly
, do not touch --
emitted by
regenerate with
automatisch erzeugt
automatisch generiert
nicht von hand bearbeiten
généré automatiquement
ne pas modifier
generado automáticamente
no editar a mano
gerado automaticamente
não edite
создан автоматически
сгенерирован автоматически
не редактировать
自动生成
自動生成
""".strip().split("\n")
#: What undoes a notice that follows within two words; "do not" is part of a notice, not its denial.
UNDONE = re.compile(r"(?:\bused to be|\bno longer|n't|\bnever|\binstead of being|\brather than|(?<!\bdo )\bnot)(?: \w+){0,2} ?$")
#: A whole comment that forbids edits, and such a ban beside a word of generation.
BAN = re.compile(r"\bdo not (?:edit|modify|change|touch)\b")
ONLY_BAN = re.compile(r"\W*(?:(?:warning|note|attention)\W+)?do not (?:edit|modify|change|touch)(?: this file)?\W*")
#: Licence texts, which tell nothing about who wrote the file, with their versions.
LICENCE = re.compile(
    r"spdx-[a-z-]+: ?[^|]{0,120}|https?://\S*licen[sc]e\S*|\b(?:apache|mozilla|eclipse|gnu|boost|artistic|academic|creative commons|open software|python|microsoft)"
    r"[^|.;]{0,60}?licen[sc]e[^|.;]{0,30}?(?:v\.? ?)?\d++(?:\.\d++)*|\b(?:apache|[al]?gpl|mpl|epl|cddl|bsl|afl|osl|ms-pl|cc[ -]by[a-z-]*)[ -]?v?\d++(?:\.\d++)*|\b[a-z]+-\d++(?:\.\d++)* licen[sc]e"
)
#: A name with a version, in lower case: ``name 1.2``, ``name v1.2.3``, ``name-1.2`` or ``name (1.2)``.
NAMED = re.compile(r"(?<![\w.+-])[a-z][a-z0-9_+.-]*(?: ?\(| |-|@)(?:version |v)?\d++\.\d++")
LEADING_NAMED = re.compile(r"[^\w(]*" + NAMED.pattern)
FROM = re.compile(r"imported unchanged|vendored from|copied (?:verbatim )?from|copy of|taken from|mirror of|origin:|upstream:|local changes:|kept in the tree")
OWNED = re.compile(r"\(c\)|©|\bcopyright\b|https?://")
#: Path rules, over the path with a slash before it, in lower case.
VENDORED_PATH = r"/(third[_-]?party|3rd[_-]?party|vendor|vendors|vendored|node_modules|bower_components|site-packages)/.|/(extern|external|externals|deps|libs?|contrib)/[^/]+[@-]v?\d+(\.\d+)+[^/]*/|/extern/[^/]+/."
GENERATED_PATH = r"/(__generated__|generated|autogen)/|/zz_generated|\.(gen|generated|pb|g|designer)\.[a-z]+$|_pb2(_grpc)?\.[a-z]+$|_autogen(_[a-z0-9]+)?\.[a-z]+$|\.pb\.(go|cc|h)$"
MINIFIED_PATH = r"[.-]min\.[a-z]+$|\.(bundle|chunk)\.[a-z]+$"
LOCK_PATH = r"/(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|gemfile\.lock|go\.sum|composer\.lock)$"

COMMENT = re.compile(r"^\s*(?://+!?|#+!?(?!include|define|if|endif|else|pragma|undef)|/\*+!?|\*+(?:/|\s|$)|<!--|--\s|;+|%+|\"\"\"|''')\s*(.*)$")
QUOTED = re.compile(r"\"[^\"]*\"|'[^'\s][^']*'|`[^`]*`")
LINES = re.compile(r"\r\n|[\r\n\v\f\x85  ]")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
WORDS = re.compile(r"\w+")
#: A line of literals and nothing else; its last number may be cut off at the sign. Nothing is given back once it has
#: matched (possessive), so a line is read once, whatever it holds.
LITERALS = re.compile(r"(?>\s++|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|[-+]?\.?\d[\w.]*+|[\[\](){},:;]|(?:null|None|nil|true|false)\b)*+[-+]?")
SHINGLE = 5
FEATURES = "notice int, origin int, lines int, templates int, shown int, literal int, literal_size int, size int, dense int, shingles int, known int"


def shingle_hashes(text: str) -> list[int]:
    """Hashes of the five-word shingles of a text, repeated ones too."""
    import xxhash

    w = WORDS.findall(text)
    return [xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE])) for i in range(len(w) - SHINGLE + 1)]


def follow_blocks(lines: list[str], said: list) -> list:
    """What lines say, those inside a block comment, or a docstring before any code, included; a block that has no end
    here is left as it is."""
    said, at, coded, endless = list(said), 0, False, set()
    while at < len(lines):
        start = lines[at].lstrip()
        end = "*/" if start.startswith("/*") else start[:3] if not coded and start[:3] in ('"""', "'''") else None
        if end and end not in endless and end not in start[len(end) :]:
            last = next((i for i in range(at + 1, len(lines)) if end in lines[i]), None)
            if last is None:
                endless.add(end)
            else:
                for i in range(at + 1, last + 1):
                    inside, _, after = lines[i].partition(end)
                    said[i] = False if i == last and after.strip() else inside.strip().lstrip("*").strip() or None
                coded = coded or said[at] is False
                at = last
        coded = coded or said[at] is False
        at += 1
    return said


def without_blocks(line: str, put: str = "") -> str:
    """A line without the block comments that open and close in it; each place is looked at once."""
    if "/*" not in line:
        return line
    out, at = [], 0
    while (start := line.find("/*", at)) >= 0 and (end := line.find("*/", start + 2)) >= 0:
        out += [line[at:start], put]
        at = end + 2
    return "".join([*out, line[at:]])


def says_generated(said: str, automaton) -> bool:
    """Whether a comment (in lower case, single spaces) gives notice of generation that its own words don't undo."""
    if ONLY_BAN.fullmatch(said):
        return True
    hits = [end - len(GENERATED_NOTICES[i]) + 1 for end, i in automaton.iter(said)]
    if "generated" in said and BAN.search(said):
        hits.append(said.index("generated"))
    return any(not UNDONE.search(said[max(0, at - 80) : at]) for at in hits)


def says_origin(said: str) -> bool:
    """Whether a comment (in lower case, single spaces) names the library and version it was taken from: after a word of
    origin or before one, or as a title with an owner or address behind it. Licence texts and their versions don't count."""
    if not any(x.isdigit() for x in said):
        return False
    said = LICENCE.sub(" | ", said)
    if (named := NAMED.search(said)) is None:
        return False
    if (word := FROM.search(said)) and (FROM.search(said, named.end()) or NAMED.search(said, word.end())):
        return True
    title = LEADING_NAMED.match(said)
    return bool(title and OWNED.search(said, title.end()))


def notices(lines: list[str], automaton) -> tuple[bool, bool]:
    """Whether the comments before the first and after the last line of code give notice of generation, of origin."""
    said = [None if not x.strip() else (m.group(1) if (m := COMMENT.match(x)) else False) for x in lines]
    said = [False if x and y.lstrip().startswith("/*") and "*/" in y and without_blocks(y).strip() else x for x, y in zip(said, lines)]
    said = follow_blocks(lines, said)
    code = [i for i, x in enumerate(said) if x is False]
    head = said[: code[0]] if code else said
    tail = said[code[-1] + 1 :] if code else []
    comments = [" ".join(QUOTED.sub(" ", x).lower().split()) for x in [*head, *tail] if x]
    return any(says_generated(x, automaton) for x in comments), any(says_origin(x) for x in comments)


def measure(text: str, automaton, known: frozenset) -> tuple:
    """The numbers of one segment, in the order of FEATURES."""
    lines = LINES.split(text)
    generated, origin = notices(lines, automaton)
    shown = [x.strip() for x in lines if x.strip()]
    code = [y for x in shown if (y := without_blocks(x).strip()) and not COMMENT.match(y)]
    templates = len({re.sub(r"\d+", "9", x) for x in code})
    literal = [x for x in code if LITERALS.fullmatch(x) and WORDS.search(x)]
    dense = 0
    for x in code:
        if len(x) > 150:
            names = NAME.findall(QUOTED.sub("", x))
            dense |= len(names) >= 20 and sum(len(n) <= 2 for n in names) > 0.5 * len(names)
    hashes = shingle_hashes(text)
    return (
        int(generated), int(origin), len(lines), templates, len(code), len(literal), sum(map(len, literal)), sum(map(len, code)), int(dense),
        len(hashes), sum(h in known for h in hashes) if known else 0,
    )


def _measurer(columns: list[str], known):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(GENERATED_NOTICES):
            automaton.add_word(phrase, i)
        automaton.make_automaton()
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = [measure(t or "", automaton, known.value) for t in batch.column(len(columns)).to_pylist()]
            features = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *features], [*columns, *names])

    return run


def _shingles_of(columns: list[str]):
    """Arrow function: the columns before the text, and each different shingle of the text with its number."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [Counter(shingle_hashes(t or "")) for t in batch.column(len(columns)).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            h = np.fromiter((h for x in found for h in x), np.uint64, len(row)).view(np.int64)
            n = np.fromiter((n for x in found for n in x.values()), np.int32, len(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(len(columns))), pa.array(h), pa.array(n)], [*columns, "h", "n"])

    return run


def known_shingles(upstream: DataFrame, text_col: str) -> DataFrame:
    """``h``: the different hashes of the shingles of the known sources."""
    return spread(upstream.select(text_col)).mapInArrow(_shingles_of([]), "h long, n int").select("h").distinct()


def _measured(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``path`` and FEATURES per segment. Hashes of known sources go to every task while they are at most ``most``. Beyond
    that the segments' shingles meet them in a join by hash: known hashes are unique there, so a shingle that a third of
    all segments have can be split, and counts per segment combine before they move."""
    spark = rows.sparkSession
    few = known.limit(most + 1).toPandas()["h"].to_numpy()
    if len(few) <= most:
        shared = spark.sparkContext.broadcast(frozenset(few.astype("int64").view("uint64").tolist()))
        return rows.mapInArrow(_measurer(["path"], shared), "path string, " + FEATURES)
    keyed = rows.withColumn("seg", F.xxhash64("path", F.sha2("text", 256))).select("path", "seg", "text")
    plain = keyed.mapInArrow(_measurer(["path", "seg"], spark.sparkContext.broadcast(frozenset())), "path string, seg long, " + FEATURES).drop("known")
    # Repeated segments count their shingles once here, as they share their key.
    once = keyed.dropDuplicates(["seg"]).select("seg", "text")
    met = once.mapInArrow(_shingles_of(["seg"]), "seg long, h long, n int").join(known, "h").groupBy("seg").agg(F.sum("n").cast("int").alias("known"))
    return plain.join(met, "seg", "left").select(*plain.columns, F.coalesce("known", F.lit(0)).alias("known")).drop("seg")


def by_path(path: Column) -> Column:
    """What a path alone tells: 'vendored', 'generated', 'minified', 'lockfile', else null."""
    p = F.concat(F.lit("/"), F.lower(F.translate(path, "\\", "/")))
    return F.when(p.rlike(VENDORED_PATH), "vendored").when(p.rlike(MINIFIED_PATH), "minified").when(p.rlike(GENERATED_PATH), "generated").when(p.rlike(LOCK_PATH), "lockfile")


def unwritten_files(segments: DataFrame, upstream: DataFrame, path_col: str = "file_path", text_col: str = "content", upstream_text: str = "content", similar: float = 0.8, most_known: int = 500_000) -> DataFrame:
    """``path, reason`` (generated, minified, vendored, data or lockfile) of the files not written by hand; a file
    counts if one of its segments shows it. Null paths are ignored, null and empty contents show nothing, repeated
    segments change nothing; empty tables give an empty result. ``similar``: share of a segment's five-word shingles
    that known third-party sources have, from which it is a copy. ``most_known``: different shingles of known sources
    that every task may hold (a set of half a million is some 50 MB); more are joined, with the same result."""
    rows = spread(segments.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).filter("path is not null"))
    measured = _measured(rows, known_shingles(upstream, upstream_text), most_known)
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    flags = {
        "generated": (F.col("notice") == 1) | ((F.col("shown") >= 8) & (share("templates", "shown") <= 0.35)),
        "vendored": (F.col("origin") == 1) | ((F.col("shingles") >= 20) & (share("known", "shingles") >= similar)),
        "data": (F.col("literal_size") >= 60) & (share("literal_size", "size") >= 0.6),
        "minified": F.col("dense") == 1,
    }
    sums = [F.sum(c).alias(c) for c in ("shown", "templates", "literal_size", "size", "shingles", "known")]
    files = measured.groupBy("path").agg(*[F.max(x).alias(k) for k, x in flags.items()], *sums)
    told = by_path(F.col("path"))
    # What no segment shows clearly the file as a whole may.
    reason = (
        F.coalesce(
            F.when(F.col("minified"), "minified"), told, F.when(F.col("vendored"), "vendored"), F.when(F.col("generated"), "generated"), F.when(F.col("data"), "data"),
            F.when((F.col("shingles") >= 20) & (share("known", "shingles") >= similar), "vendored"),
            F.when((F.col("shown") >= 12) & (share("templates", "shown") <= 0.4), "generated"),
            F.when((F.col("literal_size") >= 60) & (share("literal_size", "size") >= 0.6), "data"),
        )
    )
    return files.select("path", reason.alias("reason")).filter("reason is not null")
