"""Context packs: sections of sources cut to budgets, with their manifest and provenance."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKER = "\n... [truncated]\n"
#: Where a text may be cut, and the default sections of a pack.
BOUNDARIES = ("\n\n", "\n#", "\n---", ";\n", "}\n")
DEFAULT_SECTIONS = ("overview", "architecture", "decisions", "rules", "code")
MAX_ITEM, MAX_SECTION, LEAST_ROOM = 8_000, 30_000, 100


@dataclass
class PackItem:
    source: str
    content: str
    path: str | None = None
    provenance: dict = field(default_factory=dict)

    @property
    def identity(self) -> str:
        return f"{self.source}:{self.path}" if self.path else hashlib.sha256(self.content.encode()).hexdigest()


def cut_semantically(text: str, most: int) -> str:
    """A longer text up to its last boundary at or before ``most`` characters, with a marker; without a boundary up to
    ``most``."""
    if len(text) <= most:
        return text
    at = max((text.rfind(b, 0, most + len(b)) for b in BOUNDARIES), default=-1)
    return text[: at if at >= 0 else most] + MARKER


def allocate(items: list[PackItem], max_item: int = MAX_ITEM, max_section: int = MAX_SECTION) -> list[PackItem]:
    """Items of one section in order while its budget lasts; the first of equal identity stays."""
    kept, seen, total = [], set(), 0
    for it in items:
        if it.identity in seen:
            continue
        seen.add(it.identity)
        text = cut_semantically(it.content, max_item)
        if total + len(text) > max_section:
            if max_section - total < LEAST_ROOM:
                break
            text = cut_semantically(text, max_section - total)
        total += len(text)
        kept.append(PackItem(it.source, text, it.path, it.provenance))
    return kept


def compose(items: DataFrame, max_item: int = MAX_ITEM, max_section: int = MAX_SECTION) -> DataFrame:
    """``section, pos, source, path, cut, content`` of the items that a pack holds, from ``section, source, path, ord,
    content``: in the order of ``ord`` (a whole number, ties by path and content), the first of equal identity, each cut to
    its budget, while the section's lasts. Null and empty contents are no items.

    Only items that the budget may reach are put in one place: running sums of sizes go over ranges of ``ord``, and behind
    the range in which the budget is spent no more items follow than its rest can be cut into."""
    rows = items.filter("content is not null and content <> '' and section is not null")
    identity = F.when(F.col("path").isNotNull(), F.concat_ws(":", "source", "path")).otherwise(F.sha2("content", 256))
    first = rows.groupBy("section", identity.alias("identity")).agg(F.min(F.struct("ord", "path", "content", "source")).alias("i")).select("section", "i.*")
    sized = first.withColumn("size", F.least(F.length("content"), F.lit(max_item))).withColumn("range", F.floor(F.col("ord") / 256))
    per = sized.groupBy("section", "range").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    up = Window.partitionBy("section").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("chars").over(up), F.lit(0))).withColumn("late", F.coalesce(F.sum(F.when(F.col("before") >= max_section, F.col("n")).otherwise(0)).over(up), F.lit(0)))
    # Each item behind the one that is cut adds the marker at least.
    near = per.filter((F.col("before") < max_section) | (F.col("late") <= max_section // len(MARKER))).select("section", "range")
    kept = sized.join(near, ["section", "range"]).select("section", "source", "path", "ord", "content")

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ord", "path", "content", "source"], na_position="first")
        given = {id(i): i for i in (PackItem(s, c, p if isinstance(p, str) else None, {"chars": len(c)}) for s, p, c in zip(pdf["source"], pdf["path"], pdf["content"]))}
        packed = allocate(list(given.values()), max_item, max_section)
        out = [(pdf["section"].iloc[0], n, i.source, i.path, len(i.content) != i.provenance["chars"], i.content) for n, i in enumerate(packed)]
        return pd.DataFrame(out, columns=["section", "pos", "source", "path", "cut", "content"])

    kind = items.schema["section"].dataType.simpleString()
    return kept.groupBy("section").applyInPandas(fold, f"section {kind}, pos int, source string, path string, cut boolean, content string")


def diagnostics(items: DataFrame, pack: DataFrame) -> DataFrame:
    """``section, given, kept, cut, chars`` of a pack from ``compose``."""
    had = items.groupBy("section").agg(F.count("*").alias("given"))
    got = pack.groupBy("section").agg(F.count("*").alias("kept"), F.count_if("cut").alias("cut"), F.sum(F.length("content")).alias("chars"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return had.join(got, "section", "left").select("section", "given", none("kept"), none("cut"), none("chars"))


def store(pack: DataFrame, root: str) -> DataFrame:
    """A pack from ``compose`` as a folder per section, items in order, beside a list of their sources; read back."""
    pack.repartition("section").sortWithinPartitions("section", "pos").write.mode("overwrite").partitionBy("section").parquet(f"{root}/items")
    stored = pack.sparkSession.read.schema(pack.schema).parquet(f"{root}/items")
    stored.select("section", "pos", "source", "path", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_hash")).write.mode("overwrite").json(f"{root}/sources")
    return stored


#: Kinds of sources a section may have.
SOURCES = ("vault_search", "code_search", "files", "cli_help", "document")


def manifest_problems(sections: DataFrame) -> DataFrame:
    """``manifest, problem``: the problems of manifests given as rows ``manifest, section, type``, a row per source."""
    n = F.col("section").isNull()
    unknown = F.concat(F.lit("section "), "section", F.lit(": unknown source "), F.coalesce("type", F.lit("?")))
    wrong = F.when(n, "a section has no id").when(F.col("type").isNull() | ~F.col("type").isin(*SOURCES), unknown)
    return sections.select("manifest", wrong.alias("problem")).filter("problem is not null").distinct()


def validate_manifest(manifest: dict) -> list[str]:
    """Problems of a pack's manifest: sections need a name of their own and sources of a known kind."""
    problems, names = [], set()
    for i, s in enumerate(manifest.get("sections") or []):
        name = s.get("id")
        if not name:
            problems.append(f"section {i} has no id")
        elif name in names:
            problems.append(f"section {name} is there twice")
        names.add(name)
        for src in s.get("sources") or []:
            if src.get("type") not in SOURCES:
                problems.append(f"section {name}: unknown source {src.get('type')}")
    if not manifest.get("sections"):
        problems.append("no sections")
    return problems


def pack_id(version: str, scope: str, sections: dict[str, list[PackItem]]) -> str:
    parts = [version, scope]
    for name, items in sections.items():
        parts += [name, *[hashlib.sha256(i.content.encode()).hexdigest() for i in items]]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def write_pack(root: str, scope: str, sections: dict[str, list[PackItem]]) -> str:
    """context-pack.md, sources.json and diagnostics.json, each written beside and renamed; returns the pack's id."""
    os.makedirs(root, exist_ok=True)
    ident = pack_id("1", scope, sections)
    text = "".join(f"# {name}\n\n" + "\n\n".join(i.content for i in items) + "\n\n" for name, items in sections.items())
    sources = [{"section": n, "identity": i.identity, "path": i.path, "chars": len(i.content), **i.provenance} for n, items in sections.items() for i in items]
    counts = {"pack_id": ident, "total_items": len(sources), "total_chars": sum(s["chars"] for s in sources)}
    for name, body in (("context-pack.md", text), ("sources.json", json.dumps(sources, indent=1)), ("diagnostics.json", json.dumps(counts, indent=1))):
        with open(os.path.join(root, name + ".tmp"), "w", encoding="utf-8") as f:
            f.write(body)
        os.replace(os.path.join(root, name + ".tmp"), os.path.join(root, name))
    return ident
