"""Mixing sources to target weights in tokens.

Documents are tallied per cell (source, language, topic). Token weights of the cells are raked to the source, language
and topic marginals by iterative proportional fitting, under each source's cap of repeats; then documents are drawn by
the calibrated probabilities. The draw of a source stops at the document at which its tokens come nearest to what was
asked for, so its share is off by half a document at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Cells (source, language, topic), and targets, that the driver may hold: two million are some 200 MB while they are raked.
#: More raise an error; a "topic" of which there are more isn't one.
MAX_CELLS = 2_000_000
#: Ranges a source is cut into where its draw ends, twice in a row.
RANGES = 4096


@dataclass(frozen=True)
class Plan:
    """Per source: tokens asked for; per cell: expected repeats of a document."""

    tokens: dict
    repeats: dict


def source_tokens(sizes: dict, shares: dict, caps: dict, total: float) -> dict:
    """Tokens each source gives to a mixture of ``total``: its share of it, or all it may give (size times cap) if that
    is less; what is short then falls to the others in proportion to their shares. Sources without target or without
    tokens give none. If all together can't reach the total, each gives all it may."""
    able = {s: sizes[s] * max(0, caps.get(s) or 0) for s in sizes if shares.get(s, 0) and shares[s] > 0 and sizes[s] > 0}
    given, open_, rest = {}, {s for s, most in able.items() if most > 0}, float(total)
    while open_ and rest > 0:
        weight = sum(shares[s] for s in open_)
        short = {s for s in open_ if shares[s] / weight * rest >= able[s]}
        if not short:
            return given | {s: shares[s] / weight * rest for s in open_}
        for s in short:
            given[s] = able[s]
        open_ -= short
        rest = float(total) - sum(given.values())
    return given


def rake(cells: dict, asked: dict, caps: dict, rounds: int = 100, near: float = 1e-9) -> dict:
    """Repeats per cell (source, language, topic): the corpus weights fitted in turn to the marginals of topic, language
    and source. Topics and languages keep the shares they have among the tokens of the sources asked; the sources come
    last and hold exactly. No cell exceeds its source's cap; what a capped cell can't take falls to the source's other
    cells."""
    import numpy as np

    used = [c for c, t in cells.items() if asked.get(c[0], 0) > 0 and t > 0]
    if not used:
        return {}
    t = np.array([cells[c] for c in used], float)
    names, codes = [], []
    for axis in range(3):
        of = {x: i for i, x in enumerate(dict.fromkeys(c[axis] for c in used))}
        names.append(list(of))
        codes.append(np.array([of[c[axis]] for c in used]))
    source, most = codes[0], np.array([float(caps[s]) for s in names[0]])
    goal, cap = np.array([float(asked[s]) for s in names[0]]), most[codes[0]]
    w = (goal / np.bincount(source, t))[source]
    wants = {axis: np.bincount(codes[axis], t) / t.sum() * goal.sum() for axis in (2, 1)}
    for _ in range(rounds):
        before = w.copy()
        for axis, want in wants.items():
            have = np.bincount(codes[axis], w * t)
            w = np.minimum(w * np.divide(want, have, out=np.ones_like(want), where=have > 0)[codes[axis]], cap)
        w = _fill(w, t, source, goal, most)
        if np.abs(w - before).max() < near:
            break
    return dict(zip(used, w.tolist()))


def _fill(w, t, source, goal, most):
    """Scale each source's cells to its tokens, those at the cap staying there."""
    import numpy as np

    w, cap, free, rest = w.copy(), most[source], np.ones(len(w), bool), goal.copy()
    while True:
        have = np.bincount(source, np.where(free, w * t, 0.0), len(goal))
        factor = np.divide(np.maximum(rest, 0.0), have, out=np.ones_like(rest), where=have > 0)
        full = free & (have > 0)[source] & (w * factor[source] >= cap)
        # Sources without a cell at its cap are done; the others keep these cells and share out the rest again.
        again = np.bincount(source, full, len(goal)) > 0
        done = free & ~again[source]
        w[done] *= factor[source][done]
        if not full.any():
            return w
        w[full] = cap[full]
        rest -= np.bincount(source, np.where(full, w * t, 0.0), len(goal))
        free &= again[source] & ~full


def _bounded(rows: DataFrame, what: str) -> list:
    got = rows.limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} {what}")
    return got


def plan_mixture(docs: DataFrame, targets: DataFrame, total: float | None, fraction: float) -> Plan:
    """``docs``: source, language, topic, tokens. The driver sees one row per cell and target, at most MAX_CELLS of each."""
    rows = _bounded(docs.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens")), "cells of source, language and topic")
    cells = {(r["source"], r["language"], r["topic"]): float(r["tokens"]) for r in rows}
    wanted = {r["source"]: r for r in _bounded(targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")), "targets")}
    sizes: dict = {}
    for (s, _, _), t in cells.items():
        sizes[s] = sizes.get(s, 0) + t
    caps = {s: r["cap"] or 0 for s, r in wanted.items()}
    shares = {s: r["share"] or 0 for s, r in wanted.items()}
    asked = source_tokens(sizes, shares, caps, total if total is not None else fraction * sum(sizes.values()))
    return Plan(asked, rake(cells, asked, caps))


def _cut(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """``source, cut, rest``: the range in which a source's running sum of tokens passes its rest, and what is left of the
    rest at its start; no row for a source whose tokens never do."""
    up = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("in_range")).withColumn("offset", F.coalesce(F.sum("in_range").over(up), F.lit(0)))
    passed = sums.join(rest, "source").filter(F.col("offset") + F.col("in_range") > F.col("rest"))
    first = passed.groupBy("source").agg(F.min(F.struct("range", (F.col("rest") - F.col("offset")).alias("rest"))).alias("at"))
    return first.select("source", F.col("at.range").alias("cut"), F.col("at.rest").alias("rest"))


def draw(docs: DataFrame, plan: Plan, id_col: str, seed: int) -> DataFrame:
    """``id_col, source, tokens, copies`` of the documents that take part. Each document gets the whole part of its
    expected repeats; the last copy goes to those with the smallest hash against their probability, up to the token at
    which the source is full. That ratio is cut into ranges whose tokens are summed up: ranges below the one in which the
    source gets full are taken whole, those above are left, and only this one is cut again in the same way. What is put in
    order is one in RANGES**2 ranges of a source, whatever share of all rows the source has. Repeated rows of a document
    are ordered as one with their number."""
    spark = docs.sparkSession
    cells = spark.createDataFrame([(s, g, t, float(w)) for (s, g, t), w in plan.repeats.items()], "source string, language string, topic string, repeats double")
    asked = spark.createDataFrame([(s, float(t)) for s, t in plan.tokens.items()], "source string, asked double")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(2**53))
    # Cells are unique, so Spark may split a source, language and topic that a third of all rows have.
    part = (
        docs.select(id_col, "source", "language", "topic", "tokens").join(cells, ["source", "language", "topic"])
        .filter("tokens > 0")
        .withColumn("whole", F.floor(F.col("repeats") + F.lit(1e-9)).cast("int"))
        .withColumn("chance", F.greatest(F.col("repeats") - F.col("whole"), F.lit(0.0)))
        .withColumn("ratio", F.when(F.col("chance") > 1e-9, unit / F.col("chance")))
        # In 0 to 1; about half of it lies below the ratio 1, near which sources get full.
        .withColumn("place", F.col("ratio") / (1 + F.col("ratio")) * RANGES)
        .withColumn("range", F.floor("place").cast("int"))
        .drop("language", "topic", "repeats", "chance")
    )
    cols = [id_col, "source", "tokens"]
    sure = part.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("sure"))
    rest = cut_lineage(sure.join(asked, "source").select("source", (F.col("asked") - F.col("sure")).alias("rest")))
    maybe, taken = part.filter("ratio is not null"), part.filter("ratio is null").select(*cols, F.col("whole").alias("copies"))
    for _ in range(2):
        cut = cut_lineage(_cut(maybe, rest))
        placed = maybe.join(F.broadcast(cut.drop("rest")), "source", "left")  # one row per target
        below = F.col("cut").isNull() | (F.col("range") < F.col("cut"))
        taken = taken.unionByName(placed.filter(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).select(*cols, (F.col("whole") + below.cast("int")).alias("copies")))
        maybe = placed.filter(F.col("range") == F.col("cut")).withColumn("place", (F.col("place") - F.col("range")) * RANGES).withColumn("range", F.floor("place").cast("int")).drop("cut")
        rest = cut.select("source", "rest")
    same = maybe.groupBy("source", "ratio", id_col, "tokens", "whole").agg(F.count("*").alias("n"))
    before = F.sum(F.col("n") * F.col("tokens")).over(Window.partitionBy("source").orderBy("ratio", id_col, "tokens", "whole").rowsBetween(Window.unboundedPreceding, -1))
    fit = F.floor((F.col("rest") - F.coalesce(before, F.lit(0)) - F.col("tokens") / 2) / F.col("tokens")) + 1
    last = same.join(F.broadcast(rest), "source").withColumn("fit", fit).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # one row per target
    taken = taken.unionByName(last.select(*cols, (F.col("whole") + (F.col("one") <= F.col("fit")).cast("int")).alias("copies")))
    return taken.filter("copies > 0")


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str, total: float | None = None, fraction: float = 0.5, seed: int = 11) -> DataFrame:
    """Documents of the mixture with their copies. ``docs``: id, source, language, topic, tokens; ``targets``: source,
    target_share, max_repeats. Sources are compared trimmed and in lower case; null sources, languages and topics are
    categories of their own (a null source has no target). ``total`` tokens are asked for, by default ``fraction`` of
    the corpus. Documents without tokens take no part; empty tables give an empty mixture."""
    return draw(docs, plan_mixture(docs, targets, total, fraction), id_col, seed)


def normalised(docs: DataFrame, targets: DataFrame, id_col: str, source: str, language: str, topic: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Documents and targets with source, language and topic in one spelling. The documents are written to the
    checkpoint folder (five short columns), for counting tokens costs more than reading them again."""
    fold = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit("?"))
    d = docs.select(id_col, fold(source).alias("source"), fold(language).alias("language"), fold(topic).alias("topic"), F.col(tokens).alias("tokens"))
    return cut_lineage(d), targets.filter("source is not null").withColumn("source", F.lower(F.trim("source")))


def share_report(mixture: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``target_share, max_repeats, available_tokens, mixed_tokens, repeats`` (mean number of times its
    tokens appear) ``, actual_share``. Sources without target, and targets without source, are listed too."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    want = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = have.join(want, "source", "full").join(got, "source", "left")
    for c in ("available_tokens", "mixed_tokens"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return rows.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), "available_tokens", "mixed_tokens",
        F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).otherwise(0.0).alias("repeats"),
        F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("actual_share"),
    )
