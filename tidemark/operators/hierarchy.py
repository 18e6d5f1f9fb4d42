"""Parent-child links to full hierarchies: root, depth, path, descendants and circles.

A frontier grows from the roots level by level: each level is one equi-join of the nodes not yet reached with those
reached in the level before, and what it reaches waits no more, so all levels together move each node about as often as it
is deep. Once a level reaches few of those that wait (long chains, circles and what hangs below circles) the rest is settled
by pointer doubling, whose rounds grow with the logarithm of the chain length only, so no depth is cut off and no circle
loops for ever. Only node keys and numbers move; nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import count_written, cut_lineage

#: The frontier goes on while a level reaches one in so many of the nodes that still wait.
SLOW = 4


def resolve_parents(notes: DataFrame, id_col: str, up: str, down: str, key) -> DataFrame:
    """``id, parent`` per node. The parent is the node its ``up`` link names; if that names none, the smallest node
    whose ``down`` link names it. ``key`` maps a link or an id to its form of comparison. Null and unknown links name
    nothing. Of ids that are equal in that form the smallest is named."""
    nodes = notes.select(F.col(id_col).alias("id"), key(id_col).alias("k"), key(up).alias("up_k"), key(down).alias("down_k"))
    named = nodes.groupBy("k").agg(F.min("id").alias("named_id"))
    below = nodes.filter(F.col("down_k").isNotNull()).groupBy(F.col("down_k").alias("bk")).agg(F.min("id").alias("below_of"))
    above = named.select(F.col("k").alias("uk"), F.col("named_id").alias("above"))
    return (
        nodes.join(above, F.col("up_k") == F.col("uk"), "left")
        .join(below, F.col("k") == F.col("bk"), "left")
        .select("id", F.coalesce("above", "below_of").alias("parent"))
    )


def resolve_hierarchy(links: DataFrame, levels: int | None = None, with_path: bool = False) -> DataFrame:
    """Of ``links(id, parent)`` one row per id: ``id, parent, root_id, depth, on_cycle`` and, if asked, ``path`` (ids
    from the root to the node). A null parent, or one that is no id, makes a root of depth 0. Nodes on a circle or
    below one get the smallest id on that circle as root and depth -1, and a null path. Repeated rows of an id count
    once (the smallest parent); rows without id are ignored; an empty table gives an empty result. ``levels``: of the
    frontier before pointers double; by default as long as a level reaches one in SLOW of those that still wait."""
    nodes = links.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    known = nodes.select(F.col("id").alias("_known"))
    nodes = cut_lineage(
        nodes.join(known, F.col("parent") == F.col("_known"), "left").select("id", F.col("_known").alias("parent"))
    )
    path = ["path"] if with_path else []
    base = ["id", "parent", "root_id", "depth", *path]
    frontier = nodes.filter("parent is null").select("id", "parent", F.col("id").alias("root_id"), F.lit(0).alias("depth"), *([F.array("id").alias("path")] if with_path else []))
    waiting = nodes.filter("parent is not null")
    reached, left, depth = [frontier], count_written(waiting), 0
    while left:
        depth += 1
        top = frontier.select(F.col("id").alias("_pid"), F.col("root_id").alias("_root"), *[F.col(c).alias("_path") for c in path])
        step = cut_lineage(waiting.select("id", "parent").join(top, F.col("parent") == F.col("_pid"), "left"))
        frontier = step.filter("_pid is not null").select(
            "id", "parent", F.col("_root").alias("root_id"), F.lit(depth).alias("depth"), *([F.concat("_path", F.array("id")).alias("path")] if with_path else [])
        )
        waiting = step.filter("_pid is null")
        found = count_written(frontier)
        if found == 0:
            break
        left -= found
        reached.append(frontier)
        if depth == levels or (levels is None and found * SLOW < left):
            break
    out = reached[0].select(*base)
    for part in reached[1:]:
        out = out.unionByName(part.select(*base))
    out = out.withColumn("on_cycle", F.lit(False))
    if left:
        out = out.unionByName(_settle(waiting.select("id", "parent"), out, left, with_path))
    return out


def _settle(residue: DataFrame, reached: DataFrame, count: int, with_path: bool) -> DataFrame:
    """Root and depth of nodes the frontier didn't reach, by pointer doubling."""
    inside = residue.select(F.col("id").alias("_in"))
    # up: the ancestor `hops` steps above, still inside the residue; over: the first ancestor outside of it.
    jump = residue.join(inside, F.col("parent") == F.col("_in"), "left").select(
        "id", F.col("_in").alias("up"), F.when(F.col("_in").isNull(), F.col("parent")).alias("over"), F.lit(1).alias("hops"), F.col("id").alias("least")
    )
    jump, seen = cut_lineage(jump), None
    for _ in range(max(1, math.ceil(math.log2(count + 1)))):
        at = jump.select(F.col("id").alias("_a"), F.col("up").alias("_up"), F.col("over").alias("_over"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        jump = cut_lineage(
            jump.join(at, F.col("up") == F.col("_a"), "left").select(
                "id",
                F.col("_up").alias("up"),
                F.coalesce("over", "_over").alias("over"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                F.least("least", "_least").alias("least"),
                (F.col("up").isNotNull() & (F.col("_least") < F.col("least"))).alias("smaller"),
            )
        )
        open_ = jump.filter("up is not null").groupBy("up").agg(F.max("smaller").alias("smaller")).agg(F.count("*").alias("n"), F.max("smaller").alias("s")).first()
        # Nothing stands any more; or the nodes pointed at are as many as before, so that pointing permutes them and
        # they are the circles, and no node found a smaller id, so that each pointer has gone all around its circle.
        if open_["n"] == 0 or (open_["n"] == seen and not open_["s"]):
            break
        seen = open_["n"]
    # Every pointer that still stands is on its circle.
    tops = reached.select(F.col("id").alias("_t"), "root_id", "depth", *(["path"] if with_path else []))
    deep = jump.filter("over is not null").join(tops, F.col("over") == F.col("_t"), "inner")
    rings = jump.filter("over is null").select("id", F.col("up").alias("ring_at"))
    ring_nodes = jump.filter("over is null").select(F.col("id").alias("_r"), F.col("least").alias("ring_least"))
    ringed = rings.join(ring_nodes, F.col("ring_at") == F.col("_r"), "inner")
    on_ring = rings.select(F.col("ring_at").alias("_on")).distinct()
    ringed = ringed.join(on_ring, F.col("id") == F.col("_on"), "left").select(
        "id", F.col("ring_least").alias("root_id"), F.lit(-1).alias("depth"), F.col("_on").isNotNull().alias("on_cycle")
    )
    deep_rows = deep.select("id", "root_id", (F.col("depth") + F.col("hops")).alias("depth"), F.lit(False).alias("on_cycle"))
    parents = residue.select(F.col("id").alias("_p"), "parent")
    if not with_path:
        return deep_rows.unionByName(ringed).join(parents, F.col("id") == F.col("_p")).select("id", "parent", "root_id", "depth", "on_cycle")
    deep_paths = _deep_paths(residue.join(deep.select(F.col("id").alias("_d")), F.col("id") == F.col("_d"), "left_semi"), tops)
    rows = deep_rows.join(deep_paths, "id").unionByName(ringed.withColumn("path", F.lit(None).cast("array<string>")))
    return rows.join(parents, F.col("id") == F.col("_p")).select("id", "parent", "root_id", "depth", "path", "on_cycle")


def _deep_paths(chain: DataFrame, tops: DataFrame) -> DataFrame:
    """Paths of nodes without circles above them: pieces double until each begins below a reached node."""
    piece = cut_lineage(chain.select("id", F.col("parent").alias("up"), F.array("id").alias("piece")))
    while True:
        at = piece.select(F.col("id").alias("_a"), F.col("up").alias("_up"), F.col("piece").alias("_piece"))
        joined = piece.join(at, F.col("up") == F.col("_a"), "left")
        if joined.filter("_a is not null").isEmpty():
            break
        piece = cut_lineage(
            joined.select("id", F.when(F.col("_a").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"), F.when(F.col("_a").isNotNull(), F.concat("_piece", "piece")).otherwise(F.col("piece")).alias("piece"))
        )
    return piece.join(tops, F.col("up") == F.col("_t")).select("id", F.concat("path", "piece").alias("path"))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` (the least number of steps) of ``resolve_hierarchy(..., with_path=True)``; a node
    isn't its own descendant. On a circle each node is a descendant of each other one, and what hangs below a circle
    descends from all its nodes. Rows: the sum of the numbers of ancestors, as the result needs."""
    # Written once: its plan is long, and it is read three times.
    hierarchy = cut_lineage(hierarchy)
    pairs = _along_paths(hierarchy.filter(F.col("path").isNotNull()))
    ringed = cut_lineage(hierarchy.filter("depth < 0").select("id", "parent", "root_id"))
    if ringed.isEmpty():
        return pairs
    # Each circle is cut above its smallest id, which makes a tree of it and all below: so far up paths give the pairs.
    # From the smallest id on the way goes to the end of the circle, and back along it to where the node's path left it.
    on = hierarchy.filter("on_cycle").select(F.col("id").alias("_on"))
    tree = resolve_hierarchy(ringed.select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent")), with_path=True)
    tree = cut_lineage(tree.join(on, F.col("id") == F.col("_on"), "left").select("id", "root_id", "depth", "path", F.col("_on").isNotNull().alias("on")))
    rings = tree.filter("on").groupBy("root_id").agg(F.max_by("path", "depth").alias("ring"))
    shared = F.size(F.array_intersect("path", "ring"))
    rest = tree.join(rings, "root_id").select(F.col("id").alias("descendant"), "depth", F.size("ring").alias("length"), shared.alias("shared"), F.posexplode("ring").alias("_at", "ancestor"))
    back = rest.filter(F.col("_at") >= F.col("shared")).select("ancestor", "descendant", (F.col("depth") + F.col("length") - F.col("_at")).alias("distance"))
    return pairs.unionByName(_along_paths(tree)).unionByName(back)


def _along_paths(hierarchy: DataFrame) -> DataFrame:
    pairs = hierarchy.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("_at", "ancestor"))
    return pairs.filter(F.col("_at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))
