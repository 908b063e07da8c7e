"""Graph analytics over edges (src, dst): levels, closures, call graphs, hierarchies, cycles, fan-out, unused nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables


def levels(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(node, level) of all nodes within ``depth`` steps of ``start`` (node), each at its first level.

    A join for each level; nodes already seen are dropped by an anti join.
    """
    step = edges.select("src", F.col("dst").alias("node")).distinct()
    front = start.select("node").distinct().withColumn("level", F.lit(0))
    seen = front
    for level in range(1, depth + 1):
        reached = front.select(F.col("node").alias("src")).join(step, "src").select("node").distinct()
        front = reached.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, level) of all nodes that can be reached from ``start`` (node), themselves left out, at their first level.

    Each level joins only the nodes that the one before has found first, and is written before the next, so neither
    cycles nor the number of paths matter. Ends when nothing new is reached.
    """
    step = edges.select("src", F.col("dst").alias("node")).distinct()
    first = tables.staged(start.select("node").distinct().withColumn("level", F.lit(0)), "reached")
    found = [first]
    while True:
        seen = reduce(DataFrame.unionByName, found)
        reached = found[-1].select(F.col("node").alias("src")).join(step, "src").select("node").distinct()
        new = reached.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(len(found)))
        found.append(tables.staged(new, "reached"))
        if found[-1].isEmpty():
            return seen.where("level > 0")


def call_graph(edges: DataFrame, start: DataFrame, depth: int = 2, direction: str = "both", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around ``start`` (node): nodes (node, direction, level) within 1 to 3 steps to callees ("out"), callers
    ("in") or both, at most ``most`` of them, nearest first; and among these, edges (src, dst, n_sites) with their number of calls."""
    if direction not in ("in", "out", "both"):
        raise ValueError("in, out or both")
    depth = max(1, min(depth, 3))
    turned = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    wanted = [d for d in ("out", "in") if direction in (d, "both")]
    every = [levels(turned[d], start, depth).where("level > 0").withColumn("direction", F.lit(d)) for d in wanted]
    every.append(start.select("node").distinct().withColumn("level", F.lit(0)).withColumn("direction", F.lit("start")))
    nodes = reduce(DataFrame.unionByName, every).orderBy("level", "direction", "node").limit(most)
    inside = nodes.select("node").distinct()
    among = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, among.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_sites"))


def hierarchy(bases: DataFrame, node, depth: int = 64) -> DataFrame:
    """(relation, node, level) of a type in bases (child, parent): all its ancestors, nearest first, and what derives from it directly."""
    start = bases.sparkSession.createDataFrame([(node,)], bases.select(F.col("child").alias("node")).schema)
    up = closure(bases.select(F.col("child").alias("src"), F.col("parent").alias("dst")), start).where(F.col("level") <= depth).select(F.lit("ancestor").alias("relation"), "node", "level")
    return up.unionByName(bases.where(F.col("parent") == node).select(F.lit("descendant").alias("relation"), F.col("child").alias("node"), F.lit(1).alias("level")).distinct())


def cycles(edges: DataFrame, longest: int = 12, most: int = 25) -> DataFrame:
    """(length, nodes) of simple cycles, each node set once, sorted; paths only go through nodes above their start.

    Nodes without a way in or out are dropped first. A join for each step; of paths with one start, one end and the
    same nodes only one goes on, as they close the same node sets. A path ends when it would be longer than ``longest``.
    """
    step = tables.staged(edges.where("src <> dst").select("src", "dst").distinct(), "step")
    while True:  # what is on a cycle has edges both ways
        kept = step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before, step = step, tables.staged(kept.select("src", "dst"), "step")
        if step.count() == before.count():
            break
        tables.drop(before)
    paths = step.where("dst > src").select(F.col("src").alias("start"), F.array("src", "dst").alias("nodes"), F.col("dst").alias("end"))
    found = None
    for _ in range(2, longest + 1):
        met = paths.join(step, paths["end"] == step["src"])
        closed = met.where(F.col("dst") == F.col("start")).select("nodes")
        found = closed if found is None else found.unionByName(closed)
        ahead = met.where((F.col("dst") > F.col("start")) & ~F.array_contains("nodes", F.col("dst")))
        paths = tables.staged(ahead.select("start", F.array_sort(F.array_append("nodes", F.col("dst"))).alias("nodes"), F.col("dst").alias("end")).distinct(), "paths")
        if paths.isEmpty():
            break
    return found.select(F.array_sort("nodes").alias("nodes")).distinct().select(F.size("nodes").alias("length"), "nodes").orderBy("nodes").limit(most)


def folded(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges between dotted names cut at ``depth`` parts, without those that lead to themselves; cycles, edge_counts and
    fan_out of these are what namespaces depend on."""
    fold = (lambda c: T.fold_namespace(F.col(c), depth)) if depth else F.col
    return edges.select(fold("src").alias("src"), fold("dst").alias("dst")).where("src <> dst")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, n)."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def fan_out(edges: DataFrame, most: int = 20) -> DataFrame:
    """(src, n_targets, n_edges) with the most distinct targets; ties by name."""
    out = edges.where("src <> dst").groupBy("src").agg(F.count_distinct("dst").alias("n_targets"), F.count(F.lit(1)).alias("n_edges"))
    return out.orderBy(F.desc("n_targets"), "src").limit(most)


def unused(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias(node)).distinct(), node, "left_anti")


def implementations(bases: DataFrame, node) -> DataFrame:
    """(node, level) of all types that derive from one, directly or not."""
    start = bases.sparkSession.createDataFrame([(node,)], bases.select(F.col("parent").alias("node")).schema)
    return closure(bases.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start)


def references(edges: DataFrame, node: Column) -> DataFrame:
    """The edges that lead to nodes for which a condition over dst holds."""
    return edges.where(node)


def callers(edges: DataFrame, node: str = "dst", site: str = "site") -> DataFrame:
    """(dst, src, n_sites, sites): callers of each node with their call sites in order."""
    return edges.groupBy(node, "src").agg(F.count(F.lit(1)).alias("n_sites"), F.array_sort(F.collect_list(site)).alias("sites"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes: strongly connected components, each named by its largest node.

    Nodes without a way in or out are components of their own and are trimmed away, again and again. Then the largest name that
    reaches a node colours it; what reaches the node of that name within its colour is its component. These nodes go, and
    the rest is trimmed and coloured anew. Every step is a join of what changed, and is written before the next; a round takes as
    many steps as its longest shortest path, and each round finds a component in every colour.
    """
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    rest = tables.staged(edges.where("src <> dst").select("src", "dst").distinct(), "rest")
    found: list[DataFrame] = []
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        colours = _coloured(rest)
        named = rest.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = tables.staged(named.where("a = b").select("src", "dst", F.col("a").alias("colour")), "inside")
        front = tables.staged(colours.where("node = colour").select("node", "colour"), "reached")
        reached = front
        while True:
            back = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            front = tables.staged(back.join(reached.select("node"), "node", "left_anti"), "reached")
            if front.isEmpty():
                break
            reached = reached.unionByName(front)
        found.append(tables.staged(reached.select("node", F.col("colour").alias("component")), "components"))
        gone = found[-1].select("node")
        kept = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        before, rest = rest, tables.staged(kept.select("src", "dst"), "rest")
        tables.drop(before, inside, colours)
    if not found:
        return every.withColumn("component", F.col("node"))
    return every.join(reduce(DataFrame.unionByName, found), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _trimmed(rest: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out, when no others are left."""
    n = rest.count()
    while n:
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before, rest = rest, tables.staged(kept.select("src", "dst"), "rest")
        tables.drop(before)
        m = rest.count()
        if m == n:
            break
        n = m
    return rest


def _coloured(rest: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches each; only nodes whose colour has changed pass it on."""
    colours = tables.staged(rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "colours")
    changed = colours
    while True:
        sent = changed.select(F.col("node").alias("src"), "colour").join(rest, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        new = colours.join(sent, "node", "left").withColumn("now", F.greatest("colour", "sent"))
        before, colours = colours, tables.staged(new.select("node", F.col("now").alias("colour"), (F.col("now") > F.col("colour")).alias("changed")), "colours")
        changed = colours.where("changed")
        if changed.isEmpty():
            tables.drop(before)
            return colours
        tables.drop(before)
