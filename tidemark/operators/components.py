"""Strongly connected components of an edge table, and cycles without a bound on their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import Scratch
from .graph import best_paths


def _trimmed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges without those of nodes that no edge enters or none leaves, again and again: such nodes are on no cycle."""
    n = edges.count()
    while n:
        inside = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        left = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi").join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")
        left = scratch.keep(left.select("src", "dst"), "trimmed")
        edges, before, n = left, n, left.count()
        if n == before:
            break
    return edges


def _spread(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's greatest label of all nodes that lead to it (its own among them).  labels: node, label.

    Only labels that rose in a round go on; a round is two exchanges, of the edges' sources and of their targets, with a partial maximum before the second.
    """
    moved = labels
    while True:
        seen = edges.join(moved.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("seen"))
        step = labels.join(seen, "node", "left").select("node", F.greatest("label", F.coalesce("seen", "label")).alias("label"), (F.col("seen") > F.col("label")).alias("rose"))
        step = scratch.keep(step, "labels")
        labels, moved = step.select("node", "label"), step.where("rose").select("node", "label")
        if moved.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that an edge touches; a node on no cycle is a component of its own.

    Nodes that cannot lie on a cycle are trimmed.  Of what is left, each node takes the greatest node that leads to it as its colour; within a
    colour, what leads back to that node is its component, which is taken out, and so on: every round finds a component of each colour at least.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        pairs = scratch.keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
        nodes = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
        found: list[DataFrame] = []
        left = _trimmed(pairs.where("src <> dst"), scratch)
        while not left.isEmpty():
            inside = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
            colour = _spread(left, scratch.keep(inside.select("node", F.col("node").alias("label")), "labels"), scratch)
            a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
            same = scratch.keep(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"), "colours")
            # against the edges, from each colour's own node: 1 reaches it, 0 does not
            roots = scratch.keep(colour.select("node", (F.col("node") == F.col("label")).cast("int").alias("label")), "roots")
            back = _spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots, scratch)
            part = scratch.keep(back.where("label = 1").select("node").join(colour, "node"), "component")
            found.append(part)
            rest = left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
            left = _trimmed(scratch.keep(rest.select("src", "dst"), "rest"), scratch)
        members = nodes.select("node", F.col("node").alias("component"))
        if found:
            every = found[0]
            for more in found[1:]:
                every = every.unionByName(more)
            least = every.groupBy("label").agg(F.min("node").alias("least"))
            members = nodes.join(every.join(least, "label").select("node", "least"), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
        return scratch.result(members, "components")


def closed_on_best_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """cycle, src, dst: for each edge that leads back to a node on its source's shortest, then smallest path from the sources, the nodes from there to
    the edge's end; no bound on their number.

    There are no more such cycles than edges, one for each edge back; cycles closed only beside the shortest paths are in
    ``strong_components``, not here.
    """
    reached = best_paths(edges, sources, edges.select(F.col("src").alias("node")).distinct())
    back = edges.select("src", "dst").distinct().join(reached.withColumnRenamed("node", "src"), "src").where(F.array_contains("path", F.col("dst")))
    return back.select(F.slice("path", F.array_position("path", F.col("dst")).cast("int"), F.size("path")).alias("cycle"), "src", "dst")
