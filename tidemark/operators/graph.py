"""Lineage graph operators over edge tables (src, dst): frontier loops, bounded path joins, hyper-edge expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.store import Levels, materialize

PATH_CAP = 128


def depths(edges: DataFrame, sources: DataFrame, limit: int = 1000) -> DataFrame:
    """node, depth: the fewest hops from any source, sources at 0.  Safe on cycles.

    One join, anti join and write for each level; all levels are one table.
    """
    pairs, levels = edges.select("src", "dst"), Levels(edges.sparkSession, "depth", "depths")
    frontier = levels.add(sources.select(F.col("node")).distinct(), 0)
    for depth in range(1, limit + 1):
        new = frontier.join(pairs, frontier["node"] == pairs["src"]).select(F.col("dst").alias("node")).distinct().join(levels.all(), "node", "left_anti")
        frontier = levels.add(new, depth)
        if frontier.isEmpty():
            return levels.all()
    raise RuntimeError(f"nodes are still found after {limit} levels; give a larger limit")


def reachable_edges(edges: DataFrame, sources: DataFrame, limit: int = 1000) -> DataFrame:
    """All edges that leave a reachable node, those back into visited nodes too."""
    reached = depths(edges, sources, limit).select(F.col("node").alias("src"))
    return edges.join(reached, "src", "left_semi")


def simple_paths(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """origin, target, hops, nodes: all paths without a repeated node, up to max_hops; parallel edges count once."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    level, levels = sources.select(F.col("node").alias("origin"), F.col("node").alias("target"), F.array("node").alias("nodes")), Levels(edges.sparkSession, "hops", "paths")
    for hops in range(1, max_hops + 1):
        step = level.join(pairs, level["target"] == pairs["src"]).where(~F.array_contains("nodes", F.col("dst")))
        level = levels.add(step.select("origin", F.col("dst").alias("target"), F.array_append("nodes", F.col("dst")).alias("nodes")), hops)
    return levels.all().select("origin", "target", "hops", "nodes")


def marked_paths(edges: DataFrame, sources: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """Simple paths up to max_hops, and for targets beyond them the shortest, then smallest path; and the targets (target) that longer paths may
    reach, so that their paths may not be whole.

    On a cyclic graph simple paths grow exponentially with hops, so they cannot all be listed.  The second table errs to the safe side there: it
    follows edges from the longest paths without asking whether a node repeats.
    """
    paths = simple_paths(edges, sources, max_hops)
    ends = paths.where(F.col("hops") == max_hops)
    pairs = edges.select("src", "dst").where("src <> dst")
    after = ends.join(pairs, ends["target"] == pairs["src"]).where(~F.array_contains("nodes", F.col("dst"))).select(F.col("dst").alias("node")).distinct()
    cut = materialize(depths(edges, after).select(F.col("node").alias("target")).join(sources.select(F.col("node").alias("target")), "target", "left_anti"), "cut")
    every = edges.select(F.col("dst").alias("node")).distinct()
    best = best_paths(edges, sources, every).where(F.size("path") > max_hops + 1)
    beyond = best.select(F.element_at("path", 1).alias("origin"), F.col("node").alias("target"), (F.size("path") - 1).alias("hops"), F.col("path").alias("nodes"))
    return paths.unionByName(beyond), cut


def capped_paths(paths: DataFrame, cap: int = PATH_CAP) -> DataFrame:
    """The first ``cap`` paths of each target in the order of their nodes, with the target's path count and whether it was cut."""
    first = Window.partitionBy("origin", "target").orderBy("nodes")
    counts = paths.groupBy("origin", "target").agg(F.count("*").alias("path_count"))
    ranked = paths.withColumn("path_rank", F.row_number().over(first)).where(F.col("path_rank") <= cap)
    return ranked.join(counts, ["origin", "target"]).withColumn("paths_truncated", F.col("path_count") > cap)


def closing_cycles(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """Cycles met on simple paths: an edge from a path's last node back to a node on it; each cycle once, its smallest node first."""
    pairs = edges.select("src", "dst")
    paths = simple_paths(edges, sources, max_hops - 1).select("nodes", "target").unionByName(sources.select(F.array("node").alias("nodes"), F.col("node").alias("target")))
    back = paths.join(pairs, paths["target"] == pairs["src"]).where(F.array_contains("nodes", F.col("dst")))
    loop = back.select(F.slice("nodes", F.array_position("nodes", F.col("dst")).cast("int"), F.size("nodes")).alias("loop"))
    at = F.array_position("loop", F.array_min("loop")).cast("int")
    return loop.select(F.concat(F.slice("loop", at, F.size("loop")), F.slice("loop", F.lit(1), at - 1)).alias("cycle")).distinct()


def path_exposure(paths: DataFrame) -> DataFrame:
    """Per target: least hops, path count, direct, transitive or multipath state, and nodes that lead into it last."""
    return paths.groupBy("target").agg(
        F.min("hops").alias("depth"), F.count("*").alias("path_count"), F.countDistinct(F.element_at("nodes", -2)).alias("incoming"),
        F.when(F.count("*") > 1, "multipath").when(F.min("hops") == 1, "direct").otherwise("transitive").alias("exposure"),
    )


def classification(upstream: Column, downstream: Column, operation: Column) -> Column:
    """Many to one: DERIVED; no operation: UNKNOWN; copies: DIRECT; else DERIVED."""
    op = F.lower(F.trim(F.coalesce(operation, F.lit(""))))
    return F.when((F.size(upstream) > 1) & (F.size(downstream) == 1), "DERIVED").when(op == "", "UNKNOWN").when(op.isin("none", "identity", "noop", "no_op") | op.startswith("copy"), "DIRECT").otherwise("DERIVED")


def group_state(upstream: Column, downstream: Column, confidence: Column) -> Column:
    """Many to many stays a hyper-edge: it is never multiplied out."""
    empty = F.coalesce(F.size(upstream) < 1, F.lit(True)) | F.coalesce(F.size(downstream) < 1, F.lit(True)) | F.coalesce(~confidence.between(0, 1), F.lit(False))
    return F.when(empty, "MALFORMED").when((F.size(upstream) > 1) & (F.size(downstream) > 1), "AMBIGUOUS").otherwise("EXPANDED")


def expand_groups(groups: DataFrame) -> DataFrame:
    """group_id, src, dst, classification, operation, confidence of the groups that expand."""
    state = group_state(F.col("upstream"), F.col("downstream"), F.col("confidence"))
    kept = groups.where(state == "EXPANDED").withColumn("classification", classification(F.col("upstream"), F.col("downstream"), F.col("operation")))
    return kept.select("*", F.explode("upstream").alias("src")).select("group_id", "src", F.explode("downstream").alias("dst"), "classification", "operation", "confidence")


def consolidate(expanded: DataFrame) -> DataFrame:
    """One edge for each pair: group ids, operations and confidences united; classes that disagree make UNKNOWN."""
    known = F.collect_set(F.when(F.col("classification") != "UNKNOWN", F.col("classification")))
    return expanded.groupBy("src", "dst").agg(
        F.array_sort(F.collect_set("group_id")).alias("group_ids"), F.array_sort(F.collect_set(F.nullif(F.col("operation"), F.lit("")))).alias("operations"),
        F.array_sort(F.collect_set("confidence")).alias("confidences"), known.alias("_known"),
    ).select("src", "dst", "group_ids", "operations", "confidences", F.when(F.size("_known") == 1, F.get("_known", F.lit(0))).otherwise("UNKNOWN").alias("classification"), (F.size("_known") > 1).alias("conflict"))


def best_paths(edges: DataFrame, sources: DataFrame, expandable: DataFrame, max_hops: int = 1000) -> DataFrame:
    """node, path: the shortest, then smallest path to each node; only ``expandable`` nodes (and sources) lead on."""
    pairs = edges.select("src", "dst").distinct()
    levels = Levels(edges.sparkSession, "hops", "best")
    frontier = levels.add(sources.select(F.col("node"), F.array("node").alias("path")).distinct(), 0)
    for hops in range(1, max_hops + 1):
        step = frontier.join(pairs, frontier["node"] == pairs["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        new = levels.add(step.groupBy("node").agg(F.min("path").alias("path")).join(levels.all().select("node"), "node", "left_anti"), hops)
        if new.isEmpty():
            return levels.all().select("node", "path")
        frontier = new.join(expandable.select("node").distinct(), "node", "left_semi")
    raise RuntimeError(f"paths still grow after {max_hops} hops; give a larger max_hops")


def dataset_index(fields: DataFrame) -> DataFrame:
    return fields.groupBy("dataset_urn").agg(F.array_sort(F.collect_set("field_path")).alias("field_paths"), F.countDistinct("field_path").alias("n_fields"))


def chained(actions: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each action depends on the one before it in its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return actions.withColumn("depends_on", F.lag("action_id").over(w)).withColumn("position", F.row_number().over(w))


def topological_order(actions: list[tuple[str, list[str]]]) -> list[str]:
    """Kahn's order of a bounded plan (at most 500 actions), ready ids in first-in order from a sorted start; raises on unknown ids and cycles."""
    if len(actions) > 500:
        raise ValueError("a plan holds at most 500 actions")
    ids = {a for a, _ in actions}
    if unknown := {d for _, deps in actions for d in deps} - ids:
        raise ValueError(f"unknown dependencies: {sorted(unknown)}")
    waits = {a: set(deps) for a, deps in actions}
    ready, out = sorted(a for a, deps in waits.items() if not deps), []
    while ready:
        a = ready.pop(0)
        out.append(a)
        freed = sorted(b for b, deps in waits.items() if a in deps and len(deps) == 1)
        for deps in waits.values():
            deps.discard(a)
        ready += freed
    if len(out) < len(ids):
        raise ValueError("dependencies form a cycle")
    return out


def rebase(df: DataFrame, columns: list[str], old, new) -> DataFrame:
    """The same rows with one key renamed wherever it stands, in scalar and array columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        if isinstance(kinds[c], T.ArrayType):
            df = df.withColumn(c, F.transform(c, lambda k: F.when(k == F.lit(old), F.lit(new)).otherwise(k)))
        else:
            df = df.withColumn(c, F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(F.col(c)))
    return df


def composite(*layers: tuple[str, DataFrame]) -> DataFrame:
    """src, dst, state: edges of several sources; where two have the same edge, the earlier layer's state stands."""
    out = None
    for rank, (state, df) in enumerate(layers):
        part = df.select("src", "dst", F.lit(state).alias("state"), F.lit(rank).alias("_rank"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("src", "dst").agg(F.min(F.struct("_rank", "state")).alias("m")).select("src", "dst", F.col("m.state").alias("state"))


def graph_diff(current: DataFrame, future: DataFrame) -> DataFrame:
    """src, dst, state: UNCHANGED, REMOVED or ADDED."""
    a, b = current.select("src", "dst").distinct().withColumn("a", F.lit(1)), future.select("src", "dst").distinct().withColumn("b", F.lit(1))
    return a.join(b, ["src", "dst"], "full_outer").select("src", "dst", F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("UNCHANGED").alias("state"))
