"""Bounded views for people: filtered subgraphs, lookups, representative paths, first boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_NODES, MAX_EDGES, MAX_PATHS, MAX_EVIDENCE = 160, 240, 12, 100


def text_filter(columns: list[str], text: str) -> Column:
    """Any of the columns holds the text, case aside."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return out


def induced(nodes: DataFrame, edges: DataFrame, keep: Column, incident_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes that pass and the edges between them; with ``incident_only`` nodes without such an edge go too."""
    own = nodes.where(keep)
    ids = own.select("node")
    e = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])
    if incident_only:
        ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        own = own.join(ends, "node", "left_semi")
    return own, e


def bounded(nodes: DataFrame, edges: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """The first nodes in order, and edges whose both ends are among them (a view's limits)."""
    own = nodes.orderBy(*order).limit(MAX_NODES)
    ids = own.select("node")
    e = edges.join(F.broadcast(ids.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("node", "dst")), "dst", "left_semi")
    return own, e.orderBy("src", "dst").limit(MAX_EDGES)


def representative(paths: DataFrame) -> DataFrame:
    """kind, target, hops, nodes: the shortest path, the deepest, and the first to a target of several paths that is neither."""
    shortest = paths.orderBy("hops", "nodes").limit(1).select(F.lit("shortest").alias("kind"), "target", "hops", "nodes")
    deepest = paths.orderBy(F.desc("hops"), "nodes").limit(1).select(F.lit("deepest").alias("kind"), "target", "hops", "nodes")
    chosen = shortest.unionByName(deepest)
    several = paths.groupBy("target").count().where("count > 1").select("target")
    rest = paths.join(several, "target", "left_semi").join(F.broadcast(chosen.select("nodes")), "nodes", "left_anti")
    return chosen.unionByName(rest.orderBy("hops", "nodes").limit(1).select(F.lit("multipath").alias("kind"), "target", "hops", "nodes")).dropDuplicates(["kind"])


def first_boundary(states: Column, wanted: list[str]) -> Column:
    """The place (from 1) of the first state on a path that is one of those wanted; null if none."""
    at = F.filter(F.sequence(F.lit(1), F.size(states)), lambda i: F.element_at(states, i).isin(*wanted))
    return F.when(F.size(states) > 0, F.try_element_at(at, F.lit(1)))


def presence(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, "present").otherwise("absent")


def edge_category(src_dataset: Column, dst_dataset: Column, classification: Column) -> Column:
    return F.when(src_dataset == dst_dataset, "INTERNAL").when(classification == "UNKNOWN", "UNVERIFIED").otherwise("CROSS_DATASET")


def questions(uncertain: DataFrame, subject: str, state: str) -> DataFrame:
    """A question and the evidence it needs for each subject in doubt."""
    ask = F.format_string("Does %s accept the change? Its state is %s.", F.col(subject).cast("string"), F.col(state))
    return uncertain.select(subject, ask.alias("question"), F.when(F.col(state) == "UNKNOWN", "owner_confirmation").otherwise("test_run").alias("required_evidence"))


def narrative(disposition: Column, technical: Column, severity: Column, datasets: Column) -> Column:
    return F.format_string("Decision: %s. Technical impact is %s over %s datasets, severity %s.", F.coalesce(disposition, F.lit("undecided")), F.lower(technical), datasets.cast("string"), F.lower(severity))


def lookup(results: DataFrame, key: str, value) -> DataFrame:
    return results.where(F.col(key) == F.lit(value))
