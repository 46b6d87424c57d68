"""Propagation over graphs whose edges have identities: paths that tell parallel edges apart, roots with their files, model-wide origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.store import ROWS, Levels, Scratch, dealt, materialize

#: A frontier of at most this many rows goes by broadcast to the edges.
SMALL = 100_000


def _hops(level: DataFrame, hop: DataFrame, n_edges: int) -> DataFrame:
    """A frontier (target) joined with the edges that leave it (_src): a small one goes by broadcast, behind a count; a large one meets edges that are
    dealt by their source to as many tasks as they need."""
    if level.count() <= SMALL:
        return hop.join(F.broadcast(level), F.col("_src") == F.col("target"))
    return dealt(hop, n_edges, "_src").join(level, F.col("_src") == F.col("target"))


def _grouped(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df for groups of its keys: many rows are dealt by them first, few are left to partial aggregation."""
    return dealt(df, rows, *keys) if rows > ROWS else df


def _degrees(edges: DataFrame) -> DataFrame:
    """_from and _degree of the nodes that any edge leaves, written."""
    return materialize(edges.where("src IS NOT NULL").groupBy(F.col("src").alias("_from")).agg(F.count("*").alias("_degree")), "degrees")


def enumerate_paths(edges: DataFrame, origins: DataFrame, limit: int = 64) -> DataFrame:
    """The columns of origins (node among them), target, nodes, relationships, depth: every simple path from every origin, each of its prefixes too;
    parallel edges make paths of their own.  edges: src, dst, relationship_id.

    A join and a written table a level; it ends by itself on a graph without cycles, and raises beyond ``limit`` hops.
    """
    level = origins.withColumn("target", F.col("node")).withColumn("nodes", F.array("node")).withColumn("relationships", F.array().cast("array<string>"))
    keep, levels = level.columns, Levels(edges.sparkSession, "depth", "paths")
    hop = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("relationship_id").alias("_id"))
    for depth in range(1, limit + 1):
        step = level.join(hop, level["target"] == hop["_src"]).where(~F.array_contains("nodes", F.col("_dst")))
        step = step.withColumns({"target": F.col("_dst"), "nodes": F.array_append("nodes", F.col("_dst")), "relationships": F.array_append("relationships", F.col("_id"))}).select(*keep)
        level = levels.add(step, depth)
        if level.isEmpty():
            return levels.all()
    raise RuntimeError(f"paths of more than {limit} hops")


def path_counts(edges: DataFrame, origins: DataFrame, uncertain: Column | None = None, limit: int = 64) -> DataFrame:
    """The columns of origins (node among them), target, depth, n_paths, n_uncertain, first_boundary: how many paths of each length lead to each target,
    how many of them pass a relationship that ``uncertain`` (a condition on the edges) holds for, and the smallest of the first such ones.

    Sums along the edges, a level at a time, so no path is written out: a level has a row for each origin and target, of which only those that an edge
    leaves go on, and its sums are dealt to as many tasks as their rows need.  Every walk of a graph without cycles is a simple path; on a graph with one
    the loop does not end, and it raises beyond ``limit`` levels, as does a count beyond a long.
    """
    levels, own, leads, n_edges = Levels(edges.sparkSession, "depth", "counts"), origins.columns, _degrees(edges), edges.count()
    hop = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("relationship_id").alias("_id"), (F.coalesce(uncertain, F.lit(False)) if uncertain is not None else F.lit(False)).alias("_bad"))
    level = origins.groupBy(*own).agg(F.count("*").alias("n_paths")).select(*own, F.col("node").alias("target"), "n_paths", F.lit(0).cast("long").alias("n_uncertain"), F.lit(None).cast("string").alias("first_boundary"))
    for depth in range(1, limit + 1):
        ahead = level.join(leads, level["target"] == leads["_from"])
        rows = ahead.agg(F.coalesce(F.sum("_degree"), F.lit(0))).first()[0]
        if not rows and depth > 1:
            return levels.all()
        step = _grouped(_hops(ahead.select(*level.columns), hop, n_edges), rows, *own, "_dst")
        clean = F.col("n_paths") - F.col("n_uncertain")
        met = F.when(F.col("_bad") & (clean > 0), F.col("_id"))
        level = step.groupBy(*own, F.col("_dst").alias("target")).agg(
            F.sum("n_paths").alias("n_paths"), F.sum(F.when(F.col("_bad"), F.col("n_paths")).otherwise(F.col("n_uncertain"))).alias("n_uncertain"), F.least(F.min("first_boundary"), F.min(met)).alias("first_boundary"),
        )
        level = levels.add(level, depth)
    raise RuntimeError(f"paths of more than {limit} hops")


def signed_paths(edges: DataFrame, origins: DataFrame, limit: int = 64) -> DataFrame:
    """origin, target, depth, signature (128 bits as two longs, a and b), n: every path of a graph without cycles, known by its signature alone.

    The frontier carries two rolling hashes of nodes and relationships in place of lists, so a row is as wide on the last level as on the first, and paths
    of two graphs meet in an equi-join.  Relationships that stand twice make one path (the first wins).
    """
    levels = Levels(edges.sparkSession, "depth", "signed")
    hop = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("relationship_id").alias("_id")).distinct()
    level = origins.select(F.col("node").alias("origin"), F.col("node").alias("target"), F.xxhash64(F.lit(1), "node").alias("a"), F.xxhash64(F.lit(2), "node").alias("b")).distinct()
    for depth in range(1, limit + 1):
        step = level.join(hop, level["target"] == hop["_src"])
        level = levels.add(step.select("origin", F.col("_dst").alias("target"), F.xxhash64("a", "_dst", "_id").alias("a"), F.xxhash64("b", "_id", "_dst").alias("b")), depth)
        if level.isEmpty():
            return levels.all()
    raise RuntimeError(f"paths of more than {limit} hops")


def path_changes(current: DataFrame, future: DataFrame) -> DataFrame:
    """origin, target, depth, state: each path of two ``signed_paths`` as KEPT, REMOVED or ADDED; one exchange by signature."""
    keys = ["origin", "target", "depth", "a", "b"]
    side = current.select(*keys, F.lit(1).alias("_s")).unionByName(future.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.sum("_s").alias("_s"))
    return side.select("origin", "target", "depth", F.when(F.col("_s") == 3, "KEPT").when(F.col("_s") == 1, "REMOVED").otherwise("ADDED").alias("state"))


def marked_edges(current: DataFrame, future: DataFrame) -> DataFrame:
    """src, dst, relationship_id, state of the edges of two graphs: KEPT, REMOVED or ADDED; repeated edges count once."""
    keys = ["src", "dst", "relationship_id"]
    both = current.select(*keys, F.lit(1).alias("_s")).unionByName(future.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    return both.select(*keys, F.when(F.col("_a") < F.col("_b"), "KEPT").when(F.col("_a") == 1, "REMOVED").otherwise("ADDED").alias("state"))


def path_change_counts(marked: DataFrame, origins: DataFrame, limit: int = 64) -> DataFrame:
    """origin, target, depth, n_kept, n_removed, n_added: how many paths of two graphs without cycles are in both, in the current one alone and in the
    future one alone.  marked: ``marked_edges``.

    A path is in both graphs just if all its edges are, so sums along the edges of both count what ``path_changes`` lists, and no path is written: a level
    has a row for each origin and target.  Beyond ``limit`` levels, as on a cycle, it raises.
    """
    levels = Levels(marked.sparkSession, "depth", "changes")
    hop = marked.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "state")
    leads = hop.select("_src").distinct()
    level = origins.select(F.col("node").alias("origin"), F.col("node").alias("target"), *[F.lit(1).cast("long").alias(c) for c in ("n_kept", "_current", "_future")]).distinct()
    of = lambda n, *states: F.sum(F.when(F.col("state").isin(*states), F.col(n)).otherwise(0)).alias(n)
    for depth in range(1, limit + 1):
        step = level.join(leads, F.col("target") == F.col("_src"), "left_semi")
        if step.isEmpty():
            return levels.all().select("origin", "target", "depth", "n_kept", (F.col("_current") - F.col("n_kept")).alias("n_removed"), (F.col("_future") - F.col("n_kept")).alias("n_added"))
        sums = step.join(hop, F.col("target") == F.col("_src")).groupBy("origin", F.col("_dst").alias("target")).agg(of("n_kept", "KEPT"), of("_current", "KEPT", "REMOVED"), of("_future", "KEPT", "ADDED"))
        level = levels.add(sums.where("_current + _future > 0"), depth)
    raise RuntimeError(f"paths of more than {limit} hops")


def _n_paths(paths: DataFrame) -> Column:
    """The number of paths of a group, of paths as rows or of counts."""
    return F.sum("n_paths") if "n_paths" in paths.columns else F.count("*")


def target_exposure(paths: DataFrame, origins: DataFrame) -> DataFrame:
    """Per target that is no origin itself: least depth, path count, multipath, DIRECT or TRANSITIVE.  paths: as enumerated or as counted."""
    found = paths.groupBy("target").agg(F.min("depth").alias("minimum_depth"), _n_paths(paths).alias("path_count"))
    own = found.join(origins.select(F.col("node").alias("target")).distinct(), "target", "left_anti")
    return own.select("target", "minimum_depth", "path_count", (F.col("path_count") > 1).alias("multipath"), F.when(F.col("minimum_depth") == 1, "DIRECT").otherwise("TRANSITIVE").alias("reach"))


def request_exposure(paths: DataFrame) -> DataFrame:
    """Per target: the root causes and files whose paths reach it, and how many paths.  paths: root_id, files (array), target; enumerated or counted."""
    own = paths.groupBy("target").agg(F.array_sort(F.collect_set("root_id")).alias("root_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("files"), _n_paths(paths).alias("path_count"))
    return own.withColumn("multipath", F.col("path_count") > 1)


def overlay(outputs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Outputs of models with their state under semantic deltas: origins are the outputs that a delta names, or all of a model with a model-wide one.

    outputs: model, output; deltas: model, output (null: model-wide).  Adds node_state and n_deltas.
    """
    wide = deltas.where("output is null").groupBy(F.col("model").alias("_m")).agg(F.count("*").alias("_wide"))
    own = deltas.where("output is not null").groupBy(F.col("model").alias("_om"), F.col("output").alias("_o")).agg(F.count("*").alias("_own"))
    found = outputs.join(wide, outputs["model"] == F.col("_m"), "left").join(own, (outputs["model"] == F.col("_om")) & (outputs["output"] == F.col("_o")), "left")
    n = F.coalesce("_wide", F.lit(0)) + F.coalesce("_own", F.lit(0))
    return found.select(*[outputs[c] for c in outputs.columns], F.when(n > 0, "SEMANTIC_ORIGIN").otherwise("INHERITED").alias("node_state"), n.alias("n_deltas"))


def representative_paths(paths: DataFrame, by: str) -> DataFrame:
    """by, kind, nodes: of each group the shortest path, the deepest, and the first one to a target with several paths that is neither; ties go to
    the smallest nodes.  Minima of structs, so groups of any size aggregate before the exchange."""
    counts = paths.groupBy(by, "target").agg(F.count("*").alias("_n"))
    own = paths.join(counts, [by, "target"])
    first = own.groupBy(by).agg(F.min(F.struct("depth", "nodes", "relationships")).alias("a"), F.min(F.struct((-F.col("depth")).alias("depth"), "nodes", "relationships")).alias("b"))
    chosen = first.select(by, F.col("a.relationships").alias("_a"), F.col("b.relationships").alias("_b"))
    third = own.where("_n > 1").join(chosen, by).where((F.col("relationships") != F.col("_a")) & (F.col("relationships") != F.col("_b"))).groupBy(by).agg(F.min(F.struct("depth", "nodes", "relationships")).alias("c"))
    all_ = first.join(third, by, "left")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{c}.nodes").alias("nodes"), F.col(f"{c}.relationships").alias("relationships")) for k, c in (("SHORTEST", "a"), ("DEEPEST", "b"), ("MULTIPATH", "c"))])
    return all_.select(by, F.explode(kinds).alias("p")).where("p.nodes is not null").select(by, "p.kind", "p.nodes", "p.relationships")


def _first(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows of each group with the smallest nodes and relationships; tasks keep n of a group before the exchange."""
    w = Window.partitionBy(*keys).orderBy("nodes", "relationships")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def _longer(paths: DataFrame, hop: DataFrame) -> DataFrame:
    """Few paths, each with every edge that leaves its target."""
    step = hop.join(F.broadcast(paths), F.col("_src") == F.col("target"))
    return step.withColumns({"target": F.col("_dst"), "nodes": F.array_append("nodes", F.col("_dst")), "relationships": F.array_append("relationships", F.col("_id"))}).select(*paths.columns)


def representative_routes(edges: DataFrame, origins: DataFrame, scratch: Scratch, limit: int = 64) -> DataFrame:
    """node, kind, nodes, relationships: what ``representative_paths`` says of all paths of a graph without cycles, none of which is listed.

    ``path_counts`` says which targets have several paths and how long the paths of each kind are.  Of the paths to a node that an edge leaves the three
    smallest of each length are kept: a smallest path has one of the smallest beginnings, and of three at most two are a shortest or a deepest one.  Edges
    to nodes that none leaves are only counted, and asked whether they lead to a target of several paths.  edges: src, dst, relationship_id; origins: node.
    Paths that say the same, of edges that stand twice, count one each.
    """
    edges, origins = edges.where("src IS NOT NULL AND dst IS NOT NULL"), origins.select("node")
    hop, n_edges = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("relationship_id").alias("_id")), edges.count()
    leads, keys = _degrees(edges), ["node", "target"]
    inner = scratch.keep(hop.join(leads, hop["_dst"] == leads["_from"], "left_semi"), "inner")
    n_inner, starts = inner.count(), Levels(edges.sparkSession, "depth", "starts")
    scratch.paths.append(starts.path)
    level = origins.withColumns({"target": F.col("node"), "nodes": F.array("node"), "relationships": F.array().cast("array<string>")}).join(leads, F.col("node") == F.col("_from"), "left_semi")
    level = starts.add(_first(level, 3, *keys), 1)
    for depth in range(2, limit + 2):
        if level.isEmpty():
            break
        if depth > limit:
            raise RuntimeError(f"paths of more than {limit} hops")
        step = _hops(level, inner, n_inner).withColumns({"target": F.col("_dst"), "nodes": F.array_append("nodes", F.col("_dst")), "relationships": F.array_append("relationships", F.col("_id"))}).select(*level.columns)
        level = starts.add(_first(_grouped(step, n_inner, *keys), 3, *keys), depth)
    starts = starts.all()

    counts = path_counts(edges, origins, limit=limit)
    many = dealt(counts.select(*keys, "depth", "n_paths"), counts.count(), *keys).withColumn("_n", F.sum("n_paths").over(Window.partitionBy(*keys)))
    many = scratch.keep(many.where("_n > 1").drop("_n"), "many")
    lengths = counts.groupBy("node").agg(F.min("depth").alias("a"), F.max("depth").alias("b"))
    goals = lengths.select("node", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("depth")) for k, c in (("SHORTEST", "a"), ("DEEPEST", "b"))])).alias("g")).select("node", "g.*")
    ends = scratch.keep(_first(_longer(scratch.keep(_first(starts.join(goals, ["node", "depth"]), 1, "node", "kind"), "begun"), hop), 1, "node", "kind"), "ends")
    taken = ends.select("node", "depth", "target", "nodes", "relationships").distinct()

    spent = taken.join(many.drop("n_paths"), [*keys, "depth"], "left_semi").groupBy("node", "depth").agg(F.count("*").alias("_spent"))
    left = many.groupBy("node", "depth").agg(F.sum("n_paths").alias("_n")).join(spent, ["node", "depth"], "left")
    goal = scratch.keep(left.where(F.col("_n") > F.coalesce("_spent", F.lit(0))).groupBy("node").agg(F.min("depth").alias("depth")), "goal")
    own, wanted = starts.join(goal, ["node", "depth"]), many.join(goal, ["node", "depth"]).select(*keys)
    asked = _hops(own.select(*keys).distinct(), hop.select("_src", "_dst"), n_edges).select("node", "_src", F.col("_dst").alias("target"))
    # wanted has each pair once; a semi join would be pushed below the exchange and lose its number of tasks
    useful = dealt(asked, n_edges, *keys).join(wanted, keys).select("node", F.col("_src").alias("target")).distinct()
    begun = scratch.keep(_first(own.join(useful, keys, "left_semi"), 3, "node"), "begun")
    third = _first(_longer(begun, hop).join(wanted, keys), 3, "node")
    third = third.withColumn("_same", F.row_number().over(Window.partitionBy("node", "nodes", "relationships").orderBy("depth"))).join(taken.withColumn("_taken", F.lit(True)).drop("target", "depth"), ["node", "nodes", "relationships"], "left")
    third = _first(third.where((F.col("_same") > 1) | F.col("_taken").isNull()), 1, "node").withColumn("kind", F.lit("MULTIPATH"))
    return ends.unionByName(third.select(*ends.columns)).select("node", "kind", "nodes", "relationships")


def first_boundary(relationships: Column, uncertain) -> Column:
    """The first relationship of a path that ``uncertain`` holds for, or null."""
    return F.get(F.filter(relationships, uncertain), F.lit(0))
