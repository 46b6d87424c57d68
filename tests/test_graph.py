import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def node(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_depths_on_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    assert {tuple(r) for r in graph.depths(e, node(spark, "a")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in graph.depths(e, node(spark, "a", "x")).collect()} == {("a", 0), ("b", 1), ("c", 2), ("x", 0), ("y", 1)}
    assert graph.depths(e, node(spark, "nowhere")).count() == 1
    assert graph.reachable_edges(e, node(spark, "a")).count() == 3


def test_deep_chain(spark):
    e = edges(spark, [(str(i), str(i + 1)) for i in range(20)])
    assert graph.depths(e, node(spark, "0")).agg(F.max("depth")).first()[0] == 20


def test_diamond_paths(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b")])
    p = graph.simple_paths(e, node(spark, "a"), 5)
    assert sorted((r["target"], ">".join(r["nodes"])) for r in p.collect()) == [("b", "a>b"), ("c", "a>c"), ("d", "a>b>d"), ("d", "a>c>d")]
    x = {r["target"]: (r["depth"], r["path_count"], r["incoming"], r["exposure"]) for r in graph.path_exposure(p).collect()}
    assert x == {"b": (1, 1, 1, "direct"), "c": (1, 1, 1, "direct"), "d": (2, 2, 2, "multipath")}
    capped = graph.capped_paths(p, 1).collect()
    assert {(r["target"], r["path_count"], r["paths_truncated"]) for r in capped} == {("b", 1, False), ("c", 1, False), ("d", 2, True)}


def test_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "d")])
    assert sorted(r[0] for r in graph.closing_cycles(e, node(spark, "a"), 4).collect()) == [["a", "b", "c"], ["b", "c"]]


GROUPS = [
    ("one", ["A"], ["x"], "identity", 0.5), ("fan", ["A"], ["b", "c"], "cast", 1.0), ("merge", ["A", "X"], ["m"], "identity", None), ("hyper", ["A", "X"], ["l", "r"], "sum", 0.5),
    ("empty", ["A"], [], "sum", 0.5), ("null", None, ["q"], "sum", 0.5), ("bad", ["A"], ["z"], "sum", 1.5), ("again", ["A"], ["x"], "sum", 0.8), ("blank", ["A"], ["u"], " ", 0.1), ("copy", ["A"], ["v"], "COPY_FIELD", 0.1),
]


def groups(spark):
    return spark.createDataFrame(GROUPS, "group_id string, upstream array<string>, downstream array<string>, operation string, confidence double")


def test_hyper_edges(spark):
    g = groups(spark)
    states = {r[0]: r[1] for r in g.select("group_id", graph.group_state(F.col("upstream"), F.col("downstream"), F.col("confidence"))).collect()}
    assert states == {"one": "EXPANDED", "fan": "EXPANDED", "merge": "EXPANDED", "hyper": "AMBIGUOUS", "empty": "MALFORMED", "null": "MALFORMED", "bad": "MALFORMED", "again": "EXPANDED", "blank": "EXPANDED", "copy": "EXPANDED"}
    e = {(r["src"], r["dst"]): r for r in graph.consolidate(graph.expand_groups(g)).collect()}
    assert set(e) == {("A", "x"), ("A", "b"), ("A", "c"), ("A", "m"), ("X", "m"), ("A", "u"), ("A", "v")}
    x = e[("A", "x")]
    assert x["group_ids"] == ["again", "one"] and x["confidences"] == [0.5, 0.8] and x["classification"] == "UNKNOWN" and x["conflict"]
    assert [e[("A", k)]["classification"] for k in "bmuv"] == ["DERIVED", "DERIVED", "UNKNOWN", "DIRECT"]


def test_best_paths_stop_at_closed_nodes(spark):
    e = edges(spark, [("s", "d2"), ("s", "d1"), ("d1", "chart"), ("d2", "chart"), ("chart", "dash"), ("dash", "beyond")])
    best = graph.best_paths(e, node(spark, "s"), node(spark, "d1", "d2", "chart"), 9)
    assert {r["node"]: ">".join(r["path"]) for r in best.collect()} == {"s": "s", "d1": "s>d1", "d2": "s>d2", "chart": "s>d1>chart", "dash": "s>d1>chart>dash"}


def test_orders(spark):
    assert graph.topological_order([("c", ["a"]), ("b", []), ("a", [])]) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_order([("a", ["b"]), ("b", ["a"])])
    with pytest.raises(ValueError, match="unknown"):
        graph.topological_order([("a", ["z"])])
    df = spark.createDataFrame([("g", "x", 2), ("g", "y", 1), ("h", "z", 1)], "grp string, action_id string, rank int")
    assert {(r["action_id"], r["depends_on"], r["position"]) for r in graph.chained(df, "grp", ["rank"]).collect()} == {("y", None, 1), ("x", "y", 2), ("z", None, 1)}


def test_projection_and_layers(spark):
    e = edges(spark, [("a", "b"), ("b", "c")])
    f = graph.rebase(e, ["src", "dst"], "b", "B")
    assert {tuple(r) for r in graph.graph_diff(e, f).collect()} == {("a", "b", "REMOVED"), ("b", "c", "REMOVED"), ("a", "B", "ADDED"), ("B", "c", "ADDED")}
    assert {tuple(r) for r in graph.composite(("OBSERVED", e), ("UNRESOLVED", edges(spark, [("a", "b"), ("q", "r")]))).collect()} == {("a", "b", "OBSERVED"), ("b", "c", "OBSERVED"), ("q", "r", "UNRESOLVED")}
    arrays = spark.createDataFrame([(["a", "b"],)], "k array<string>")
    assert graph.rebase(arrays, ["k"], "b", "B").first()[0] == ["a", "B"]


def test_targets_beyond_the_hops_are_kept_and_marked(spark):
    # 0 -> 5 -> 3 -> 7 -> 1 -> 2 with a downward edge and one target off the longer paths
    edges = spark.createDataFrame([(0, 5), (5, 3), (3, 7), (7, 1), (1, 2), (0, 9), (7, 3)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "node long")
    paths, cut = graph.marked_paths(edges, root, 3)
    assert {(r["target"], r["hops"], tuple(r["nodes"])) for r in paths.collect()} == {(5, 1, (0, 5)), (9, 1, (0, 9)), (3, 2, (0, 5, 3)), (7, 3, (0, 5, 3, 7)), (1, 4, (0, 5, 3, 7, 1)), (2, 5, (0, 5, 3, 7, 1, 2))}
    assert {r[0] for r in cut.collect()} == {1, 2}
    best = graph.best_paths(edges, root, edges.selectExpr("dst AS node").distinct())
    assert {r["node"]: len(r["path"]) - 1 for r in best.collect()} == {0: 0, 5: 1, 9: 1, 3: 2, 7: 3, 1: 4, 2: 5}


def test_path_queries_reach_all_fields(spark):
    from tidemark.plans import catalog

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    reached = {r["node"]: r["depth"] for r in catalog.QUERIES["e06_reach_depths"](spark, data).collect() if r["depth"]}
    assert {r["target"]: r["depth"] for r in catalog.QUERIES["e19_path_exposure"](spark, data).collect()} == reached
    capped = catalog.QUERIES["e07_capped_paths"](spark, data).collect()
    assert {r["target"] for r in capped} == set(reached) and any(r["paths_truncated"] for r in capped)


def test_composite_takes_every_ambiguous_group(spark):
    import duckdb

    from tidemark.plans import catalog

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = catalog.QUERIES["e13_composite_graph"](spark, data).select("state", "n").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select state, n from ({catalog.ORACLE_SQL['e13_composite_graph']})").fetchall())


def test_paths_tell_parallel_edges_apart(spark):
    from tidemark.operators import propagation

    edges = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2"), ("b", "c", "3"), ("c", "a", "4")], "src string, dst string, relationship_id string")
    origins = spark.createDataFrame([("a", "r1"), ("b", "r2")], "node string, root_id string")
    paths = propagation.enumerate_paths(edges, origins)
    assert sorted((r["root_id"], r["target"], "".join(r["relationships"])) for r in paths.collect()) == [("r1", "b", "1"), ("r1", "b", "2"), ("r1", "c", "13"), ("r1", "c", "23"), ("r2", "a", "34"), ("r2", "c", "3")]
    exposed = {r["target"]: (r["minimum_depth"], r["path_count"], r["multipath"], r["reach"]) for r in propagation.target_exposure(paths, origins).collect()}
    assert exposed == {"c": (1, 3, True, "DIRECT")}
    assert propagation.enumerate_paths(edges, origins.limit(0)).count() == 0


def test_overlay_takes_all_outputs_of_a_wide_delta(spark):
    from tidemark.operators import propagation

    outputs = spark.createDataFrame([("m", "x"), ("m", "y"), ("n", "x"), ("n", "y")], "model string, output string")
    deltas = spark.createDataFrame([("m", None), ("m", "x"), ("n", "y")], "model string, output string")
    got = {(r["model"], r["output"]): (r["node_state"], r["n_deltas"]) for r in propagation.overlay(outputs, deltas).collect()}
    assert got == {("m", "x"): ("SEMANTIC_ORIGIN", 2), ("m", "y"): ("SEMANTIC_ORIGIN", 1), ("n", "x"): ("INHERITED", 0), ("n", "y"): ("SEMANTIC_ORIGIN", 1)}


def test_counts_and_signatures_equal_enumerated_paths(spark):
    import random

    from tidemark.operators import propagation

    rnd = random.Random(6)
    pairs = [(f"n{a}", f"n{b}", f"r{i}{'!' if rnd.random() < 0.2 else ''}") for i, (a, b) in enumerate((rnd.randrange(9), rnd.randrange(9)) for _ in range(30)) if a < b]
    edges, origins = spark.createDataFrame(pairs, "src string, dst string, relationship_id string"), spark.createDataFrame([("n0", "x"), ("n2", "y"), ("n2", "z")], "node string, tag string")
    paths = propagation.enumerate_paths(edges, origins).collect()
    want = {}
    for r in paths:
        bad = next((x for x in r["relationships"] if x.endswith("!")), None)
        own = want.setdefault((r["node"], r["tag"], r["target"], r["depth"]), [0, 0, []])
        own[0], own[1] = own[0] + 1, own[1] + (bad is not None)
        own[2] += [bad] if bad else []
    got = propagation.path_counts(edges, origins, F.endswith("relationship_id", F.lit("!"))).collect()
    assert {(r["node"], r["tag"], r["target"], r["depth"]): [r["n_paths"], r["n_uncertain"], r["first_boundary"]] for r in got} == {k: [n, u, min(b, default=None)] for k, (n, u, b) in want.items()}
    signed = propagation.signed_paths(edges, origins)
    assert signed.count() == len({(r["node"], tuple(r["relationships"])) for r in paths}) == signed.select("a", "b").distinct().count()
    less = edges.where("relationship_id <> 'r1' AND relationship_id <> 'r1!'").unionByName(spark.createDataFrame([("n0", "n8", "new")], edges.schema))
    states = {}
    for r in propagation.path_changes(signed, propagation.signed_paths(less, origins)).collect():
        states[r["state"]] = states.get(r["state"], 0) + 1
    after = {(r["node"], tuple(r["relationships"])) for r in propagation.enumerate_paths(less, origins).collect()}
    before = {(r["node"], tuple(r["relationships"])) for r in paths}
    assert states == {k: v for k, v in (("KEPT", len(after & before)), ("ADDED", len(after - before)), ("REMOVED", len(before - after))) if v}
    ring = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2")], edges.schema)
    with pytest.raises(RuntimeError, match="hops"):
        propagation.path_counts(ring, spark.createDataFrame([("a",)], "node string"), limit=5)


def test_path_changes_are_counted_along_marked_edges(spark):
    import random

    from tidemark.operators import propagation

    rnd = random.Random(8)
    pairs = [(f"n{a}", f"n{b}", f"r{i}") for i, (a, b) in enumerate((rnd.randrange(8), rnd.randrange(8)) for _ in range(30)) if a < b]
    edges, origins = spark.createDataFrame(pairs + pairs[:3], "src string, dst string, relationship_id string"), spark.createDataFrame([("n0",), ("n1",), ("n1",)], "node string")
    gone = next(p for p in pairs if p[0] in ("n0", "n1"))
    moved = spark.createDataFrame([p if i % 5 else ("n0", p[1], p[2]) for i, p in enumerate(pairs) if p != gone] + [("n0", "n9", "new")], edges.schema)
    want = {}
    for r in propagation.path_changes(propagation.signed_paths(edges, origins), propagation.signed_paths(moved, origins)).collect():
        want.setdefault((r["origin"], r["target"], r["depth"]), {"KEPT": 0, "REMOVED": 0, "ADDED": 0})[r["state"]] += 1
    found = propagation.path_change_counts(propagation.marked_edges(edges, moved), origins).collect()
    assert {(r.origin, r.target, r.depth): {"KEPT": r.n_kept, "REMOVED": r.n_removed, "ADDED": r.n_added} for r in found} == want and len({v for w in want.values() for v in w if w[v]}) == 3
    ring = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2")], edges.schema)
    with pytest.raises(RuntimeError, match="hops"):
        propagation.path_change_counts(propagation.marked_edges(ring, ring), spark.createDataFrame([("a",)], "node string"), limit=5)
