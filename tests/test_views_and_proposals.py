import pytest
from pyspark.sql import functions as F

from tidemark.operators import presentation, proposals, resolve

GOOD = {"proposal_id": "p", "analysis_id": "a", "operation": "FIELD_RENAME", "dataset_urn": "D", "current_field_path": "total", "source_snapshot_fingerprint": "sha256:1", "proposed_field_path": "amount"}


def test_shapes():
    assert proposals.validated(GOOD) is GOOD
    for bad in ({"extra": 1}, {"operation": "OTHER"}, {"dataset_urn": " "}, {"proposed_field_path": "total"}, {"source_snapshot_fingerprint": "x"}, {"analysis_id": 3}):
        with pytest.raises(ValueError):
            proposals.validated(GOOD | bad)
    with pytest.raises(ValueError):
        proposals.validated({k: v for k, v in GOOD.items() if k != "proposed_field_path"} | {"operation": "FIELD_TYPE_CHANGE", "proposed_native_type": "TEXT", "proposed_normalized_type": "text"})


def test_preconditions(spark):
    schema = spark.createDataFrame([("D", "total", "INT"), ("D", "k", "INT"), ("E", "amount", "INT")], "dataset_urn string, field_path string, native_type string")
    state = lambda p, f: proposals.verdict(proposals.preconditions(p, schema, f)).first()["state"]
    assert state(GOOD, "sha256:1") == "VALID" and state(GOOD, "sha256:2") == "STALE_BASELINE"
    assert state(GOOD | {"proposed_field_path": "k"}, "sha256:1") == "INVALID" and state(GOOD | {"current_field_path": "zzz"}, "sha256:1") == "INVALID"
    assert proposals.contract(spark, "FIELD_DELETE").count() == 2
    f = spark.createDataFrame([("a/b.sql", 10), ("../x", 2_000_000)], "path string, size long")
    assert {r["name"]: r["passed"] for r in proposals.within_limits(f).collect()} == {"files": True, "bytes": False, "paths": False}


def test_views(spark):
    nodes = spark.createDataFrame([("a", "Snow"), ("b", "snow"), ("c", "pg"), ("d", "snow")], "node string, platform string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "src string, dst string, w int")
    own, e = presentation.induced(nodes, edges, presentation.text_filter(["platform"], "SNOW"), incident_only=True)
    assert sorted(r["node"] for r in own.collect()) == ["a", "b"] and [tuple(r) for r in e.collect()] == [("a", "b", 1)]
    assert presentation.bounded(nodes, edges, ["node"])[1].count() == 2
    paths = spark.createDataFrame([("b", 1, ["a", "b"]), ("d", 2, ["a", "b", "d"]), ("d", 2, ["a", "c", "d"]), ("e", 3, ["a", "b", "d", "e"])], "target string, hops int, nodes array<string>")
    assert {r["kind"]: "".join(r["nodes"]) for r in presentation.representative(paths).collect()} == {"shortest": "ab", "deepest": "abde", "multipath": "abd"}
    s = spark.createDataFrame([(["COMPATIBLE", "UNKNOWN", "INCOMPATIBLE"],), (["COMPATIBLE"],), ([],)], "s array<string>")
    assert [r[0] for r in s.select(presentation.first_boundary(F.col("s"), ["UNKNOWN", "INCOMPATIBLE"])).collect()] == [2, None, None]


def test_models_against_datasets(spark):
    datasets = spark.createDataFrame([("u1", "db.sales.orders", "snow"), ("u2", "db.ops.items", "snow"), ("u3", "x.items", "snow")], "dataset_urn string, name string, platform string")
    rel = spark.createDataFrame([("m", "Sales.Orders", "SNOW"), ("m", "items", "snow"), ("m", "none", "snow")], "model string, relation string, platform string")
    assert {r["relation"]: r["resolution"] for r in resolve.resolve_relations(rel, datasets).collect()} == {"Sales.Orders": "RESOLVED", "items": "AMBIGUOUS", "none": "NOT_FOUND"}
    relations = spark.createDataFrame([("m", "o", "u1"), ("n", "o", "u1"), ("n", "i", "u2")], "model string, alias string, dataset_urn string")
    fields = spark.createDataFrame([("u1", "Total"), ("u2", "k")], "dataset_urn string, field_path string")
    cols = spark.createDataFrame([("m", None, "total"), ("n", None, "total"), ("n", "I", "K"), ("n", "q", "k"), ("m", "o", "none")], "model string, qualifier string, column string")
    got = {(r["model"], r["qualifier"], r["column"]): r["resolution"] for r in resolve.resolve_columns(cols, relations, fields).collect()}
    assert got == {("m", None, "total"): "RESOLVED", ("n", None, "total"): "AMBIGUOUS", ("n", "I", "K"): "RESOLVED", ("n", "q", "k"): "UNKNOWN_ALIAS", ("m", "o", "none"): "UNKNOWN_FIELD"}
    assert [tuple(r) for r in resolve.expand_star(relations, fields).collect()] == [("m", "Total")]
