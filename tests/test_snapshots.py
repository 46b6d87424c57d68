import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshots


def test_secrets_at_any_depth(spark):
    deep = {"a": [1, {"b": [[{"api_key": 1}]]}]}
    for _ in range(30):
        deep = {"x": [deep]}
    rows = [
        (1, json.dumps({"ok": "token of thanks", "list": [1, None, True, "x"]})), (2, json.dumps({"db_password": None})), (3, json.dumps(deep)), (4, json.dumps({"n": {"name": "auth_token", "value": "v"}})), (5, json.dumps({"names": "auth_token"})),
        (6, json.dumps(["Authorization: Bearer abc"])), (7, "not json, authorization = bearer x"), (8, None), (9, ""), (10, "{}"), (11, '"authorization:bearer"'), (12, "[]"), (13, json.dumps({"tokens": 1, "Secret": {"name": 5}})),
    ]
    found = {}
    for r in snapshots.secret_places(spark.createDataFrame(rows, "id long, json string"), "id").collect():
        found.setdefault(r["id"], set()).add((r["location"], r["why"]))
    assert found.pop(3) == {("$" + ".x[0]" * 30 + ".a[1].b[0][0].api_key", "NAME")}
    assert found == {2: {("$.db_password", "NAME")}, 4: {("$.n.name", "NAME")}, 6: {("$[0]", "TEXT")}, 7: {("$", "MALFORMED"), ("$", "TEXT")}, 9: {("$", "MALFORMED")}, 11: {("$", "TEXT")}, 13: {("$.Secret", "NAME")}}
    with pytest.raises(RuntimeError, match="levels"):
        snapshots.secret_places(spark.createDataFrame(rows[2:3], "id long, json string"), "id", most=5)


def test_context_of_categories(spark):
    data = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "dataset_urn string")
    owner = spark.createDataFrame([("d1", "u1", True, "TECHNICAL"), ("d1", "u1", False, "A"), ("d1", "u2", None, "B")], "dataset_urn string, target_key string, resolved boolean, kind string")
    tag = spark.createDataFrame([("d2", "t", True)], "dataset_urn string, target_key string, resolved boolean")
    rows, states = snapshots.context_rows(data, {"owner": owner, "tag": tag, "bi": tag.limit(0)})
    assert {tuple(r) for r in rows.select("category", "dataset_urn", "target_key", "state", F.to_json("attributes")).collect()} == {("owner", "d1", "u1", "RESOLVED", '{"kind":"TECHNICAL"}'), ("owner", "d1", "u2", "UNRESOLVED", '{"kind":"B"}'), ("tag", "d2", "t", "RESOLVED", "{}")}
    got = {(r[0], r[1]): (r[2], r[3]) for r in states.collect()}
    assert len(got) == 18 and got[("d1", "owner")] == ("PARTIAL", 2) and got[("d2", "owner")] == ("EMPTY", 0) and got[("d2", "tag")] == ("RESOLVED", 1) and got[("d1", "bi")] == ("EMPTY", 0) and got[("d1", "domain")] == ("NOT_RETRIEVED", 0)
    with pytest.raises(ValueError, match="no categories"):
        snapshots.context_rows(data, {"weather": tag})


def evidence(spark, rows):
    return spark.createDataFrame(rows, "classification string, source_phase string, subject_key string, interface string, aspect string, source_urn string, target_urn string, relationship_path array<string>, json string, observed_at string").withColumn("attributes", F.parse_json("json")).drop("json")


def test_evidence_is_addressed_by_content(spark):
    base = ("VERIFIED", "1.5", "s", "i", "a", None, "t", ["x", "y"])
    reg = snapshots.evidence_registry(evidence(spark, [(*base, '{"a":1,"b":[2]}', "2"), (*base, '{"b": [2], "a": 1}', "1"), (*base, '{"a":2}', "1"), (*base[:7], None, "{}", None), (*base[:7], [], "{}", "9")]))
    got = {r["n_seen"]: (r["observed_at"], r["evidence_id"]) for r in reg.collect() if r["n_seen"] == 2}
    assert reg.count() == 3 and got[2][0] in ("1", "9")
    assert snapshots.evidence_conflicts(reg).collect() == []
    forged = reg.withColumn("subject_key", F.when(F.to_json("attributes") == '{"a":2}', "other").otherwise(F.col("subject_key")))
    assert [r["why"] for r in snapshots.evidence_conflicts(forged).collect()] == ["FORGED"]
    assert sorted(r["why"] for r in snapshots.evidence_conflicts(reg.unionByName(forged)).collect()) == ["AMBIGUOUS", "FORGED"]


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_stages_are_held_against_their_derivation(spark, buckets):
    df = spark.range(500).selectExpr("id AS k", "IF(id % 5 = 0, NULL, id * 2) AS v", "array(id, NULL) AS l")
    assert snapshots.stage_differences(df, df.repartition(5), ["k"], buckets).collect() == []
    bad = df.where("k <> 3").withColumn("v", F.when(F.col("k") == 10, 1).otherwise(F.col("v"))).union(df.where("k = 20"))
    assert sorted(tuple(r) for r in snapshots.stage_differences(bad, df, ["k"], buckets).collect()) == [(3, "DERIVED", 1), (10, "DERIVED", 1), (10, "STORED", 1), (20, "STORED", 1)]
    assert snapshots.stage_differences(df.limit(0), df, ["k"], buckets).count() == 500 and snapshots.stage_differences(df.limit(0), df.limit(0), ["k"], buckets).count() == 0


def test_chains_of_fingerprints(spark):
    a, b, c = (spark.range(n).toDF("x") for n in (3, 4, 5))
    good = snapshots.chained_fingerprints([("a", a), ("b", b), ("c", c)])
    states = lambda found: [r["state"] for r in snapshots.broken_links(good, found).orderBy("position").collect()]
    assert states(snapshots.chained_fingerprints([("a", a.repartition(2)), ("b", b), ("c", c)])) == ["SAME"] * 3
    assert states(snapshots.chained_fingerprints([("a", a), ("b", c), ("c", c)])) == ["SAME", "CHANGED", "AFTER_A_CHANGE"]
    assert states(snapshots.chained_fingerprints([("a", a)])) == ["SAME", "MISSING", "MISSING"]
    assert states(snapshots.chained_fingerprints([("a", a), ("b", b), ("c", c), ("d", a)])) == ["SAME"] * 3 + ["ADDED"]


def test_a_chain_reads_each_stage_once(spark):
    a, b = spark.range(3).toDF("x"), spark.range(4).toDF("x")
    plan = snapshots.chained_fingerprints([("a", a), ("b", b)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2
    rows = snapshots.fingerprint_chain(snapshots.stage_fingerprint(1, "b", b).unionByName(snapshots.stage_fingerprint(0, "a", a))).orderBy("position").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [r.stage for r in rows] == ["a", "b"] and rows[0].chain == sha(rows[0].fingerprint) and rows[1].chain == sha(rows[0].chain + rows[1].fingerprint)
    words = [sum(int(sha(f'{{"x":{i}}}')[4 * k : 4 * k + 4], 16) for i in range(3)) for k in range(16)]
    assert rows[0].n_rows == 3 and rows[0].fingerprint == "sha256:" + sha(",".join(map(str, [3, *words])))


def test_relationships_of_repeated_parts(spark, tmp_path):
    """Pipelines are distinct by their pairs, so a part that stands twice makes no link twice, and a line without its part none."""
    from tidemark.sources import registry

    tables = {
        "lineitem": ([(1, 1, 7), (1, 1, 7), (2, 1, 8), (2, 9, 7), (3, None, 7)], "l_orderkey long, l_partkey long, l_suppkey long"), "part": ([(1, "B", 3), (1, "B", 3), (2, "C", 50)], "p_partkey long, p_brand string, p_size int"),
        "supplier": ([(7, 4), (8, 4)], "s_suppkey long, s_nationkey int"), "orders": ([(1, "X"), (2, "X")], "o_orderkey long, o_orderpriority string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = registry.relationships(spark, str(tmp_path))
    assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted([("owner", "B", "None", "nation:4", "RESOLVED"), ("pipeline", "None", "1", "job:7", "RESOLVED"), ("pipeline", "None", "1", "job:8", "RESOLVED"), ("bi", "B", "None", "dashboard:X", "RESOLVED"), ("tag", "None", "1", "tag:0", "RESOLVED"), ("tag", "None", "2", "tag:5", "UNRESOLVED")])
