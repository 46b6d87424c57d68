"""What keeps work spread and bounded when tables grow: results as before, by plans that do not multiply out."""

import pytest
from pyspark import TaskContext

from tidemark.operators import repair
from tidemark.sources import files


def test_rows_of_files_are_dealt_to_all_tasks(spark):
    found = files.each(spark.range(200).coalesce(1), lambda k: (k, TaskContext.get().partitionId()), "id long, task int").collect()
    assert sorted(r.id for r in found) == list(range(200)) and len({r.task for r in found}) >= 4


def test_both_yaml_loaders_agree():
    import yaml

    for text in ("a: 'x'\nb: [1, yes, ~, 2024-01-01]\n", "﻿a: é𝄞 # c\n", "a: &x {b: 1}\nc:\n  <<: *x\n"):
        assert files.loaded_yaml(text) == yaml.safe_load(text)
        nodes = [files.composed_yaml(text).value[0], yaml.compose(text).value[0]]
        assert len({(k.start_mark.index, v.end_mark.index) for k, v in nodes}) == 1
    with pytest.raises(yaml.YAMLError):
        files.loaded_yaml("a: [1\n")
    assert type(files.composed_yaml("a: 1\n")) is type(yaml.compose("a: 1\n")) and "CSafeLoader" in repr(files._by_yaml(lambda _, loader: loader, "a", "SafeLoader"))


def test_plain_files_are_read_as_the_loaders_read_them():
    """Plain YAML, JSON entries and numbers of pipelines give what the loaders and the syntax tree give, or are left to them."""
    import random

    import yaml

    rnd, plain, edited = random.Random(6), 0, 0
    lines = ["a:", "b: c", "a: 'x # y'  # kept", 'd: "q"', "# top", "", "  - f: col_1  # kept", "    g: not_null", "  - f: 'col_2'", "    f: e", "- f: z", "  g: w", "on: x", "b: yes", "b: No", "b: null", "b: y", "b: x: y", "b:x", "   - f: u", "  # in", "      h: i", "b: 1", "b: _1", "b: 'it''s'", "b: é", "---", "a: &x b", "b: *x", "b:  two", "b: c d", "b: ''", "  "]
    for k in range(9000):
        text = "\n".join(rnd.choice(lines[: 13 if k % 3 else None]) for _ in range(rnd.randint(1, 7))) + "\n" * (k % 2)
        spans = {}
        found = files.plain_yaml(text, spans)
        if found is None:
            continue
        assert found == yaml.safe_load(text), text
        plain += 1
        for place, value in files.flattened(found):
            start, end, read = spans.pop(tuple(repair.tokens(place)))
            assert read == value and yaml.safe_load(text[start:end]) == value
        assert not spans
        todo = [(p, v, rnd.choice(["new", "on", "it's", "a b"])) for p, v in files.flattened(found) if rnd.random() < 0.5]
        own = repair.edit_yaml_spans(text, todo)
        keep, repair.plain_yaml = repair.plain_yaml, lambda *_: None
        try:
            assert repair.edit_yaml_spans(text, todo) == own
            edited += bool(todo)
        finally:
            repair.plain_yaml = keep
    assert plain > 300 and edited > 200
    source = "balance = -12.50\nn = 7\nt1 = Task(task_id=\"t1\", field=\"col_1\")\n"
    assert files._plain_structure(source) == files.parsed_structure(source) and files._plain_structure("n = 08\n") is None
    own = repair.json_scalars('{"a" : "x", "b":{"c": "\\u0041", "d": 1}, "e": ["f", {"g":"h"}]}')
    assert {k: v[3] for k, v in own.items()} == {("a",): "x", ("b", "c"): "A", ("b", "d"): 1, ("e", 0): "f", ("e", 1, "g"): "h"}
    for bad in ('{"a": "x", "a": "y"}', '{"a": "x",}', '{"a": "x" "b": "y"}', '{"a": "x"'):
        with pytest.raises(repair.EditError):
            repair.json_scalars(bad)


def test_plans_are_applied_in_batches(spark):
    own = spark.createDataFrame([("a", "x: 1\n"), ("b", "x: p # k\n"), ("c", "x: q\n")], "path string, content string")
    todo = spark.createDataFrame([("b", 2, "yaml", "$.x", "q", "r"), ("b", 1, "yaml", "$.x", "p", "q"), ("c", 1, "yaml", "$.x", "no", "r"), ("gone", 1, "yaml", "$.x", "no", "r")], "path string, position int, editor string, location string, current string, future string")
    found = repair.apply_plan(own, todo)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["b"].candidate == "x: r # k\n" and rows["b"].n_actions == 2 and rows["a"].n_actions == 0
    assert rows["c"].candidate == "x: q\n" and rows["c"].error.startswith("EditError") and rows["c"].patch == ""


def test_template_names_need_no_pattern_of_their_own():
    text = "{{ ref('a.b') }} {{ source('s', \"x\" ) }} {{ ref('axb') }}"
    assert repair.edit_template_reference(text, "a.b", "new") == text.replace("a.b", "new")
    assert repair.edit_template_reference(text, "x", "y") == text.replace('"x"', '"y"')
    assert repair.edit_template_reference("{{ ref('it\\'s') }}", "it\\'s", "n") == "{{ ref('n') }}"
    repair.re.purge()
    for i in range(5):
        repair.edit_template_reference(f"{{{{ ref('col_{i}') }}}}", f"col_{i}", "n")
    assert not any("col_" in str(k[1]) for k in repair.re._cache)


LINKS = [("owner", "A", None, "x", "RESOLVED"), ("bi", "A", None, "x", "UNRESOLVED"), ("owner", "B", None, "y", "RESOLVED"), ("tag", None, 1, "x", "RESOLVED"), ("tag", None, 3, "x", "RESOLVED"), ("tag", None, 4, "y", None), ("tag", None, 9, "z", "RESOLVED"), ("pipeline", None, 5, "y", "RESOLVED")]
FIELDS = [(1, "A"), (2, "A"), (3, "B"), (4, None), (5, "C"), (6, "C"), (2, "B"), (7, "A"), (7, "B"), (None, "A")]


def test_assets_are_counted_without_their_mappings(spark):
    from tidemark.operators import context

    links = spark.createDataFrame(LINKS, "category string, source_key string, field_node long, target_key string, state string")
    fields = spark.createDataFrame(FIELDS, "node long, dataset_urn string")
    m = [r.asDict() for r in context.technical_mappings(links, fields).collect()]
    of = lambda key, v: [r for r in m if r[key] == v]
    several = lambda rows, key: len({r[key] for r in rows if r[key] is not None})
    found = context.asset_supports(links, fields).collect()
    assert {(r.target_key, r.n_datasets, r.n_fields, r.n_mappings, r.lo, r.hi, r.unresolved) for r in found} == {
        (k, several(of("target_key", k), "dataset_urn"), several(of("target_key", k), "node"), len(of("target_key", k)), min(r["category"] for r in of("target_key", k)), max(r["category"] for r in of("target_key", k)), int(any(r["state"] == "UNRESOLVED" for r in of("target_key", k)))) for k in {r["target_key"] for r in m}
    }
    found = context.dataset_summaries(links, fields).collect()
    n = lambda rows, c: several([r for r in rows if r["category"] == c], "target_key")
    assert {(r.dataset_urn, r.n_owner, r.n_pipeline, r.n_bi, r.n_tag, r.n_assets, r.n_fields) for r in found} == {(d, *(n(of("dataset_urn", d), c) for c in context.CATEGORIES), several(of("dataset_urn", d), "target_key"), several(of("dataset_urn", d), "node")) for d in {r["dataset_urn"] for r in m}}


def test_claims_meet_references_as_one_row_each(spark):
    from tidemark.operators import changes

    claims = spark.createDataFrame([(f"c{i % 2}", "v", f"f{i}") for i in range(400)] + [("solo", "w", "g"), ("none", "w", None)], "current string, future string, file string")
    refs = spark.createDataFrame([(f"r{i}", f"c{i % 2}") for i in range(400)] + [("f0", "c0"), ("g", "solo"), ("h", "solo"), (None, "solo"), ("g", "w"), ("h", "w"), ("d", "v"), ("k", "none")], "file string, value string")
    found = changes.reference_states(claims, refs)
    assert found.where("current = 'solo'").count() == 2 and found.where("current = 'none'").count() == 0
    assert found.where("current = 'c0' AND state = 'STALE'").count() == 201 and found.where("state = 'ADAPTED'").count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and plan.index("count(distinct file") > plan.index("Join Inner")


def test_large_exchanges_are_dealt_by_their_rows(spark):
    from tidemark.functions.store import ROWS, dealt
    from tidemark.operators import planning

    df = spark.range(10).selectExpr("id AS a")
    assert dealt(df, 0, "a").rdd.getNumPartitions() == 4 and dealt(df, 9 * ROWS + 1, "a").rdd.getNumPartitions() == 10
    claims, own = spark.createDataFrame([("c", "v")], "claim_id string, current string"), spark.createDataFrame([("c", "f1")], "claim_id string, file_id string")
    refs = spark.createDataFrame([("f1", "field", "x", "v"), ("f2", "field", "y", "v"), ("f2", "field", "z", "w")], "file_id string, kind string, location string, value string")
    found = planning.other_references(claims, own, refs, 9 * ROWS + 1)
    assert [tuple(r) for r in found.collect()] == [("c", "f2", "field", "y")] and found._jdf.queryExecution().optimizedPlan().toString().count("], 10") == 2


def _representatives(edges, origins):
    """The three kinds of paths by listing all of them, rows ranked one by one."""
    out = {}
    for origin in origins:
        paths, level = [], [((origin,), ())]
        while level:
            level = [((*n, dst), (*r, key)) for n, r in level for src, dst, key in edges if src == n[-1] and dst is not None]
            paths += level
        n = {p[0][-1]: sum(q[0][-1] == p[0][-1] for q in paths) for p in paths}
        a, b = sorted(paths, key=lambda p: (len(p[0]), p)), sorted(paths, key=lambda p: (-len(p[0]), p))
        if paths:
            left = list(a)
            for p in {a[0], b[0]}:
                left.remove(p)
            out |= {(origin, "SHORTEST"): a[0], (origin, "DEEPEST"): b[0]} | {(origin, "MULTIPATH"): p for p in [q for q in left if n[q[0][-1]] > 1][:1]}
    return out


def test_representative_paths_are_found_without_listing_paths(spark, monkeypatch):
    from tidemark.functions.store import Scratch
    from tidemark.operators import propagation

    layers = [("r", f"n0{i}", f"e{i}") for i in range(2)] + [(f"n{k}{i}", f"n{k + 1}{j}", f"x{(i * 5 + j * 3 + k) % 7}") for k in range(3) for i in range(3) for j in range(3) if (i + j + k) % 4]
    other = [("s", "t", "q2"), ("s", "t", "q1"), ("s", "t", "q1"), ("t", "u", "v"), ("w", "x", "y"), ("w", None, "z"), ("x", "w2", "y"), (None, "x", "y"), ("p", "x1", "1"), ("p", "x1", "1"), ("o", "n22", "k"), ("o", "n00", "j")]
    edges, origins = layers + other, ["r", "s", "w", "p", "o", "none"]
    monkeypatch.setattr(propagation, "SMALL", 1)
    with Scratch(spark) as scratch:
        found = propagation.representative_routes(spark.createDataFrame(edges, "src string, dst string, relationship_id string"), spark.createDataFrame([(x,) for x in origins], "node string"), scratch).collect()
    assert {(r.node, r.kind): (tuple(r.nodes), tuple(r.relationships)) for r in found} == _representatives(edges, origins) and len(found) == len({(r.node, r.kind) for r in found})
    wide = [(f"a{k}{i}", f"a{k + 1}{j}", f"{i}{j}") for k in range(4) for i in range(12) for j in range(12)]  # 12 ** 4 paths from each node of the first layer
    with Scratch(spark) as scratch:
        found = propagation.representative_routes(spark.createDataFrame(wide, "src string, dst string, relationship_id string"), spark.createDataFrame([("a00",)], "node string"), scratch).collect()
    rows = {r.kind: r for r in found}
    assert rows["DEEPEST"].nodes == [f"a{k}0" for k in range(5)] and rows["MULTIPATH"].nodes == ["a00", "a10", "a20"] and rows["SHORTEST"].relationships == ["00"]


def test_targets_are_dealt_by_rows_and_outcomes_need_no_wide_roots(spark):
    from tidemark.functions.store import ROWS
    from tidemark.operators import planning

    roots = spark.createDataFrame([("p", "r1", planning.STALE, "g", "f1"), ("p", "r2", planning.STALE, "g", "f2"), ("q", "r3", "CONTRACT_CHANGE", "h", None), ("q", "r4", planning.STALE, "none", "f1")], "plan_id string, root_id string, root_type string, group_id string, file_id string")
    groups = spark.createDataFrame([("g", "a", ["b"]), ("h", "c", None)], "group_id string, current string, futures array<string>")
    files = spark.createDataFrame([("f1", "m/1", "PIPELINE_DAG", False), ("f2", "m/2", "QUALITY_CONFIG", False)], "file_id string, path string, category string, dynamic boolean")
    refs = spark.createDataFrame([("f1", "field", "x", "a"), ("f2", "field", "z", "a"), ("f2", "dataset", "y", "a"), (None, "field", "x", "a")], "file_id string, kind string, location string, value string")
    found = planning.stale_targets(roots, groups, files, refs, 9 * ROWS + 1)
    assert {r.root_id: (r.n_matches, r.location, r.kind, r.n_futures) for r in found.collect()} == {"r1": (1, "x", "field", 1), "r2": (2, "y", "dataset", 1), "r3": (0, None, None, 0), "r4": (0, None, None, 0)}
    plans = found._jdf.queryExecution()
    assert plans.optimizedPlan().toString().count("], 10") == 2 and "ShuffledHashJoin" in plans.executedPlan().toString()
    wide = planning.classified(found)
    ends = lambda df: sorted(map(tuple, planning.outcomes(df, planning.topological_orders(planning.planned_actions(df))).collect()))
    assert ends(wide) == ends(planning.needed(wide)) == [("p", 2, 1, 0, 1, "PARTIALLY_ADDRESSED_SELECTED_ROOTS", "PARTIAL_REPAIR_CANDIDATE"), ("q", 2, 0, 1, 1, "NO_SUPPORTED_REPAIR", "NO_SUPPORTED_AUTOMATIC_REPAIR")]


def test_lines_of_the_reverse_index_are_dealt_by_their_rows(spark, monkeypatch):
    from tidemark.functions import store
    from tidemark.plans import catalog

    want = sorted(map(tuple, catalog.f11_reverse_index(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(store, "ROWS", 500)
    found = catalog.f11_reverse_index(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sorted(map(tuple, found.collect())) == want
    assert f", {-(-rows // 500)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_links_and_ends_keep_their_plans_as_tables_grow(spark, tmp_path):
    """Owners and priorities by one pass of hashed sides, and references without a join; lines without order, supplier or part keep what they have."""
    from tidemark.operators import certify
    from tidemark.sources import registry

    tables = {
        "lineitem": ([(1, 1, 1, 7), (1, 1, 1, 7), (1, 1, 2, 8), (2, 1, 1, 9), (3, 1, 2, 7), (None, 1, 3, None), (4, 1, None, 7), (5, 1, 9, 7), (2, 2, 3, 10)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
        "part": ([(1, "B", 3), (1, "B2", 50), (2, "C", 50), (3, None, 9)], "p_partkey long, p_brand string, p_size int"), "supplier": ([(7, 4), (7, 5), (8, 4), (10, None)], "s_suppkey long, s_nationkey int"), "orders": ([(1, "X"), (1, "Y"), (2, None), (4, "Z")], "o_orderkey long, o_orderpriority string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    links = registry.relationships(spark, str(tmp_path))
    of = {("owner", b, None, f"nation:{n}") for b in ("B", "B2") for n in (4, 5)} | {("owner", "C", None, f"nation:{n}") for n in (4, 5)} | {("owner", None, None, None)}
    of |= {("bi", b, None, f"dashboard:{p}") for b in ("B", "B2", "C") for p in "XY"} | {("bi", b, None, None) for b in ("B", "B2", None)}
    of |= {("pipeline", None, p, f"job:{s}") for p, s in ((1, 7), (1, 9), (2, 8), (2, 7), (3, 10))} | {("pipeline", None, 3, None), ("tag", None, 1, "tag:0"), ("tag", None, 1, "tag:5"), ("tag", None, 2, "tag:5"), ("tag", None, 3, "tag:0")}
    found = [tuple(r)[:4] for r in links.collect()]
    assert set(found) == of and len(found) == len(of)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 3 and "LeftSemi" not in plan
    edges = registry.lineage_edges(spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" not in edges._jdf.queryExecution().executedPlan().toString()
    known, refs = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, [1, 5]), (3, [5, None]), (3, None), (None, [2]), (4, [])], "f long, l array<long>")
    checks = certify.references_of(known, "k", {"a": refs.select("f"), "b": certify.elements(refs, "l"), "c": known, "none": known.limit(0)})
    assert {r["name"]: (r.observed, r.passed, r.expected) for r in checks.collect()} == {"a": ("2", False, "0 dangling"), "b": ("1", False, "0 dangling"), "c": ("0", True, "0 dangling"), "none": ("0", True, "0 dangling")}
    assert "Join" not in checks._jdf.queryExecution().optimizedPlan().toString() and [r.observed for r in certify.elements_known(refs, "l", known, "k", "e").collect()] == ["1"]


@pytest.mark.parametrize("clash", [False, True])
def test_context_of_causes_is_counted_without_its_mappings(spark, monkeypatch, clash):
    """Short lists of assets, classes of them and busy sources give what the joined mappings give; so do names where two share a hash."""
    from pyspark.sql import functions as F

    from tidemark.functions.store import Scratch
    from tidemark.operators import context

    links = spark.createDataFrame([*LINKS, ("owner", "A", None, "v", "RESOLVED"), ("owner", "A", None, "w", "RESOLVED"), ("owner", "C", None, "v", "RESOLVED"), ("owner", "C", None, "w", "RESOLVED"), ("bi", "B", None, None, "RESOLVED")], "category string, source_key string, field_node long, target_key string, state string")
    fields = spark.createDataFrame(FIELDS, "node long, dataset_urn string")
    own = spark.createDataFrame([(s, n, s % 3 + n) for s, ns in {1: (1, 2, 3), 2: (4,), 3: (8,), 4: (1, 3, 4, 5, 6, 7, 8), 5: (5, 6)}.items() for n in ns], "src int, node long, v long")
    m = context.technical_mappings(links, fields).select("node", "dataset_urn", "target_key").withColumn("met", F.col("node")).distinct()
    want = own.join(m, "node", "left").groupBy("src").agg(*[F.count_distinct(c) for c in ("target_key", "dataset_urn", "met")], F.min("v")).collect()
    if clash:
        monkeypatch.setattr(context.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else F.hash(*c).cast("long"))
    for hot in (context.HOT, 2):
        with Scratch(spark) as scratch:
            found = context.causes_context(own, links, fields, 20, scratch, F.min("v").alias("v"), hot=hot)
            assert sorted(map(tuple, found.select("src", "n_assets", "n_datasets", "n_fields", "v").collect())) == sorted(map(tuple, want))


def test_causes_meet_no_row_of_each_asset(spark):
    """A node with many assets of its dataset goes to a source as one row, and with one class of them."""
    from tidemark.functions.store import Scratch
    from tidemark.operators import context

    links = spark.range(500).selectExpr("'owner' AS category", "'A' AS source_key", "CAST(NULL AS BIGINT) AS field_node", "'n' || id AS target_key", "'RESOLVED' AS state")
    fields = spark.range(4).selectExpr("id AS node", "'A' AS dataset_urn")
    with Scratch(spark) as scratch:
        rows = context.node_assets(links, fields, 500, scratch).collect()
        assert len(rows) == 4 and all(len(r["ids"]) == 0 and [c["n"] for c in r["classes"]] == [500] for r in rows)
