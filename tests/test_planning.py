import random

import pytest

from tidemark.operators import graph, planning, repair


def test_orders_equal_one_plan_at_a_time(spark):
    rnd = random.Random(4)
    plans = {p: [(f"a{i}", [f"a{j}" for j in range(i) if rnd.random() < 0.2]) for i in range(rnd.randrange(1, 12))] for p in range(30)}
    plans[100], plans[101], plans[102] = [("x", ["y"]), ("y", ["x"]), ("z", [])], [("x", ["gone"])], [("x", ["x"])]
    plans[103] = [("x", None), ("y", ["x", "x"])]
    plans[104] = [(f"b{i}", []) for i in range(9)]
    rows = [(p, a, deps, "clash") for p, own in plans.items() for a, deps in own if p != 104] + [(104, a, [], "clash") for a, _ in plans[104]]
    rnd.shuffle(rows)
    got = planning.topological_orders(spark.createDataFrame(rows, "plan_id long, action_id string, depends_on array<string>, state string").repartition(3), most=500).collect()
    found = {}
    for r in got:
        found.setdefault(r["plan_id"], []).append((r["position"], r["action_id"], r["state"]))
    for p, own in plans.items():
        if p in (100, 102):
            assert {s for _, _, s in found[p]} == {"CYCLE"} and {n for n, _, _ in found[p]} == {None} and len(found[p]) == len(own)
        elif p == 101:
            assert found[p] == [(None, "x", "UNKNOWN_DEPENDENCY")]
        else:
            assert [a for _, a, _ in sorted(found[p])] == graph.topological_order([(a, deps or []) for a, deps in own])
    small = planning.topological_orders(spark.createDataFrame(rows, "plan_id long, action_id string, depends_on array<string>, state string"), most=8).where("plan_id = 104").collect()
    assert {(r["position"], r["state"]) for r in small} == {(None, "TOO_MANY_ACTIONS")} and len(small) == 9
    assert planning.topological_orders(spark.createDataFrame([], "plan_id string, action_id string, depends_on array<string>")).collect() == []


def test_a_long_chain_is_linear():
    chain = [(f"{i:06}", [f"{i - 1:06}"] if i else []) for i in range(20_000)]
    assert planning.kahn(chain[::-1]) == ("ORDERED", [a for a, _ in chain])


ROOTS = [
    ("p", "ok", planning.STALE, "g", "f1"), ("p", "twice", planning.STALE, "g", "f2"), ("p", "no-file", planning.STALE, "g", None), ("p", "no-group", planning.STALE, None, "f1"), ("p", "conflict", planning.STALE, "two", "f1"),
    ("p", "dynamic", planning.STALE, "g", "f3"), ("p", "semantic", "SEMANTIC_DEFINITION_CHANGED", "g", "f1"), ("p", "manual", "CONTRACT_CHANGE", "g", "f1"), ("p", "other", "NEW_KIND", "g", "f1"), ("p", "no-rule", planning.STALE, "g", "f4"),
    ("q", "table", planning.STALE, "t", "f5"), ("n", "none", None, None, None),
]


def tables(spark):
    roots = spark.createDataFrame(ROOTS, "plan_id string, root_id string, root_type string, group_id string, file_id string")
    groups = spark.createDataFrame([("g", "a", ["b"]), ("two", "a", ["b", "c"]), ("t", "tab", ["new"])], "group_id string, current string, futures array<string>")
    files = spark.createDataFrame([("f1", "x.json", "PIPELINE_CONFIG", False), ("f2", "y.yaml", "QUALITY_CONFIG", None), ("f3", "z.py", "PIPELINE_DAG", True), ("f4", "m.sql", "SQL_MODEL", False), ("f5", "d.py", "PIPELINE_DAG", False)], "file_id string, path string, category string, dynamic boolean")
    references = spark.createDataFrame([("f1", "field", "$.a", "a"), ("f1", "field", "$.b", "other"), ("f2", "field", "$.a", "a"), ("f2", "field", "$.b", "a"), ("f3", "field", "$", "a"), ("f4", "field", "$", "a"), ("f5", "dataset", "t1.table", "tab")], "file_id string, kind string, location string, value string")
    return roots, groups, files, references


def test_repairability_and_plans(spark):
    own = planning.classified(planning.stale_targets(*tables(spark)))
    assert {r["root_id"]: (r["basis"], r["rule_id"]) for r in own.collect()} == {
        "ok": ("one-target-one-rule", "repair.stale-field.pipeline-config.v1"), "twice": ("ambiguous-static-target", None), "no-file": ("ambiguous-static-target", None), "no-group": ("missing-coherent-identity", None),
        "conflict": ("explicit-conflict", None), "dynamic": ("dynamic-reference", None), "semantic": ("semantic-intent", None), "manual": ("change-source-or-intent", None), "other": ("root-type", None), "no-rule": ("ambiguous-static-target", None),
        "table": ("one-target-one-rule", "repair.stale-dataset.static-reference.v1"), "none": ("root-type", None),
    }
    actions = planning.planned_actions(own)
    assert {(r["root_id"], r["location"], r["future"]) for r in actions.collect()} == {("ok", "$.a", "b"), ("table", "t1.table", "new")}
    done = {r["plan_id"]: (r["n_roots"], r["n_actions"], r["completeness"], r["disposition"]) for r in planning.outcomes(own, planning.topological_orders(actions)).collect()}
    assert done == {"p": (10, 1, "PARTIALLY_ADDRESSED_SELECTED_ROOTS", "PARTIAL_REPAIR_CANDIDATE"), "q": (1, 1, "FULLY_ADDRESSED_SELECTED_ROOTS", "REPAIR_CANDIDATE_READY_FOR_REVIEW"), "n": (1, 0, "NO_SUPPORTED_REPAIR", "NO_SUPPORTED_AUTOMATIC_REPAIR")}


def test_references_elsewhere_and_differences(spark):
    references = tables(spark)[3]
    claims, own = spark.createDataFrame([("c", "a")], "claim_id string, current string"), spark.createDataFrame([("c", "f1"), ("c", "f1"), ("c", "f9")], "claim_id string, file_id string")
    assert sorted(r["file_id"] for r in planning.other_references(claims, own, references).collect()) == ["f2", "f2", "f3", "f4"]
    more = references.union(references.limit(1))
    assert tuple(planning.differing_rows(references, references).first()) == (0, 0) and tuple(planning.differing_rows(more, references).first()) == (1, 0)
    assert tuple(planning.differing_rows(references.limit(0), references).first()) == (0, 7)


def test_only_touched_files_are_parsed_again(spark):
    files = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "file_id string, content string")
    seen = []

    def parse(df):
        seen.append(sorted(r["file_id"] for r in df.collect()))
        return df.selectExpr("file_id", "content AS value")

    after, again = planning.projected(files, files.selectExpr("file_id", "content AS value"), spark.createDataFrame([("b", "zwei"), ("gone", "x")], "file_id string, candidate string"), parse)
    assert seen == [["b"]] and sorted(map(tuple, again.collect())) == [("a", "one"), ("b", "zwei"), ("c", "three")] == sorted(map(tuple, after.collect()))


JSON = '{\n  "a" : [1, "x", {"b":"col_1" , "c": null}],\t"d": "col_1",\n "é": "\\u00e9", "t": true}\n'


@pytest.mark.parametrize(
    ("edits", "want"),
    [
        ([("$.a[2].b", "col_1", "nëw")], JSON.replace('"b":"col_1"', '"b":"nëw"')), ([("$.d", "col_1", None)], JSON.replace('"d": "col_1",\n ', "")), ([("$.t", True, None)], JSON.replace(', "t": true', "")),
        ([("$.a[0]", 1, None), ("$.a[1]", "x", "y"), ("$.é", "é", "e")], JSON.replace('1, "x"', '"y"').replace('"\\u00e9"', '"e"')), ([("$.a[0]", 1, 2)], JSON.replace("[1,", "[2,")),
    ],
)
def test_json_keeps_every_other_character(edits, want):
    assert repair.edit_json_spans(JSON, edits) == want


@pytest.mark.parametrize(
    ("text", "edits"),
    [(JSON, [("$.a", "x", "y")]), (JSON, [("$.d", "col", "y")]), (JSON, [("$.a[0]", True, 2)]), (JSON, [("$.a[9]", 1, 2)]), (JSON, [("$.d", "col_1", "x"), ("$.d", "col_1", "y")]), ('{"a":1,"a":2}', [("$.a", 2, 3)]), ("[1,]", [("$[0]", 1, 2)]), ("{'a':1}", [("$.a", 1, 2)]), ("[" * 100_000, [("$[0]", 1, 2)]), ("[1] x", [("$[0]", 1, 2)]), ("", [("$", 1, 2)])],
)
def test_unsafe_json_edits_are_refused(text, edits):
    with pytest.raises((repair.EditError, ValueError)):
        repair.edit_json_spans(text, edits)


def test_fuzzed_json_edits():
    import json

    rnd = random.Random(7)

    def value(depth):
        kind = rnd.randrange(6 if depth < 3 else 4)
        return [rnd.randrange(99), f"s{rnd.randrange(9)}\"é\\", None, rnd.random() < 0.5][kind] if kind < 4 else [value(depth + 1) for _ in range(rnd.randrange(4))] if kind == 4 else {f"k{i}": value(depth + 1) for i in range(rnd.randrange(4))}

    changed = 0
    for _ in range(400):
        doc = {"r": value(0), "s": [value(1)]}
        text = json.dumps(doc, indent=rnd.choice([None, 1, 4]), ensure_ascii=rnd.random() < 0.5)
        scalars = repair.json_scalars(text)
        for path, (_, start, end, own) in scalars.items():
            assert json.loads(text[start:end]) == own == repair.value_at(doc, list(path))
        texts = [(p, x[3]) for p, x in scalars.items() if isinstance(x[3], str)]
        if texts:
            path, own = rnd.choice(texts)
            location = "$" + "".join(f"[{t}]" if isinstance(t, int) else f".{t}" for t in path)
            new = rnd.choice(["neu", None])
            out = repair.edit_json_spans(text, [(location, own, new)])
            changed += out != text
    assert changed > 100


def test_yaml_keeps_comments_and_quotes():
    text = "a: 'x'  # note\nb:\n  - p\n  - q # z\nc: \"x\"\nd: plain\n"
    assert repair.edit_yaml_spans(text, [("$.a", "x", "it's"), ("$.b[0]", "p", None), ("$.c", "x", "y: z"), ("$.d", "plain", "yes")]) == "a: 'it''s'  # note\nb:\n  - q # z\nc: \"y: z\"\nd: \"yes\"\n"
    for edits in ([("$.b", "p", "q")], [("$.z", "p", "q")], [("$.a", "y", "q")], [("$.b[7]", "p", "q")]):
        with pytest.raises(repair.EditError):
            repair.edit_yaml_spans(text, edits)
    with pytest.raises(repair.EditError):
        repair.edit_yaml_spans("a: {b: x, c: y}\n", [("$.a.b", "x", None)])
