import json

import pytest

from tidemark.operators import repair, sqlmodel
from tidemark.sources import files, package


#: Pairs of models and the deltas that they must give.
MODELS = [
    ("aggregate", "SELECT SUM(x) AS v FROM t", "SELECT AVG(x) AS v FROM t", [("AGGREGATION_CHANGE", "v", "function_changed")]),
    ("distinct", "SELECT COUNT(x) AS v FROM t", "SELECT COUNT(DISTINCT x) AS v FROM t", [("AGGREGATION_CHANGE", "v", "distinct_changed")]),
    ("input", "SELECT SUM(x) AS v FROM t", "SELECT SUM(y) AS v FROM t", [("AGGREGATION_CHANGE", "v", "input_changed")]),
    ("filter_added", "SELECT a FROM t", "SELECT a FROM t WHERE a > 0", [("FILTER_CHANGE", None, "filter_added")]),
    ("filter_literal", "SELECT a FROM t WHERE a > 0", "SELECT a FROM t WHERE a > 100", [("FILTER_CHANGE", None, "predicate_modified,literal_changed")]),
    ("filter_operator", "SELECT a FROM t WHERE a > 0", "SELECT a FROM t WHERE a >= 0", [("FILTER_CHANGE", None, "predicate_modified,operator_changed")]),
    ("join_type", "SELECT a.x FROM a LEFT JOIN b ON a.id = b.id", "SELECT a.x FROM a JOIN b ON a.id = b.id", [("JOIN_TYPE_CHANGE", None, "type_changed")]),
    ("join_on", "SELECT a.x FROM a JOIN b ON a.id = b.id", "SELECT a.x FROM a JOIN b ON a.mail = b.mail", [("JOIN_PREDICATE_CHANGE", None, "predicate_changed")]),
    ("join_to", "SELECT a.x FROM a JOIN b ON a.id = b.id", "SELECT a.x FROM a JOIN c ON a.id = c.id", [("JOINED_RELATION_CHANGE", None, "relation_changed"), ("JOIN_PREDICATE_CHANGE", None, "predicate_changed")]),
    ("operator", "SELECT p * q AS v FROM t", "SELECT p + q AS v FROM t", [("DERIVED_EXPRESSION_CHANGE", "v", "operator_changed")]),
    ("function", "SELECT LOWER(s) AS v FROM t", "SELECT UPPER(s) AS v FROM t", [("DERIVED_EXPRESSION_CHANGE", "v", "function_changed")]),
    ("format_only", "SELECT  a , (b) AS c FROM t -- note", "select A, B as C\nfrom T", []),
    ("renamed", "SELECT a AS x, b AS y FROM t", "SELECT a AS z, b AS y FROM t", [("OUTPUT_RENAME", "x", "renamed")]),
    ("added", "SELECT a FROM t", "SELECT a, b FROM t", [("OUTPUT_ADD", "b", "added")]),
    ("removed", "SELECT a, b FROM t", "SELECT a FROM t", [("OUTPUT_REMOVE", "b", "removed")]),
    ("reordered", "SELECT a, b FROM t", "SELECT b, a FROM t", [("OUTPUT_REORDER", None, "reordered")]),
    ("grouping", "SELECT a, SUM(x) AS v FROM t GROUP BY a", "SELECT a, SUM(x) AS v FROM t GROUP BY a, b", [("AGGREGATION_CHANGE", "v", "grouping_changed")]),
    ("cast", "SELECT CAST(a AS INT) AS v FROM t", "SELECT CAST(a AS BIGINT) AS v FROM t", [("DERIVED_EXPRESSION_CHANGE", "v", "structure_changed")]),
    ("cte_body", "WITH c AS (SELECT a FROM t WHERE a > 1) SELECT a FROM c", "WITH c AS (SELECT a FROM t WHERE a > 2) SELECT a FROM c", [("UNCLASSIFIED_CHANGE", None, "ctes")]),
    ("subquery", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.x = 1)", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.x = 2)", [("FILTER_CHANGE", None, "predicate_modified,literal_changed")]),
    ("limit", "SELECT a FROM t LIMIT 5", "SELECT a FROM t LIMIT 9", [("UNCLASSIFIED_CHANGE", None, "limit")]),
    ("relation", "SELECT a FROM t", "SELECT a FROM u", [("UNCLASSIFIED_CHANGE", None, "relations")]),
    ("having", "SELECT a, SUM(x) AS v FROM t GROUP BY a HAVING SUM(x) > 1", "SELECT a, SUM(x) AS v FROM t GROUP BY a HAVING SUM(x) > 2", [("UNCLASSIFIED_CHANGE", None, "having")]),
    ("filter_and_limit", "SELECT a FROM t WHERE x > 1 LIMIT 5", "SELECT a FROM t WHERE x > 2 LIMIT 9", [("FILTER_CHANGE", None, "predicate_modified,literal_changed"), ("UNCLASSIFIED_CHANGE", None, "limit")]),
    ("removed_and_limit", "SELECT a, b FROM t LIMIT 5", "SELECT a FROM t LIMIT 9", [("OUTPUT_REMOVE", "b", "removed"), ("UNCLASSIFIED_CHANGE", None, "limit")]),
    ("cte_and_alias", "WITH c AS (SELECT a FROM t WHERE a > 1) SELECT a AS x FROM c", "WITH c AS (SELECT a FROM t WHERE a > 2) SELECT a AS y FROM c", [("OUTPUT_RENAME", "x", "renamed"), ("UNCLASSIFIED_CHANGE", None, "ctes")]),
    ("first_relation", "SELECT u.a FROM t JOIN u ON t.i = u.i WHERE u.x > 1", "SELECT u.a FROM v JOIN u ON v.i = u.i WHERE u.x > 2", [("FILTER_CHANGE", None, "predicate_modified,literal_changed"), ("JOIN_PREDICATE_CHANGE", None, "predicate_changed"), ("UNCLASSIFIED_CHANGE", None, "relations")]),
    ("offset_and_added", "SELECT a FROM t LIMIT 5 OFFSET 2", "SELECT a, b FROM t LIMIT 5 OFFSET 3", [("OUTPUT_ADD", "b", "added"), ("UNCLASSIFIED_CHANGE", None, "limit")]),
    ("named_window", "SELECT a FROM t WHERE a > 1 WINDOW w AS (ORDER BY a)", "SELECT a FROM t WHERE a > 2 WINDOW w AS (ORDER BY b)", [("FILTER_CHANGE", None, "predicate_modified,literal_changed"), ("UNCLASSIFIED_CHANGE", None, "windows")]),
    ("sort_scope", "SELECT a FROM t ORDER BY a", "SELECT a FROM t SORT BY a", [("UNCLASSIFIED_CHANGE", None, "ordering")]),
    ("sample", "SELECT a FROM t TABLESAMPLE (10 PERCENT)", "SELECT a AS b FROM t TABLESAMPLE (20 PERCENT)", [("OUTPUT_RENAME", "a", "renamed"), ("UNCLASSIFIED_CHANGE", None, "other")]),
    ("swapped", "SELECT a FROM t JOIN w ON t.i = w.i", "SELECT a FROM t", [("JOINED_RELATION_CHANGE", None, "join_removed")]),
]


def test_model_deltas(spark):
    for name, a, b, want in MODELS:
        got = sqlmodel.model_deltas(sqlmodel.parse_model(spark, a), sqlmodel.parse_model(spark, b))
        assert [(d["delta_type"], d["output"], ",".join(d["components"])) for d in got] == want, name


def test_grouping_by_parentheses_counts(spark):
    a, b = (sqlmodel.parse_model(spark, f"SELECT {e} AS v FROM t") for e in ("(a + b) * c", "a + b * c"))
    assert [d["delta_type"] for d in sqlmodel.model_deltas(a, b)] == ["DERIVED_EXPRESSION_CHANGE"]


def test_contracts(spark):
    m = sqlmodel.parse_model(spark, "WITH c AS (SELECT 1 AS a) SELECT o.id, sum(DISTINCT o.v) AS total FROM db.orders o LEFT JOIN c ON o.id = c.a WHERE o.v > 0 GROUP BY o.id;")
    assert list(m["ctes"]) == ["c"] and [r["name"] for r in m["relations"]] == ["db.orders", "c"] and m["relations"][1]["cte"] and m["joins"][0]["type"] == "LEFT"
    assert m["outputs"][1]["aggregates"] == [{"function": "sum", "distinct": True}] and m["grouping"] == ["o.id"]
    for bad in ("DELETE FROM t", "SELECT 1 + 1 FROM t", "SELECT a, b AS a FROM t", "SELECT a FROM t; SELECT b FROM t", "SELECT a FROM (SELECT a FROM t) x", "SELECT a FROM t UNION SELECT a FROM u", "not sql"):
        with pytest.raises(sqlmodel.ModelError):
            sqlmodel.parse_model(spark, bad)
    assert sqlmodel.compile_static_templates("select * from {{ ref('x') }} join {{ source('s', 't') }}", {"x": "db.x", "s.t": "raw.t"})[1] == ["db.x", "raw.t"]
    with pytest.raises(sqlmodel.ModelError):
        sqlmodel.compile_static_templates("{% if x %}", {})


def test_name_status():
    assert files.name_status(b"M\0a.sql\0R100\0b\0c\0A\0d\0D\0e\0") == [("MODIFIED", "a.sql", "a.sql"), ("RENAMED", "b", "c"), ("ADDED", None, "d"), ("DELETED", "e", None)]
    with pytest.raises(ValueError):
        files.name_status(b"R100\0b\0")


def test_documents():
    with pytest.raises(ValueError):
        files.strict_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        files.document("- a", "x.yml")
    assert files.flattened(files.document("a: [1, {b: x}]", "x.yml")) == [("$.a[0]", "1"), ("$.a[1].b", "x")]
    a = {"models": [{"name": "m", "columns": [{"name": "total", "data_type": "int"}, {"name": "k"}]}]}
    b = {"models": [{"name": "m", "columns": [{"name": "amount", "data_type": "int"}, {"name": "k", "description": "key"}]}]}
    found = files.schema_changes(a, b)
    assert {(x[0], x[1]) for x in found} == {("COLUMN_REMOVED", "m.total"), ("COLUMN_ADDED", "m.amount"), ("DESCRIPTION_CHANGED", "m.k")} and files.rename_claims(found) == [("m", "total", "amount")]
    assert files.document_changes([("$.a", "1"), ("$.b", "2")], [("$.a", "3"), ("$.c", "4")]) == [("CHANGED", "$.a", "1", "3"), ("REMOVED", "$.b", "2", None), ("ADDED", "$.c", None, "4")]


def test_pipeline_structure():
    s = files.pipeline_structure("a = Op(task_id='a', column='total')\nb = Op(task_id='b', table=make())\nc = Op(task_id='c')\na >> [b, c]\nc.set_upstream(b)\n")
    assert s["edges"] == [("a", "b"), ("a", "c"), ("b", "c")] and ("a.column", "total") in s["references"] and s["dynamic"] == ["b.table"]


def test_bundle(spark, tmp_path):
    for side, text in (("base", "select a"), ("head", "select b")):
        (tmp_path / side / "models").mkdir(parents=True)
        (tmp_path / side / "models" / "m.sql").write_text(text)
    (tmp_path / "bundle.json").write_text(json.dumps({"files": [{"status": "MODIFIED", "base_path": "models/m.sql", "head_path": "models/m.sql"}, {"status": "ADDED", "base_path": None, "head_path": "gone.sql"}]}))
    got = {r["head_path"]: (r["base_content"], r["head_content"]) for r in files.load_bundle(spark, str(tmp_path)).collect()}
    assert got == {"models/m.sql": ("select a", "select b"), "gone.sql": (None, None)}


def test_edits():
    assert repair.edit_yaml("a: x # keep\nb:\n  - y\n", "$.b[0]", "y", "z") == "a: x # keep\nb:\n  - z\n"
    assert json.loads(repair.edit_json('{"a": {"b": "x"}, "c": 1}', "$.a.b", "x", None)) == {"a": {}, "c": 1}
    assert repair.edit_python("f(col='old')  # é\n", "old", "new") == "f(col='new')  # é\n"
    assert repair.edit_sql("select old, 'old' from t -- old", "old", "new") == "select new, 'old' from t -- old"
    assert repair.edit_template_reference("{{ ref('old') }}", "old", "new") == "{{ ref('new') }}"
    for f, args in ((repair.edit_yaml, ("a: x\n", "$.b", "x", "z")), (repair.edit_json, ('{"a": "q"}', "$.a", "x", "z")), (repair.edit_python, ("f('a', 'a')", "a", "b")), (repair.edit_sql, ("select new", "old", "new"))):
        with pytest.raises(repair.EditError):
            f(*args)


def test_diffs():
    a, b = "".join(f"line {i}\n" for i in range(40)), "".join(f"line {i if i not in (3, 30) else 'x'}\n" for i in range(40)) + "end"
    p = repair.unified_diff("f", a, b)
    assert repair.apply_diff(a, p) == b
    with pytest.raises(repair.EditError):
        repair.apply_diff(a.replace("line 4\n", "other\n"), p)
    kinds = [k for k, *_ in repair.patch_lines(p)]
    assert kinds.count("added") == 3 and kinds.count("removed") == 2


def test_plan(spark):
    f = spark.createDataFrame([("a.yml", "f: old\ng: old\n"), ("b.yml", "f: other\n"), ("c.yml", "untouched: 1\n")], "path string, content string")
    x = spark.createDataFrame([("a.yml", 1, "yaml", "$.f", "old", "new"), ("a.yml", 2, "yaml", "$.g", "old", "new"), ("b.yml", 1, "yaml", "$.f", "old", "new")], "path string, position int, editor string, location string, current string, future string")
    got = {r["path"]: r for r in repair.apply_plan(f, x).collect()}
    assert got["a.yml"]["candidate"] == "f: new\ng: new\n" and got["a.yml"]["n_actions"] == 2 and got["b.yml"]["error"].startswith("EditError") and got["c.yml"]["patch"] == ""
    assert repair.completeness(2, 2, 0, 2) == "REPAIR_CANDIDATE_READY_FOR_REVIEW" and repair.completeness(2, 1, 1, 2) == "REPAIR_BLOCKED_BY_CONFLICT"


def test_package(tmp_path):
    folder = str(tmp_path / "out")
    package.write_package(folder, {"a": {"x": 1, "created_at": "now"}, "b": [1]})
    assert package.verify_package(folder) == []
    with pytest.raises(FileExistsError):
        package.write_package(folder, {"a": 1})
    (tmp_path / "out" / "b.json").write_text("[2]")
    assert package.verify_package(folder) == ["b"]
    assert package.fingerprint({"b": 1, "a": [1], "generated_at": 2}) == package.fingerprint({"a": [1], "b": 1})


def test_chains_either_way():
    source = "a = T(task_id='a')\nb = T(task_id='b')\nc = T(task_id='c')\nd = T(task_id='d')\n"
    down, up = files.pipeline_structure(source + "a >> b >> [c, d]")["edges"], files.pipeline_structure(source + "d << c << b << a")["edges"]
    assert down == [("a", "b"), ("b", "c"), ("b", "d")] and up == [("a", "b"), ("b", "c"), ("c", "d")]


def test_plain_pipeline_files_read_as_by_their_tree():
    plain = "from a.b import Op\n# x\nv1 = Op(task_id='t1', field=\"c\", n=2, owner=look(1), k=None)\nv2 = Op(task_id='t2', f='')\n%s\n"
    for chain in ("v1 >> v2 >> v1", "v2 << v1", "v1.set_downstream(v2)", "v2.set_upstream([v1])", "print('none')", ""):
        assert files._plain_structure(plain % chain) == files.parsed_structure(plain % chain) is not None
    for other in ("v1 >> [v2, v1]", "if v1:\n    v1 >> v2", "x = Op(task_id='a\\n')", "x = Op(task_id=f'a')", "x = Op(task_id='a', f='1', f='2')", "x = Op(f(a >> b), task_id='a')", "x = Op(task_id=make())", "a = b = Op(task_id='x')", "v1 >> v2 << v1", "é >> v1"):
        assert files._plain_structure(plain % other) is None and files.pipeline_structure(plain % other) == files.parsed_structure(plain % other)
    for bad in ("from = Op(task_id='a')", "None = Op(task_id='a')", "v1 = Op(None=1)", "v1 >> class", "from from import x", "v1 >> import", "True.set_upstream(", "v1 = (", "x = Op(a=01)", " v1 >> v2"):
        assert files._plain_structure(plain % bad) is None
        with pytest.raises(SyntaxError):
            files.pipeline_structure(plain % bad)
