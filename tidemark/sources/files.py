"""Repository files as rows: classification, strict documents, pipelines' static structure, version control listings."""

from __future__ import annotations

import ast
import json
import keyword
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILES, MAX_BYTES = 200, 1_048_576
FILE_SCHEMA = "status STRING, base_path STRING, head_path STRING"


def name_status(raw: bytes) -> list[tuple[str, str | None, str | None]]:
    """(status, base path, head path) from NUL-separated name-status output; renames and copies take two paths."""
    parts = raw.decode("utf-8").split("\0")
    if parts and parts[-1] == "":
        parts.pop()
    out, i = [], 0
    while i < len(parts):
        kind = parts[i][:1]
        need = 3 if kind in "RC" else 2
        if kind not in "AMDRCT" or i + need > len(parts):
            raise ValueError(f"unreadable change record {parts[i : i + need]}")
        if need == 3:
            out.append(("RENAMED" if kind == "R" else "COPIED", parts[i + 1], parts[i + 2]))
        else:
            p = parts[i + 1]
            out.append({"A": ("ADDED", None, p), "D": ("DELETED", p, None)}.get(kind, ("MODIFIED", p, p)))
        i += need
    return out


def load_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """bundle.json's files with the contents of both sides; a missing file is a null content."""
    manifest = spark.read.option("multiLine", True).json(f"{folder}/bundle.json").select(F.explode("files").alias("f")).select("f.status", "f.base_path", "f.head_path")

    def side(name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{name}")
        return files.select(F.regexp_extract("path", f".*?/{name}/(.*)$", 1).alias(f"{name}_path"), F.col("content").cast("string").alias(f"{name}_content"), F.col("length").alias(f"{name}_size"))

    return manifest.join(side("base"), "base_path", "left").join(side("head"), "head_path", "left").select("status", "base_path", "head_path", "base_content", "head_content", "base_size", "head_size")


def classify(path: Column, content: Column) -> Column:
    """The category of a file by its extension, folders and content."""
    p, name = F.lower(path), F.lower(F.element_at(F.split(path, "/"), -1))
    under = lambda *folders: F.arrays_overlap(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), F.array(*[F.lit(f) for f in folders]))
    data = p.rlike(r"\.(ya?ml|json)$")
    key = lambda k: content.rlike(rf"(?m)^\s*\"?{k}\"?\s*:")
    return (
        F.when(F.coalesce(F.contains(content, F.lit("\x00")), F.lit(False)), "UNSUPPORTED")
        .when(p.endswith(".sql"), F.when(F.contains(content, F.lit("{{")), "DBT_MODEL").otherwise("SQL_MODEL"))
        .when(p.endswith(".py") & under("dag", "dags", "pipelines"), "PIPELINE_DAG")
        .when(p.rlike(r"\.(md|rst|txt)$"), "DOCUMENTATION_ONLY")
        .when(data & name.rlike(r"^schema\.ya?ml$"), "DBT_SCHEMA")
        .when(data & F.contains(p, F.lit("contract")), "SCHEMA_CONTRACT")
        .when(data & (F.contains(p, F.lit("quality")) | F.contains(name, F.lit("check"))), "QUALITY_CONFIG")
        .when(data & under("dag", "dags", "pipeline", "pipelines"), "PIPELINE_CONFIG")
        .when(data & key("models"), "DBT_SCHEMA").when(data & key("contract"), "SCHEMA_CONTRACT").when(data & (key("pipeline") | key("tasks")), "PIPELINE_CONFIG")
        .otherwise("UNSUPPORTED")
    )


def strict_json(text: str):
    """JSON that may not repeat a key in an object."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError("duplicate keys")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def _by_yaml(function, text: str, loader: str):
    """function(text, a loader): libyaml's, ten times as fast, unless it is not at hand, refuses the text, or would count a byte order mark otherwise."""
    import yaml

    if hasattr(yaml, f"C{loader}") and not text.startswith("\ufeff"):
        try:
            return function(text, getattr(yaml, f"C{loader}"))
        except yaml.YAMLError:
            pass
    return function(text, getattr(yaml, loader))


# Plain YAML, a line each: comments, keys with a word or a quoted text of ASCII without escapes, lists of such mappings below a key.
_WORD = r"(?!(?i:yes|no|on|off|true|false|null|y|n)(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*"
_SCALAR = rf"{_WORD}|'[ -&(-~]*'|\"[ !#-\[\]-~]*\""
_YAML_LINE = re.compile(rf"(?P<indent> *)(?P<dash>- )?(?P<key>{_WORD}):(?: (?P<value>{_SCALAR}))?(?: +#[ -~]*)?")
_YAML_COMMENT, _YAML_WORD = re.compile(r" *(?:#[ -~]*)?"), re.compile(_WORD)


def plain_yaml(text: str, spans: dict[tuple, tuple[int, int, str]] | None = None) -> dict | None:
    """The document of a file that plain lines alone make up, or None: those are read in a fraction of the time that a loader takes.  A key without a
    value must lead a list, items begin at one column, and no key may stand twice.  ``spans`` gets path -> (start, end, value) of every scalar."""
    root, at, items, item, below, key = {}, 0, None, None, -1, None
    for line in text.split("\n"):
        found = _YAML_LINE.fullmatch(line)
        if found is None:
            if not _YAML_COMMENT.fullmatch(line):
                return None
            at += len(line) + 1
            continue
        indent, dash, name, value = found.groups()
        width = len(indent)
        if dash:
            if items is None or value is None or (items and width != below):
                return None
            below, item = width, {}
            items.append(item)
            own = item
        elif width == 0:
            if items is not None and not items or name in root:
                return None
            own, item, items, key = root, None, None, name
            if value is None:
                root[name] = items = []
        elif item is None or value is None or width != below + 2 or name in item:
            return None
        else:
            own = item
        if value is not None:
            own[name] = read = value[1:-1] if value[0] in "'\"" else value
            if spans is not None:
                start = at + found.start("value")
                spans[(name,) if item is None else (key, len(items) - 1, name)] = (start, start + len(value), read)
        at += len(line) + 1
    return root if root and items != [] else None


def loaded_yaml(text: str):
    import yaml

    if _YAML_WORD.fullmatch(text):
        return text
    found = plain_yaml(text)
    return _by_yaml(yaml.load, text, "SafeLoader") if found is None else found


def composed_yaml(text: str):
    import yaml

    return _by_yaml(yaml.compose, text, "SafeLoader")


def document(text: str, path: str) -> dict:
    """A YAML or JSON object of bounded size, without templates."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("file too large")
    if "{{" in text or "{%" in text:
        raise ValueError("templates are not static documents")
    if path.endswith(".json"):
        found = strict_json(text)
    else:
        found = loaded_yaml(text)
    if not isinstance(found, dict):
        raise ValueError("the root is no object")
    return found


def flattened(value, prefix: str = "$") -> list[tuple[str, str]]:
    """(location, text) of every scalar in a document."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{prefix}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flattened(v, f"{prefix}[{i}]")]
    return [(prefix, "" if value is None else str(value))]


# Nodes without a part that a pipeline's structure could stand in.
_LEAVES = frozenset([ast.Constant, ast.Name, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, *(t for base in (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop) for t in base.__subclasses__())])


def _nodes(tree: ast.AST):
    """The nodes of a tree level by level, as ``ast.walk`` gives them, but for leaves: a few times as fast, which counts as files are many and short."""
    level, leaves = [tree], _LEAVES
    while level:
        yield from level
        below = []
        for node in level:
            own = node.__dict__
            for name in node._fields:
                part = own.get(name)
                if type(part) is list:
                    below += [x for x in part if type(x) not in leaves and isinstance(x, ast.AST)]
                elif type(part) not in leaves and isinstance(part, ast.AST):
                    below.append(part)
        level = below


# Plain statements, a line each: comments, imports, names of a number, tasks of literals and calls, chains, set_upstream and set_downstream, calls of a literal.
_NAME, _TEXT = rf"(?!(?:{'|'.join([*keyword.kwlist, '__debug__'])})(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*", r"'[ !#-&(-\[\]-~]*'|\"[ !#-&(-\[\]-~]*\""
_VALUE = rf"(?:(?:{_TEXT}|0|[1-9][0-9]{{0,17}}|True|False|None)|{_NAME}\([0-9]?\))"
_PLAIN = re.compile(
    rf"(?:#[ -~]*|from {_NAME}(?:\.{_NAME})* import {_NAME}|{_NAME} = -?(?:0|[1-9][0-9]{{0,17}})(?:\.[0-9]{{1,17}})?|{_NAME}\((?:{_TEXT})\)|"
    rf"(?P<task>{_NAME}) = {_NAME}\((?P<args>{_NAME}={_VALUE}(?:, {_NAME}={_VALUE})*)\)|"
    rf"(?P<chain>{_NAME}(?:(?: >> {_NAME}){{1,50}}|(?: << {_NAME}){{1,50}}))|(?P<at>{_NAME})\.set_(?P<way>up|down)stream\((?:(?P<one>{_NAME})|\[(?P<only>{_NAME})\])\))?"
)
_ARGUMENT = re.compile(rf"({_NAME})=({_VALUE})")


def _plain_structure(source: str) -> dict | None:
    """``pipeline_structure`` of a file that plain statements alone make up, or None: those are read in a fraction of the time that a syntax tree takes."""
    tasks, edges, references, dynamic = {}, set(), [], []
    for line in source.split("\n"):
        found = _PLAIN.fullmatch(line)
        if found is None:
            return None
        name, args, chain, at, way, one, only = found.groups()
        if name:
            pairs = _ARGUMENT.findall(args)
            own = dict(pairs)
            if len(own) < len(pairs):
                return None
            if "task_id" in own:
                task = own.pop("task_id")
                if task[0] not in "'\"":
                    return None
                tasks[name] = task = task[1:-1]
                references += [(f"{task}.{k}", v[1:-1]) for k, v in own.items() if v[0] in "'\""]
                dynamic += [f"{task}.{k}" for k, v in own.items() if v[-1] == ")"]
        elif chain:
            ids = chain.split(" >> ") if ">" in chain else chain.split(" << ")[::-1]
            edges.update(zip(ids, ids[1:]))
        elif at:
            edges.add((at, one or only) if way == "down" else (one or only, at))
    return {"tasks": tasks, "edges": sorted(edges), "references": sorted(references), "dynamic": sorted(dynamic)}


def pipeline_structure(source: str) -> dict:
    """Tasks, dependencies (``a >> b``, set_upstream, set_downstream) and string references of a pipeline file, statically; what is computed
    is listed as dynamic."""
    found = _plain_structure(source)
    return parsed_structure(source) if found is None else found


def parsed_structure(source: str) -> dict:
    """``pipeline_structure`` by the syntax tree, whatever the file's statements are."""
    tree = ast.parse(source)
    tasks, edges, references, dynamic = {}, set(), [], []

    def names(node) -> list[str]:
        if isinstance(node, ast.Name):
            return [node.id]
        if isinstance(node, (ast.List, ast.Tuple)):
            return [n for x in node.elts for n in names(x)]
        if isinstance(node, ast.BinOp):
            return names(node.right)  # a shift either way gives back what stands right of it
        return []

    def shifts(node) -> None:
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.RShift, ast.LShift)):
            shifts(node.left)
            a, b = names(node.left), names(node.right)
            edges.update((x, y) if isinstance(node.op, ast.RShift) else (y, x) for x in a for y in b)

    for node in _nodes(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name):
            args = {k.arg: k.value for k in node.value.keywords if k.arg}
            if "task_id" in args:
                if isinstance(args["task_id"], ast.Constant):
                    static = {k: v.value for k, v in args.items() if isinstance(v, ast.Constant)}
                    tasks[node.targets[0].id] = static
                    references += [(f"{static['task_id']}.{k}", str(v)) for k, v in static.items() if k != "task_id" and isinstance(v, str)]
                    dynamic += [f"{static['task_id']}.{k}" for k, v in args.items() if not isinstance(v, (ast.Constant, ast.List, ast.Dict, ast.Tuple))]
                else:
                    dynamic.append(node.targets[0].id)
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.BinOp):
            shifts(node.value)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("set_upstream", "set_downstream") and isinstance(node.func.value, ast.Name):
            for other in (n for a in node.args for n in names(a)):
                edges.add((node.func.value.id, other) if node.func.attr == "set_downstream" else (other, node.func.value.id))
    return {"tasks": {k: v["task_id"] for k, v in tasks.items()}, "edges": sorted(edges), "references": sorted(references), "dynamic": sorted(dynamic)}


def document_changes(before: list[tuple[str, str]], after: list[tuple[str, str]]) -> list[tuple[str, str, str | None, str | None]]:
    """(ADDED, REMOVED or CHANGED, location, before, after)."""
    a, b = dict(before), dict(after)
    out = [("REMOVED", k, v, None) for k, v in a.items() if k not in b] + [("ADDED", k, None, v) for k, v in b.items() if k not in a]
    return sorted(out + [("CHANGED", k, a[k], b[k]) for k in a if k in b and a[k] != b[k]], key=lambda x: (x[1], x[0]))


def schema_changes(before: dict, after: dict) -> list[tuple[str, str, str | None]]:
    """(change, model.column, detail) between two schema documents: models, columns, types, tests, descriptions."""

    def columns(doc: dict) -> dict[str, dict]:
        return {f"{m['name']}.{c['name']}": c for m in doc.get("models") or [] for c in m.get("columns") or []}

    a, b = columns(before), columns(after)
    out = [("COLUMN_REMOVED", k, None) for k in a if k not in b] + [("COLUMN_ADDED", k, None) for k in b if k not in a]
    for k in a.keys() & b.keys():
        for what, key in (("TYPE_CHANGED", "data_type"), ("TESTS_CHANGED", "tests"), ("CONSTRAINTS_CHANGED", "constraints"), ("DESCRIPTION_CHANGED", "description")):
            if a[k].get(key) != b[k].get(key):
                out.append((what, k, f"{a[k].get(key)} -> {b[k].get(key)}"))
    models = [{m["name"] for m in d.get("models") or []} for d in (before, after)]
    out += [("MODEL_REMOVED", m, None) for m in models[0] - models[1]] + [("MODEL_ADDED", m, None) for m in models[1] - models[0]]
    return sorted(out)


def rename_claims(changes: list[tuple[str, str, str | None]]) -> list[tuple[str, str, str]]:
    """(model, old column, new column) where exactly one column went and one came."""
    by: dict[str, dict[str, list]] = {}
    for what, key, _ in changes:
        model, _, column = key.partition(".")
        by.setdefault(model, {"COLUMN_REMOVED": [], "COLUMN_ADDED": []}).get(what, []).append(column)
    return sorted((m, x["COLUMN_REMOVED"][0], x["COLUMN_ADDED"][0]) for m, x in by.items() if len(x["COLUMN_REMOVED"]) == len(x["COLUMN_ADDED"]) == 1)


def each(df: DataFrame, function, schema: str) -> DataFrame:
    """function(*row) -> a tuple, for every row of a table of files, in Arrow batches; for what only a parser of the file's own kind can do.

    Structs are given as tuples: Arrow takes dicts many times as long.  A table of files is small in bytes and long to parse, so its rows are first dealt to all tasks: a scan or a coalesced exchange would put them in a few.
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [function(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks).mapInArrow(run, schema)
