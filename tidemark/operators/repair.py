"""Bounded repairs of repository files: structured edits, unified diffs, and applying a plan file by file."""

from __future__ import annotations

import ast
import difflib
import json
import re
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import composed_yaml, each, loaded_yaml, plain_yaml

MAX_ACTIONS, MAX_HUNKS = 500, 500


class EditError(ValueError):
    """An edit that is not safe: the target is not there once, or something else would change."""


def tokens(location: str) -> list[str | int]:
    """$.a.b[0] -> ['a', 'b', 0]"""
    if not location.startswith("$"):
        raise EditError(f"no location: {location}")
    return [int(i) if i else k for k, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", location)]


def value_at(value, path: list):
    for t in path:
        value = value[t]
    return value


_SPACE, _PLAIN = re.compile(r"[ \t\r\n]*"), re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
# An entry whose key and text have no escapes, and the space behind it: most are, and one match reads it.
_ENTRY = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\r\n]*:[ \t\r\n]*("[^"\\\x00-\x1f]*")[ \t\r\n]*')


def json_scalars(text: str) -> dict[tuple, tuple[int, int, int, object]]:
    """path -> (where its entry starts: the key, or the value in a list; where the value starts; its end; the value) of every scalar."""
    found: dict[tuple, tuple[int, int, int, object]] = {}
    skip = lambda i: _SPACE.match(text, i).end()

    def scan(i: int, path: tuple, entry: int) -> int:
        c = text[i : i + 1]
        if c in ("{", "["):
            i, n, seen, close = skip(i + 1), 0, set(), "}" if c == "{" else "]"
            while text[i : i + 1] != close:
                start, key = i, n
                m = _ENTRY.match(text, i) if c == "{" else None
                if m and m[1] not in seen:
                    seen.add(m[1])
                    s, e = m.span(2)
                    found[(*path, m[1])] = (start, s, e, text[s + 1 : e - 1])
                    i = m.end()
                elif c == "{":
                    if text[i : i + 1] != '"':
                        raise EditError("not JSON")
                    key, i = scanstring(text, i + 1, True)
                    i = skip(i)
                    if text[i : i + 1] != ":" or key in seen:
                        raise EditError("not JSON, or a key stands twice")
                    seen.add(key)
                    i = skip(scan(skip(i + 1), (*path, key), start))
                else:
                    i, n = skip(scan(i, (*path, key), start)), n + 1
                if text[i : i + 1] == ",":
                    i = skip(i + 1)
                    if text[i : i + 1] == close:
                        raise EditError("not JSON")
                elif text[i : i + 1] != close:
                    raise EditError("not JSON")
            return i + 1
        if c == '"':
            value, end = scanstring(text, i + 1, True)
        else:
            m = _PLAIN.match(text, i)
            if not m:
                raise EditError("not JSON")
            value, end = json.loads(m[0]), m.end()
        found[path] = (entry, i, end, value)
        return end

    try:
        end = scan(skip(0), (), skip(0))
    except (ValueError, RecursionError) as e:
        raise EditError(f"not JSON: {type(e).__name__}") from None
    if skip(end) != len(text):
        raise EditError("not JSON")
    return found


def edit_json_spans(content: str, edits: list[tuple[str, object, object]]) -> str:
    """(location, current, future) scalars replaced in their own characters, or their entries removed (future None): every other character stays, and
    the new document is proved to be the old one but for the edits."""
    spans, places, want = json_scalars(content), [], json.loads(content)
    for location, current, future in edits:
        path = tuple(tokens(location))
        if path not in spans:
            raise EditError("nothing stands there")
        entry, start, end, value = spans[path]
        if value != current or type(value) is not type(current):
            raise EditError("the value is another one")
        if future is not None:
            places.append((start, end, json.dumps(future, ensure_ascii=False)))
            value_at(want, list(path[:-1]))[path[-1]] = future
            continue
        after = _SPACE.match(content, end).end()
        if content[after : after + 1] == ",":
            places.append((entry, _SPACE.match(content, after + 1).end(), ""))
        else:
            before = len(content[:entry].rstrip(" \t\r\n"))
            places.append((before - 1 if content[before - 1] == "," else entry, end, ""))
    for path in sorted((tuple(tokens(x)) for x, _, f in edits if f is None), key=lambda p: [str(t).rjust(9) for t in p], reverse=True):
        del value_at(want, list(path[:-1]))[path[-1]]
    places.sort()
    if any(a[1] > b[0] for a, b in zip(places, places[1:], strict=False)):
        raise EditError("edits overlap")
    out, at = [], 0
    for start, end, text in places:
        out += [content[at:start], text]
        at = end
    out = "".join([*out, content[at:]])
    if json.loads(out) != want:
        raise EditError("the edit would change more")
    return out


def edit_json(content: str, location: str, current: str, future: str | None) -> str:
    """One scalar replaced (or its entry removed), every other character as it was."""
    return edit_json_spans(content, [(location, current, future)])


def edit_yaml_spans(content: str, edits: list[tuple[str, object, object]]) -> str:
    """(location, current, future) scalars replaced in their own characters and in their own quotes, or the lines of list entries and keys removed
    (future None); comments and layout stay.  The documents must differ in those places alone."""
    import yaml

    spans: dict[tuple, tuple[int, int, str]] = {}
    plain = plain_yaml(content, spans)
    if plain is not None and all(future is not None and tuple(tokens(location)) in spans for location, _, future in edits):
        return _edit_plain_yaml(content, plain, spans, edits)
    root, want, places, gone = composed_yaml(content), loaded_yaml(content), [], []

    def node_at(path: list):
        node, entry = root, root
        for t in path:
            if isinstance(node, yaml.MappingNode):
                hits = [(k, v) for k, v in node.value if k.value == t]
                if len(hits) != 1:
                    raise EditError("nothing stands there")
                entry, node = hits[0]
            elif isinstance(node, yaml.SequenceNode) and isinstance(t, int) and t < len(node.value):
                entry = node = node.value[t]
            else:
                raise EditError("nothing stands there")
        return entry, node

    for location, current, future in edits:
        path = tokens(location)
        entry, node = node_at(path)
        if not isinstance(node, yaml.ScalarNode) or node.value != str(current):
            raise EditError("the value is another one")
        s, e = node.start_mark.index, node.end_mark.index
        if future is not None:
            places.append((s, e, _yaml_scalar(content[s], future)))
            value_at(want, path[:-1])[path[-1]] = future
            continue
        low, high = content.rfind("\n", 0, entry.start_mark.index) + 1, content.find("\n", e)
        high = len(content) if high < 0 else high + 1
        if content[low : entry.start_mark.index].strip(" -") or content[e:high].split("#")[0].strip():
            raise EditError("the entry shares its lines")
        places.append((low, high, ""))
        gone.append(path)
    for path in sorted(gone, key=lambda p: [str(t).rjust(9) for t in p], reverse=True):
        del value_at(want, path[:-1])[path[-1]]
    return _proved_yaml(content, places, want)


def _yaml_scalar(first: str, future) -> str:
    """A scalar in the quotes of the one it replaces, whose first character is given; a plain one is quoted if it would be read as another value."""
    if first == "'":
        return "'" + str(future).replace("'", "''") + "'"
    if first == '"':
        return json.dumps(future, ensure_ascii=False)
    return str(future) if loaded_yaml(str(future)) == future else json.dumps(future, ensure_ascii=False)


def _proved_yaml(content: str, places: list[tuple[int, int, str]], want) -> str:
    """The content with its places replaced, if that gives the document that is wanted."""
    import yaml

    places.sort()
    if any(a[1] > b[0] for a, b in zip(places, places[1:], strict=False)):
        raise EditError("edits overlap")
    out, at = [], 0
    for start, end, text in places:
        out += [content[at:start], text]
        at = end
    out = "".join([*out, content[at:]])
    try:
        if loaded_yaml(out) != want:
            raise EditError("the edit would change more")
    except yaml.YAMLError:
        raise EditError("the edit breaks the document") from None
    return out


def _edit_plain_yaml(content: str, want: dict, spans: dict[tuple, tuple[int, int, str]], edits: list[tuple[str, object, object]]) -> str:
    """``edit_yaml_spans`` where plain lines alone make up the file and no entry is removed: the places come with the document."""
    places = []
    for location, current, future in edits:
        path = tokens(location)
        start, end, value = spans[tuple(path)]
        if value != str(current):
            raise EditError("the value is another one")
        places.append((start, end, _yaml_scalar(content[start], future)))
        value_at(want, path[:-1])[path[-1]] = future
    return _proved_yaml(content, places, want)


def edit_yaml(content: str, location: str, current: str, future: str | None) -> str:
    return edit_yaml_spans(content, [(location, current, future)])


def edit_python(content: str, current: str, future: str) -> str:
    """A string argument of a call, found by the syntax tree; it must stand there once, and the rest of the tree stays."""
    tree = ast.parse(content)
    spans = [x for node in ast.walk(tree) if isinstance(node, ast.Call) for x in [*node.args, *(k.value for k in node.keywords)] if isinstance(x, ast.Constant) and x.value == current]
    if len(spans) != 1:
        raise EditError(f"the argument stands there {len(spans)} times")
    node = spans[0]
    if node.lineno != node.end_lineno:
        raise EditError("the argument spans lines")
    lines = content.splitlines(keepends=True)
    raw = lines[node.lineno - 1].encode()
    lines[node.lineno - 1] = (raw[: node.col_offset] + raw[node.col_offset : node.end_col_offset].replace(current.encode(), future.encode(), 1) + raw[node.end_col_offset :]).decode()
    out = "".join(lines)
    node.value = future
    if ast.dump(ast.parse(out)) != ast.dump(tree):
        raise EditError("the edit would change more")
    return out


def edit_sql(content: str, current: str, future: str) -> str:
    """An identifier outside strings and comments; it must stand there at least once, and the new one nowhere."""
    lex = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_]\w*|\S", re.S)
    hits = [m for m in lex.finditer(content) if m[0].lower() == current.lower()]
    if not hits:
        raise EditError("the identifier is not there")
    if any(m[0].lower() == future.lower() for m in lex.finditer(content)):
        raise EditError("the new identifier is there already")
    out, at = [], 0
    for m in hits:
        out += [content[at : m.start()], future]
        at = m.end()
    return "".join([*out, content[at:]])


_LAST_LITERAL = re.compile(r"\{\{\s*(?:ref|source)\([^)]*?['\"]([^'\")]*)['\"]\s*\)\s*\}\}")


def edit_template_reference(content: str, current: str, future: str) -> str:
    """The literal of one static ref() or source()."""
    if set(current) & set("'\")"):
        found = list(re.finditer(r"\{\{\s*(?:ref|source)\([^)]*?['\"](" + re.escape(current) + r")['\"]\s*\)\s*\}\}", content))
    else:  # one pattern for all names: without quotes and brackets, a name is the last literal before its bracket or not there
        found = [m for m in _LAST_LITERAL.finditer(content) if m[1] == current]
    if len(found) != 1:
        raise EditError(f"the reference stands there {len(found)} times")
    return content[: found[0].start(1)] + future + content[found[0].end(1) :]


EDITORS = {"json": edit_json, "yaml": edit_yaml}
NAMED = {"python": edit_python, "sql": edit_sql, "template": edit_template_reference}


def unified_diff(path: str, before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{path}", f"b/{path}"))


def apply_diff(before: str, patch: str) -> str:
    """A unified diff applied strictly: context must match at the stated lines."""
    source, out, at = before.splitlines(keepends=True), [], 0
    lines = patch.splitlines(keepends=True)
    i, hunks = 0, 0
    while i < len(lines):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", lines[i])
        i += 1
        if not m:
            continue
        hunks += 1
        if hunks > MAX_HUNKS:
            raise EditError("too many hunks")
        start = int(m[1]) - (0 if m[2] == "0" else 1)
        out += source[at:start]
        at = start
        while i < len(lines) and not lines[i].startswith("@@"):
            kind, text = lines[i][:1], lines[i][1:]
            if kind in " -":
                if at >= len(source) or source[at] != text:
                    raise EditError("the context does not match")
                at += 1
            if kind in " +":
                out.append(text)
            i += 1
    return "".join(out + source[at:])


def patch_lines(patch: str) -> list[tuple[str, int | None, int | None, str]]:
    """(kind, old line, new line, text) of a diff's lines."""
    out, a, b = [], 0, 0
    for line in patch.splitlines():
        if m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)", line):
            a, b = int(m[1]), int(m[2])
            out.append(("hunk", None, None, line))
        elif line.startswith(("---", "+++")):
            out.append(("header", None, None, line))
        elif line.startswith("-"):
            out.append(("removed", a, None, line[1:]))
            a += 1
        elif line.startswith("+"):
            out.append(("added", None, b, line[1:]))
            b += 1
        else:
            out.append(("context", a, b, line[1:]))
            a, b = a + 1, b + 1
    return out


def edit_file(kind: str, content: str, edits: list[tuple[str, str, str | None]]) -> str:
    """All edits of one file, at places of their own: structured files in one pass, others one edit after another."""
    if kind == "json":
        return edit_json_spans(content, edits)
    if kind == "yaml":
        return edit_yaml_spans(content, edits)
    for _, current, future in edits:
        content = NAMED[kind](content, current, future)
    return content


PATCHED = "path string, candidate string, patch string, n_actions int, error string"


def apply_plan(files: DataFrame, actions: DataFrame) -> DataFrame:
    """Each file with its actions applied in order, and the diff; a file with an unsafe action keeps its content and says why.

    files: path, content.  actions: path, position, editor, location, current, future.  One exchange by path brings a file and its own actions (at
    most MAX_ACTIONS in a plan) into one row; rows are edited in batches, as a group of each file's own would cost more than its edits.
    """
    todo, file = F.struct("position", "editor", "location", "current", "future"), F.struct("content")
    rows = files.select("path", file.alias("file"), F.lit(None).cast(actions.select(todo.alias("t")).schema["t"].dataType).alias("todo")).unionByName(actions.select("path", F.lit(None).cast(files.select(file.alias("f")).schema["f"].dataType).alias("file"), todo.alias("todo")))
    own = rows.groupBy("path").agg(F.min("file").alias("file"), F.array_sort(F.collect_list("todo")).alias("todo")).where("file is not null")

    def one(path, before, todo):
        after, done, error = before, 0, None
        try:
            for x in todo:
                after = EDITORS[x["editor"]](after, x["location"], x["current"], x["future"]) if x["editor"] in EDITORS else NAMED[x["editor"]](after, x["current"], x["future"])
                done += 1
            patch = unified_diff(path, before, after)
            if apply_diff(before, patch) != after:
                raise EditError("the patch does not give the candidate")
        except (EditError, KeyError, SyntaxError) as e:
            after, patch, error = before, "", f"{type(e).__name__}: {e}"
        return path, after, patch, done, error

    return each(own.select("path", "file.content", "todo"), one, PATCHED)


def completeness(n_targets: int, n_done: int, n_conflicts: int, n_supported: int) -> str:
    if n_conflicts:
        return "REPAIR_BLOCKED_BY_CONFLICT"
    if n_supported == 0:
        return "NO_SUPPORTED_AUTOMATIC_REPAIR"
    return "REPAIR_CANDIDATE_READY_FOR_REVIEW" if n_done == n_targets else "PARTIAL_REPAIR_CANDIDATE"
