"""Queries of repair plans and their projection, with their SQL: a plan for each part that is renamed, suppliers' files as the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.store import Scratch, dealt
from ..operators import changes, planning, repair
from ..sources import files as repository
from ..sources import registry as reg
from .catalog import query

_CATEGORIES = ("PIPELINE_DAG", "QUALITY_CONFIG", "PIPELINE_CONFIG", "DBT_SCHEMA", "SCHEMA_CONTRACT", "SQL_MODEL", "DBT_MODEL")
_CATEGORY = f"[{', '.join(f"'{c}'" for c in _CATEGORIES)}][l_suppkey % 7 + 1]"
PLANS = f"""refs AS (SELECT 's' || l_suppkey AS file_id, CASE l_returnflag WHEN 'A' THEN 'dataset' ELSE 'field' END AS kind, '$.l' || l_orderkey || '.' || l_linenumber AS location, 'col_' || l_partkey AS value FROM lineitem),
grp AS (SELECT p_partkey AS part, 'col_' || p_partkey AS current, CASE WHEN p_size > 45 THEN 2 WHEN p_size < 3 THEN 0 ELSE 1 END AS n_futures FROM part),
roots AS (SELECT DISTINCT l_partkey AS part, 'p' || l_partkey AS plan_id, 'r' || l_partkey || '/' || l_suppkey AS root_id, 'g' || l_partkey || '/' || l_suppkey % 3 AS group_id, CASE WHEN l_suppkey % 13 <> 0 THEN 's' || l_suppkey END AS file_id, l_suppkey % 11 = 0 AS dynamic,
  CASE WHEN (l_partkey + l_suppkey) % 6 < 3 THEN '{planning.STALE}' WHEN (l_partkey + l_suppkey) % 6 = 3 THEN 'SEMANTIC_DEFINITION_CHANGED' WHEN (l_partkey + l_suppkey) % 6 = 4 THEN 'CONTRACT_CHANGE' ELSE 'OTHER' END AS root_type, {_CATEGORY} AS category FROM lineitem),
seen AS (SELECT file_id, value, count(*) AS n, min((location, kind)) AS first_ FROM refs GROUP BY 1, 2),
targets AS (SELECT r.* EXCLUDE (category, dynamic), CASE WHEN r.file_id IS NOT NULL THEN r.category END AS category, r.file_id IS NOT NULL AND r.dynamic AS dynamic, current, n_futures, 'models/' || r.file_id AS path, coalesce(n, 0) AS n_matches, first_[1] AS location, first_[2] AS kind FROM roots r JOIN grp g ON g.part = r.part LEFT JOIN seen ON seen.file_id = r.file_id AND seen.value = current),
ruled AS (SELECT *, CASE WHEN category IN ('PIPELINE_DAG', 'PIPELINE_CONFIG', 'QUALITY_CONFIG') THEN CASE WHEN kind = 'dataset' THEN 'repair.stale-dataset.static-reference.v1' WHEN category = 'PIPELINE_DAG' THEN 'repair.stale-field.dag-static.v1' WHEN category = 'QUALITY_CONFIG' THEN 'repair.stale-field.quality-config.v1' ELSE 'repair.stale-field.pipeline-config.v1' END END AS fits FROM targets),
classified AS (SELECT *, CASE WHEN n_futures > 1 THEN 'explicit-conflict' WHEN dynamic THEN 'dynamic-reference' WHEN root_type = 'SEMANTIC_DEFINITION_CHANGED' THEN 'semantic-intent' WHEN root_type = '{planning.STALE}' THEN CASE WHEN n_futures <> 1 THEN 'missing-coherent-identity' WHEN path IS NULL OR n_matches <> 1 OR fits IS NULL THEN 'ambiguous-static-target' ELSE 'one-target-one-rule' END WHEN root_type = 'CONTRACT_CHANGE' THEN 'change-source-or-intent' ELSE 'root-type' END AS basis FROM ruled),
stated AS (SELECT *, CASE basis WHEN 'explicit-conflict' THEN 'BLOCKED_BY_CONFLICT' WHEN 'dynamic-reference' THEN 'UNSUPPORTED' WHEN 'root-type' THEN 'UNSUPPORTED' WHEN 'one-target-one-rule' THEN 'AUTO_REPAIRABLE' WHEN 'semantic-intent' THEN 'MANUAL_DECISION_REQUIRED' WHEN 'change-source-or-intent' THEN 'MANUAL_DECISION_REQUIRED' ELSE 'BLOCKED_BY_MISSING_EVIDENCE' END AS state FROM classified),
acts AS (SELECT plan_id, group_id, path, 'act-' || substr(sha256(concat_ws(chr(31), root_id, fits, path, location, current, 'new' || substr(current, 4))), 1, 20) AS action_id, root_id, fits AS rule_id, CASE WHEN category = 'QUALITY_CONFIG' THEN 40 ELSE 30 END AS rank, location FROM stated WHERE state = 'AUTO_REPAIRABLE'),
chain AS (SELECT *, row_number() OVER w AS step, first_value(action_id) OVER w AS head FROM acts WINDOW w AS (PARTITION BY plan_id, group_id ORDER BY rank, path, location, action_id))"""


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """roots, groups, files and references, as ``planning.stale_targets`` takes them."""
    lines, text = reg.table(spark, sf_dir, "lineitem"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pair, n = dealt(lines.select("l_partkey", "l_suppkey"), lines.count(), "l_partkey").distinct(), (F.col("l_partkey") + F.col("l_suppkey")) % 6
    kind = F.when(n < 3, planning.STALE).when(n == 3, "SEMANTIC_DEFINITION_CHANGED").when(n == 4, "CONTRACT_CHANGE").otherwise("OTHER")
    group = F.concat(text("g", "l_partkey"), F.lit("/"), (F.col("l_suppkey") % 3).cast("string"))
    roots = pair.select(text("p", "l_partkey").alias("plan_id"), F.concat(text("r", "l_partkey"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("root_id"), kind.alias("root_type"), group.alias("group_id"), F.when(F.col("l_suppkey") % 13 != 0, text("s", "l_suppkey")).alias("file_id"))
    sizes = reg.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    futures = F.when(F.col("p_size") > 45, F.array(text("new_", "p_partkey"), text("newer_", "p_partkey"))).when(F.col("p_size") < 3, F.array().cast("array<string>")).otherwise(F.array(text("new_", "p_partkey")))
    groups = sizes.crossJoin(F.broadcast(spark.range(3))).select(F.concat(text("g", "p_partkey"), F.lit("/"), F.col("id").cast("string")).alias("group_id"), text("col_", "p_partkey").alias("current"), futures.alias("futures"))
    category = F.get(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.col("s_suppkey") % 7).cast("int"))
    files = reg.table(spark, sf_dir, "supplier").select(text("s", "s_suppkey").alias("file_id"), text("models/s", "s_suppkey").alias("path"), category.alias("category"), (F.col("s_suppkey") % 11 == 0).alias("dynamic"))
    references = lines.select(text("s", "l_suppkey").alias("file_id"), F.when(F.col("l_returnflag") == "A", "dataset").otherwise("field").alias("kind"), F.concat(text("$.l", "l_orderkey"), F.lit("."), F.col("l_linenumber").cast("string")).alias("location"), text("col_", "l_partkey").alias("value"))
    return roots, groups, files, references


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    registries = _registries(spark, sf_dir)
    return planning.classified(planning.stale_targets(*registries, registries[3].count()))


@query(f"WITH {PLANS} SELECT root_id, state, basis, n_matches, path, CASE WHEN state = 'AUTO_REPAIRABLE' THEN fits END AS rule_id FROM stated")
def d19_stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root with its file, its one parsed reference and its one rule, or why there is none."""
    return _classified(spark, sf_dir).select("root_id", "state", "basis", "n_matches", "path", "rule_id")


@query(f"WITH {PLANS} SELECT plan_id, action_id, root_id, rule_id, row_number() OVER (PARTITION BY plan_id ORDER BY step, head)::INTEGER AS position, 'ORDERED' AS state FROM chain")
def n02_repair_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions of all plans, chained within their groups, in the order in which they are to be applied."""
    with Scratch(spark) as scratch:
        actions = scratch.keep(planning.planned_actions(_classified(spark, sf_dir)), "actions")
        orders = planning.topological_orders(actions)
        return scratch.result(orders.join(actions.select("plan_id", "action_id", "root_id", "rule_id"), ["plan_id", "action_id"]).select("plan_id", "action_id", "root_id", "rule_id", "position", "state"))


@query(f"""WITH {PLANS}, n AS (SELECT plan_id, count(*) AS n_roots, count(*) FILTER (WHERE state = 'AUTO_REPAIRABLE') AS n_actions, count(*) FILTER (WHERE state = 'MANUAL_DECISION_REQUIRED') AS n_manual, count(*) FILTER (WHERE state LIKE 'BLOCKED%' OR state = 'UNSUPPORTED') AS n_blocked, bool_or(state = 'BLOCKED_BY_CONFLICT') AS conflict FROM stated GROUP BY 1)
SELECT plan_id, n_roots, n_actions, n_manual, n_blocked, CASE WHEN n_actions = 0 THEN 'NO_SUPPORTED_REPAIR' WHEN n_actions = n_roots THEN 'FULLY_ADDRESSED_SELECTED_ROOTS' ELSE 'PARTIALLY_ADDRESSED_SELECTED_ROOTS' END AS completeness,
CASE WHEN conflict AND n_actions = 0 THEN 'REPAIR_BLOCKED_BY_CONFLICT' WHEN n_actions = 0 THEN 'NO_SUPPORTED_AUTOMATIC_REPAIR' WHEN n_actions < n_roots THEN 'PARTIAL_REPAIR_CANDIDATE' ELSE 'REPAIR_CANDIDATE_READY_FOR_REVIEW' END AS disposition FROM n""")
def f20_plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each plan's roots its actions address, and what becomes of it."""
    with Scratch(spark) as scratch:
        roots = scratch.keep(planning.needed(_classified(spark, sf_dir)), "roots")
        actions = scratch.keep(planning.planned_actions(roots).select("plan_id", "action_id", "depends_on"), "actions")
        return scratch.result(planning.outcomes(roots, planning.topological_orders(actions)))


# Dependencies that are no chains: an order's lines wait for lines of smaller parts, by the line's number; some wait for a line that is not there or for each other.
_WAITS = """lines AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY i) AS i FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS i FROM lineitem)), top AS (SELECT o, max(i) AS n FROM lines GROUP BY o),
waits AS (SELECT o, i, list_filter([i - 2, i - 3, CASE WHEN o % 7 = 0 AND i = 1 THEN n END, CASE WHEN o % 11 = 0 THEN n + 1 END], lambda x: x > 0) AS deps, n FROM lines JOIN top USING (o)),
bad AS (SELECT o, CASE WHEN o % 11 = 0 THEN 'UNKNOWN_DEPENDENCY' WHEN o % 7 = 0 AND n <> 2 THEN 'CYCLE' ELSE 'ORDERED' END AS state FROM top)"""


def _steps(n: int = 7) -> str:
    """The order one action at a time: the next is the free one whose last dependency came first, then the smallest."""
    parts = ["p0 AS (SELECT o, []::BIGINT[] AS done FROM bad WHERE state = 'ORDERED')"]
    for k in range(n):
        parts.append(f"p{k + 1} AS (SELECT p.o, CASE WHEN f.i IS NULL THEN done ELSE list_append(done, f.i) END AS done FROM p{k} p LEFT JOIN (SELECT q.o, arg_min(i, (coalesce(list_max(list_transform(deps, lambda d: list_position(q.done, d))), 0), i)) AS i FROM p{k} q JOIN waits w ON w.o = q.o WHERE NOT list_contains(q.done, i) AND len(list_filter(deps, lambda d: NOT list_contains(q.done, d))) = 0 GROUP BY q.o) f ON f.o = p.o)")
    return ", ".join(parts)


@query(f"WITH {_WAITS}, {_steps()} SELECT o AS plan_id, 'a' || i AS action_id, CASE WHEN state = 'ORDERED' THEN list_position(done, i) END::INTEGER AS position, state FROM waits JOIN bad USING (o) LEFT JOIN p7 USING (o)")
def e24_topological_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of all orders' plans, whose lines wait for several others; unknown dependencies and cycles are states."""
    numbers = reg.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), "l_linenumber").distinct()
    lines = numbers.select("plan_id", F.row_number().over(Window.partitionBy("plan_id").orderBy("l_linenumber")).alias("i"))
    top = lines.groupBy("plan_id").agg(F.max("i").alias("n"))
    deps = F.array(F.col("i") - 2, F.col("i") - 3, F.when((F.col("plan_id") % 7 == 0) & (F.col("i") == 1), F.col("n")), F.when(F.col("plan_id") % 11 == 0, F.col("n") + 1))
    waits = F.transform(F.filter(deps, lambda x: x > 0), lambda x: F.concat(F.lit("a"), x.cast("string")))
    return planning.topological_orders(lines.join(top, "plan_id").select("plan_id", F.concat(F.lit("a"), F.col("i").cast("string")).alias("action_id"), waits.alias("depends_on")))


@query(f"""WITH {PLANS}, claims AS (SELECT 'c' || p_partkey AS claim_id, 'col_' || p_partkey AS value FROM part WHERE p_size BETWEEN 3 AND 45), own AS (SELECT DISTINCT 'c' || l_partkey AS claim_id, 's' || l_suppkey AS file_id FROM lineitem WHERE l_linenumber = 1)
SELECT claim_id, file_id, kind, count(*) AS n FROM claims JOIN refs USING (value) ANTI JOIN own USING (claim_id, file_id) GROUP BY 1, 2, 3""")
def d20_referencing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to each renamed field in files that do not contribute to its change."""
    references = _registries(spark, sf_dir)[3]
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    claims = reg.table(spark, sf_dir, "part").where("p_size BETWEEN 3 AND 45").select(text("c", "p_partkey").alias("claim_id"), text("col_", "p_partkey").alias("current"))
    own = reg.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(text("c", "l_partkey").alias("claim_id"), text("s", "l_suppkey").alias("file_id"))
    return planning.other_references(claims, own, references, references.count()).groupBy("claim_id", "file_id", "kind").agg(F.count("*").alias("n"))


def _repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier that names the parts it ships: JSON, YAML or a pipeline in Python, with layouts and comments of their own."""
    parts = reg.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    own = reg.table(spark, sf_dir, "supplier").join(parts, F.col("l_suppkey") == F.col("s_suppkey"))
    listed = lambda line, mark: F.array_join(F.transform("parts", line), mark)
    col = lambda p: F.concat(F.lit("col_"), p.cast("string"))
    name, balance = F.to_json(F.struct(F.col("s_name").alias("n"))), F.col("s_acctbal").cast("string")
    as_json = F.concat(F.lit('{"owner" : '), F.regexp_extract(name, r'^\{"n":(.*)\}$', 1), F.lit(', "balance":'), balance, F.lit(',\n "columns": [\n'), listed(lambda p: F.concat(F.lit('  {"name":  "'), col(p), F.lit('", "type": "'), (p % 3).cast("string"), F.lit('"}')), ",\n"), F.lit("\n ]}\n"))
    as_yaml = F.concat(F.lit("# checks of "), F.col("s_name"), F.lit("\nchecks:\n"), listed(lambda p: F.concat(F.lit("  - field: "), F.when(p % 2 == 0, F.concat(F.lit("'"), col(p), F.lit("'"))).otherwise(col(p)), F.lit("  # kept\n    rule: not_null")), "\n"), F.lit("\n"))
    as_python = F.concat(F.lit("from jobs import Task\n\nbalance = "), balance, F.lit("\n"), listed(lambda p: F.concat(F.lit("t"), p.cast("string"), F.lit(' = Task(task_id="t'), p.cast("string"), F.lit('", field="'), col(p), F.lit('")')), "\n"), F.lit("\n"))
    kind = F.get(F.array(F.lit("python"), F.lit("yaml"), F.lit("json"), F.lit("yaml"), F.lit("json")), (F.col("s_suppkey") % 5).cast("int"))
    return own.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_id"), kind.alias("kind"), F.when(kind == "json", as_json).when(kind == "yaml", as_yaml).otherwise(as_python).alias("content"))


def _parsed(files: DataFrame) -> DataFrame:
    """file_id, location, value: the static references that each file's parser finds."""

    def references(file_id, kind, content):
        if kind == "python":
            found = [(where, value) for where, value in repository.pipeline_structure(content)["references"]]
        else:
            found = [(where, value) for where, value in repository.flattened(repository.document(content, f"x.{kind}")) if where.endswith((".name", ".field"))]
        return file_id, found

    own = repository.each(files.select("file_id", "kind", "content"), references, "file_id string, refs array<struct<location: string, value: string>>")
    return own.select("file_id", F.explode("refs").alias("r")).select("file_id", "r.location", "r.value")


def _edited(files: DataFrame, actions: DataFrame) -> DataFrame:
    """file_id, candidate, error of the files that have actions, all of a file's edits in one pass; files with more than the most actions are left out."""
    todo = actions.groupBy("file_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("location", "current", "future"))).alias("edits")).where(F.col("n") <= repair.MAX_ACTIONS)

    def edit(file_id, kind, content, edits):
        try:
            return file_id, repair.edit_file(kind, content, [(e["location"], e["current"], e["future"]) for e in edits]), None
        except (repair.EditError, SyntaxError) as e:
            return file_id, None, f"{type(e).__name__}: {e}"

    return repository.each(files.join(todo, "file_id").select("file_id", "kind", "content", "edits"), edit, "file_id string, candidate string, error string")


@query("""WITH own AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem), renamed AS (SELECT o.*, p_size FROM own o JOIN part ON p_partkey = part WHERE p_size % 2 = 0),
n AS (SELECT part, count(*) AS n_stale, count(*) FILTER (WHERE supp % 5 <> 0) AS n_closed FROM renamed GROUP BY 1)
SELECT 'col_' || part AS current, n_stale, n_closed, n_stale - n_closed AS n_open, 0::BIGINT AS n_new, CASE WHEN n_closed = n_stale THEN 'COHERENT' WHEN n_closed = 0 THEN 'INCONSISTENT' ELSE 'PARTIALLY_COHERENT' END AS coherence, true AS same_as_full FROM n""")
def n08_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository after its repairs: stale references closed, open and new for each renamed field, from files parsed again only where an edit
    touched them, and whether a full run gives the same references.  Pipelines in Python are left alone, the other files are edited."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    claims = reg.table(spark, sf_dir, "part").where("p_size % 2 = 0").select(text("col_", "p_partkey").alias("value"), text("new_", "p_partkey").alias("future"))
    stale = lambda references: references.join(claims, "value").select(F.concat("value", F.lit("@"), "file_id").alias("root_id"), "file_id", "location", F.col("value").alias("current"), "future")
    with Scratch(spark) as scratch:
        files = scratch.keep(_repository(spark, sf_dir), "files")
        references = scratch.keep(_parsed(files), "references")
        original = scratch.keep(stale(references), "stale")
        todo = original.join(files.where("kind <> 'python'").select("file_id"), "file_id")
        candidates = scratch.keep(_edited(files, todo), "candidates")
        after, again = planning.projected(files, references, candidates.where("error IS NULL"), _parsed)
        after, again = scratch.keep(after, "after"), scratch.keep(again, "again")
        same = planning.differing_rows(again, _parsed(after)).select(((F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)).alias("same_as_full"))
        states = changes.closed_roots(original, stale(again), todo).withColumn("current", F.split("root_id", "@")[0])
        counts = states.groupBy("current").agg(F.count_if(F.col("state") != "NEW").alias("n_stale"), F.count_if(F.col("state") == "CLOSED").alias("n_closed"), F.count_if(F.col("state").isin("UNCHANGED", "STILL_OPEN")).alias("n_open"), F.count_if(F.col("state") == "NEW").alias("n_new"))
        coherence = F.when(F.col("n_open") + F.col("n_new") == 0, "COHERENT").when(F.col("n_closed") == 0, "INCONSISTENT").otherwise("PARTIALLY_COHERENT")
        return scratch.result(counts.withColumn("coherence", coherence).join(F.broadcast(same)))
