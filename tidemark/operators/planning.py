"""Repair plans of many change requests at once: targets, repairability, actions, their order, and what a plan amounts to.

Every table has a ``plan_id``; plans are never gathered but for their order, and there only plans of at most ``MAX_ACTIONS`` actions.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import ids
from ..functions.store import dealt
from .repair import MAX_ACTIONS
from .requests import MANUAL_ROOTS, looked_up, repair_rules

# The order of file categories in a plan, and the kinds of references that name datasets.
CATEGORY_ORDER = {"SQL_MODEL": 10, "DBT_MODEL": 10, "DBT_SCHEMA": 20, "SCHEMA_CONTRACT": 20, "PIPELINE_CONFIG": 30, "PIPELINE_DAG": 30, "QUALITY_CONFIG": 40}
DATASET_KINDS = ["source_dataset", "target_dataset", "input_dataset", "output_dataset", "dataset", "relation", "model", "model_file", "contract_file"]
#: States in which a root's repair is planned.
REPAIRABLE = ("AUTO_REPAIRABLE", "CONDITIONALLY_REPAIRABLE")
STALE = "STALE_PIPELINE_OR_QUALITY_REFERENCE"


def stale_targets(roots: DataFrame, groups: DataFrame, files: DataFrame, references: DataFrame, rows: int = 0) -> DataFrame:
    """roots with current, future and n_futures of their group, path, category and dynamic of their file, and of the file's references to the current
    name how many there are (n_matches) and the first one's kind and location.

    roots: plan_id, root_id, root_type, group_id, file_id (null where not exactly one file is to blame); groups: group_id, current, futures;
    files: file_id, path, category, dynamic; references: file_id, kind, location, value.  Three equi-joins; references are counted by file and value
    before theirs.  Few references share a file and a value, so they are dealt by them as they are, with no partial sort; they and the roots go to as many
    tasks as ``rows`` (about how many there are of either) need, where the other side is hashed, so that roots are not sorted.
    """
    known = groups.select("group_id", "current", F.coalesce(F.size("futures"), F.lit(0)).alias("n_futures"), F.get("futures", F.lit(0)).alias("future"))
    seen = dealt(references.withColumnRenamed("value", "current"), rows, "file_id", "current").groupBy("file_id", "current").agg(F.count("*").alias("n_matches"), F.min(F.struct("location", "kind")).alias("_at"))
    own = dealt(roots, rows, "group_id").join(known.hint("shuffle_hash"), "group_id", "left").join(files.select("file_id", "path", "category", "dynamic"), "file_id", "left").join(seen.hint("shuffle_hash"), ["file_id", "current"], "left")
    return own.withColumns({"n_futures": F.coalesce("n_futures", F.lit(0)), "n_matches": F.coalesce("n_matches", F.lit(0)), "dynamic": F.coalesce("dynamic", F.lit(False)), "kind": F.col("_at.kind"), "location": F.col("_at.location")}).drop("_at")


def classified(targets: DataFrame) -> DataFrame:
    """targets with rule_id, state and basis: the ladder of conflict, dynamic target, semantic intent, stale reference, manual root, unsupported root."""
    prefix = F.when(F.col("kind").isin(DATASET_KINDS), "repair.stale-dataset.").otherwise("repair.stale-field.")
    rules = repair_rules(targets.sparkSession).where(F.array_contains("root_types", STALE)).select("rule_id", F.explode("categories").alias("category"))
    rules = rules.select("category", F.regexp_extract("rule_id", r"^repair\.stale-\w+\.", 0).alias("_prefix"), "rule_id").where("_prefix <> ''")
    single = rules.groupBy("category", "_prefix").agg(F.count("*").alias("_n"), F.min("rule_id").alias("rule_id")).where("_n = 1").drop("_n")
    own = targets.withColumn("_prefix", prefix).join(F.broadcast(single), ["category", "_prefix"], "left")
    stale, none = F.col("root_type") == STALE, F.lit(None).cast("string")
    ladder: list[tuple[Column, str, str]] = [
        ((F.col("root_type") == "CONFLICTING_FUTURE_FIELD_IDENTITIES") | (F.col("n_futures") > 1), "BLOCKED_BY_CONFLICT", "explicit-conflict"),
        (F.col("dynamic"), "UNSUPPORTED", "dynamic-reference"), (F.col("root_type") == "SEMANTIC_DEFINITION_CHANGED", "MANUAL_DECISION_REQUIRED", "semantic-intent"),
        (stale & ((F.col("n_futures") != 1) | F.col("current").isNull()), "BLOCKED_BY_MISSING_EVIDENCE", "missing-coherent-identity"),
        (stale & (F.col("path").isNull() | (F.col("n_matches") != 1) | F.col("rule_id").isNull()), "BLOCKED_BY_MISSING_EVIDENCE", "ambiguous-static-target"),
        (stale, "AUTO_REPAIRABLE", "one-target-one-rule"), (F.col("root_type").isin(MANUAL_ROOTS), "MANUAL_DECISION_REQUIRED", "change-source-or-intent"),
    ]
    pick = lambda i: reduce(lambda c, x: c.when(F.coalesce(x[0], F.lit(False)), x[i]), ladder, F.when(F.lit(False), "")).otherwise("UNSUPPORTED" if i == 1 else "root-type")
    out = own.withColumns({"state": pick(1), "basis": pick(2)})
    return out.withColumn("rule_id", F.when(F.col("state").isin(*REPAIRABLE), F.col("rule_id")).otherwise(none)).drop("_prefix")


def needed(roots: DataFrame) -> DataFrame:
    """The columns of classified roots that ``planned_actions`` and ``outcomes`` read; what only actions say is null where no repair is planned."""
    said = [F.when(F.col("state").isin(*REPAIRABLE), F.col(c)).alias(c) for c in ("root_id", "group_id", "file_id", "path", "category", "location", "current", "future", "rule_id")]
    return roots.select("plan_id", "state", *said)


def planned_actions(roots: DataFrame) -> DataFrame:
    """plan_id, action_id, root_id, group_id, file_id, path, category, location, current, future, rule_id, depends_on: an action for each root that can
    be repaired; within a group each waits for the one before it, by category, path, location and id."""
    own = roots.where(F.col("state").isin(*REPAIRABLE))
    own = own.withColumn("action_id", ids.stable_id("act", F.col("root_id"), F.col("rule_id"), F.col("path"), F.col("location"), F.col("current"), F.col("future")))
    rank = F.coalesce(looked_up({k: str(v) for k, v in CATEGORY_ORDER.items()}, F.col("category")).cast("int"), F.lit(99))
    before = F.lag("action_id").over(Window.partitionBy("plan_id", F.coalesce("group_id", "root_id")).orderBy(rank, "path", "location", "action_id"))
    return own.select("plan_id", "action_id", "root_id", "group_id", "file_id", "path", "category", "location", "current", "future", "rule_id", F.array_compact(F.array(before)).alias("depends_on"))


def kahn(actions: list[tuple[str, list[str]]]) -> tuple[str, list[str]]:
    """(state, ids in order): ready ids first in, first out, from a sorted start, those freed by one id in order; linear in actions and dependencies."""
    waits = {a: set(deps) for a, deps in actions}
    if any(d not in waits for deps in waits.values() for d in deps):
        return "UNKNOWN_DEPENDENCY", []
    frees: dict[str, list[str]] = {}
    for a, deps in waits.items():
        for d in deps:
            frees.setdefault(d, []).append(a)
    left = {a: len(deps) for a, deps in waits.items()}
    ready, out = deque(sorted(a for a, n in left.items() if not n)), []
    while ready:
        a = ready.popleft()
        out.append(a)
        for b in sorted(frees.get(a, [])):
            left[b] -= 1
            if not left[b]:
                ready.append(b)
    return ("ORDERED", out) if len(out) == len(waits) else ("CYCLE", [])


def topological_orders(actions: DataFrame, most: int = MAX_ACTIONS) -> DataFrame:
    """plan_id, action_id, position (from 1; null where the plan has no order), state: ORDERED, CYCLE, UNKNOWN_DEPENDENCY, or TOO_MANY_ACTIONS, whose
    actions are not gathered.

    One exchange by plan; sorted partitions are read group by group, so a task holds one plan of ``most`` actions at a time.
    """
    sizes = actions.groupBy("plan_id").agg(F.count("*").alias("_n"))
    kinds = dict(actions.dtypes)
    sized = actions.select("plan_id", "action_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")).join(sizes, "plan_id")
    over = sized.where(F.col("_n") > most).select("plan_id", "action_id", F.lit(None).cast("int").alias("position"), F.lit("TOO_MANY_ACTIONS").alias("state"))
    schema = f"plan_id {kinds['plan_id']}, action_id string, position int, state string"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def order(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for plan, own in groupby(rows, key=lambda r: r[0]):
            todo = [(a, deps) for _, a, deps in own]
            state, found = kahn(todo)
            out += [(plan, a, i + 1, state) for i, a in enumerate(found)] or [(plan, a, None, state) for a, _ in todo]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    within = sized.where(F.col("_n") <= most).select("plan_id", "action_id", "depends_on").repartition("plan_id").sortWithinPartitions("plan_id", "action_id")
    return within.mapInArrow(order, schema).unionByName(over)


def outcomes(roots: DataFrame, orders: DataFrame) -> DataFrame:
    """plan_id, n_roots, n_actions, n_manual, n_blocked, completeness, disposition of each plan; one whose actions have no order is INVALID.

    roots: ``classified``; orders: ``topological_orders``.
    """
    can = F.col("state").isin(*REPAIRABLE)
    by_plan = roots.groupBy("plan_id").agg(
        F.count("*").alias("n_roots"), F.count_if(~can).alias("_others"), F.count_if(F.col("state") == "MANUAL_DECISION_REQUIRED").alias("n_manual"),
        F.count_if(F.col("state").isin("BLOCKED_BY_CONFLICT", "BLOCKED_BY_MISSING_EVIDENCE", "UNSUPPORTED")).alias("n_blocked"), F.bool_or(F.col("state") == "BLOCKED_BY_CONFLICT").alias("_conflict"),
    )
    done = orders.groupBy("plan_id").agg(F.count("*").alias("n_actions"), F.bool_or(F.col("state") != "ORDERED").alias("_invalid"))
    own = by_plan.join(done, "plan_id", "left").withColumns({"n_actions": F.coalesce("n_actions", F.lit(0)), "_invalid": F.coalesce("_invalid", F.lit(False))})
    whole = F.when(F.col("n_actions") == 0, "NO_SUPPORTED_REPAIR").when(F.col("_others") == 0, "FULLY_ADDRESSED_SELECTED_ROOTS").otherwise("PARTIALLY_ADDRESSED_SELECTED_ROOTS")
    disposition = F.when(F.col("_conflict") & (F.col("n_actions") == 0), "REPAIR_BLOCKED_BY_CONFLICT").when(F.col("n_actions") == 0, "NO_SUPPORTED_AUTOMATIC_REPAIR").when(F.col("_others") > 0, "PARTIAL_REPAIR_CANDIDATE").otherwise("REPAIR_CANDIDATE_READY_FOR_REVIEW")
    invalid = lambda c: F.when(F.col("_invalid"), "INVALID_PLAN").otherwise(c)
    return own.select("plan_id", "n_roots", "n_actions", "n_manual", "n_blocked", invalid(whole).alias("completeness"), invalid(disposition).alias("disposition"))


def other_references(claims: DataFrame, contributing: DataFrame, references: DataFrame, rows: int = 0) -> DataFrame:
    """claim_id, file_id, kind, location: references to a claimed name in files that do not contribute to the claim.

    claims: claim_id, current; contributing: claim_id, file_id.  The anti join is by claim and file, so no list of files is gathered; ``rows``, about
    how many references there are, says over how many tasks both joins are dealt.
    """
    found = dealt(references, rows, "value").join(claims.select("claim_id", F.col("current").alias("value")), "value").select("claim_id", "file_id", "kind", "location")
    return dealt(found, rows, "claim_id", "file_id").join(contributing.select("claim_id", "file_id").distinct(), ["claim_id", "file_id"], "left_anti")


def projected(files: DataFrame, references: DataFrame, candidates: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """The files and their references after a repair: only what a candidate replaces is parsed again.

    files: file_id, content and others; references: file_id and others, as ``parse(files)`` gave them; candidates: file_id, candidate (its new content).
    """
    new = candidates.select("file_id", "candidate")
    touched = files.join(new, "file_id").withColumn("content", F.col("candidate")).drop("candidate")
    after = files.join(new.select("file_id"), "file_id", "left_anti").unionByName(touched)
    again = references.join(new.select("file_id"), "file_id", "left_anti").unionByName(parse(touched).select(*references.columns))
    return after, again


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_only_a, n_only_b: rows, with repeats, that one of two tables has beyond the other; counted by row, so nothing is gathered."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_d")).unionByName(b.select(*cols, F.lit(-1).alias("_d"))).groupBy(*cols).agg(F.sum("_d").alias("_d"))
    return both.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("n_only_a"), F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("n_only_b"))
