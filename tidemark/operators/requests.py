"""Change requests of many files: material deltas, root causes, groups, compatibility dimensions, consequences, and what can be repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the classes of deltas mean as root causes, as change sets, and as consequences.
MATERIAL = {
    "StructuralFieldDelta": "STRUCTURAL_CHANGE", "SemanticSqlDelta": "SEMANTIC_DEFINITION_CHANGED", "ModelContractDelta": "CONTRACT_CHANGE", "QualityExpectationDelta": "QUALITY_EXPECTATION_CHANGED",
    "PipelineTaskDelta": "PIPELINE_TASK_CHANGED", "PipelineDependencyDelta": "PIPELINE_DEPENDENCY_CHANGED", "DatasetReferenceDelta": "DATASET_REFERENCE_CHANGED", "FieldReferenceDelta": "FIELD_REFERENCE_CHANGED", "ConfigurationDelta": "CONFIGURATION_CHANGED",
}
CHANGE_SETS = {
    "structural": ["StructuralFieldDelta"], "semantic": ["SemanticSqlDelta"],
    "pipeline": ["PipelineTaskDelta", "PipelineDependencyDelta", "DatasetReferenceDelta", "FieldReferenceDelta", "ConfigurationDelta"],
    "contract_quality": ["ModelContractDelta", "QualityExpectationDelta", "DocumentationOnlyDelta", "UnsupportedFileDelta"],
}
CONSEQUENCES = {
    "SEMANTIC_DEFINITION_CHANGED": "SEMANTIC_DEFINITION_CHANGED", "STALE_PIPELINE_OR_QUALITY_REFERENCE": "STALE_PIPELINE_REFERENCE", "CONFLICTING_FUTURE_FIELD_IDENTITIES": "CONTRACT_MISMATCH",
    "CONTRACT_CHANGE": "CONTRACT_MISMATCH", "QUALITY_EXPECTATION_CHANGED": "QUALITY_CHECK_STALE", "STRUCTURAL_CHANGE": "UNRESOLVED_RENAME_ADAPTATION",
}
#: Delta types, rule, certainty and reason of semantic compatibility; the result is unknown for all but no change.
SEMANTIC = [
    (["NO_SEMANTIC_CHANGE"], "semantic-compatible-no-delta", "SEMANTICALLY_COMPATIBLE", "ESTABLISHED", "NO_SEMANTIC_CHANGE"),
    (["AGGREGATION_CHANGE"], "semantic-aggregation-definition-unresolved", "SEMANTIC_COMPATIBILITY_UNKNOWN", "UNRESOLVED", "AGGREGATION_DEFINITION_CHANGED_WITHOUT_APPROVAL"),
    (["FILTER_CHANGE"], "semantic-filter-population-unresolved", "SEMANTIC_COMPATIBILITY_UNKNOWN", "UNRESOLVED", "ROW_SET_DEFINITION_CHANGED_WITHOUT_CONTRACT"),
    (["JOIN_TYPE_CHANGE", "JOIN_PREDICATE_CHANGE", "JOINED_RELATION_CHANGE"], "semantic-join-behavior-unresolved", "SEMANTIC_COMPATIBILITY_UNKNOWN", "UNRESOLVED", "JOIN_BEHAVIOR_CHANGED_WITHOUT_EXECUTION_EVIDENCE"),
    (["DERIVED_EXPRESSION_CHANGE"], "semantic-derived-definition-unresolved", "SEMANTIC_COMPATIBILITY_UNKNOWN", "UNRESOLVED", "DERIVED_DEFINITION_CHANGED_WITHOUT_APPROVAL"),
]
#: Repair rules: id, root types, file categories.
REPAIR = [
    ("repair.stale-field.dag-static.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "FIELD_REFERENCE_CHANGED"], ["PIPELINE_DAG"]),
    ("repair.stale-field.quality-config.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "QUALITY_EXPECTATION_CHANGED"], ["QUALITY_CONFIG"]),
    ("repair.stale-field.pipeline-config.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "FIELD_REFERENCE_CHANGED", "CONFIGURATION_CHANGED"], ["PIPELINE_CONFIG"]),
    ("repair.stale-dataset.static-reference.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "DATASET_REFERENCE_CHANGED", "CONFIGURATION_CHANGED"], ["PIPELINE_DAG", "PIPELINE_CONFIG", "QUALITY_CONFIG"]),
    ("repair.schema.column-name.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "CONTRACT_CHANGE", "STRUCTURAL_CHANGE"], ["DBT_SCHEMA"]),
    ("repair.contract.field.v1", ["STALE_PIPELINE_OR_QUALITY_REFERENCE", "CONTRACT_CHANGE", "STRUCTURAL_CHANGE"], ["SCHEMA_CONTRACT"]),
    ("repair.sql.identifier.v1", ["FIELD_REFERENCE_CHANGED", "DATASET_REFERENCE_CHANGED", "STRUCTURAL_CHANGE"], ["SQL_MODEL"]),
    ("repair.dbt.static-model-reference.v1", ["DATASET_REFERENCE_CHANGED", "CONFIGURATION_CHANGED", "STRUCTURAL_CHANGE"], ["DBT_MODEL", "PIPELINE_DAG", "PIPELINE_CONFIG"]),
    ("repair.delete.structured-stale-reference.v1", ["STRUCTURAL_CHANGE", "QUALITY_EXPECTATION_CHANGED", "CONFIGURATION_CHANGED"], ["QUALITY_CONFIG", "PIPELINE_CONFIG", "SCHEMA_CONTRACT", "DBT_SCHEMA"]),
    ("repair.type.declaration-alignment.v1", ["CONTRACT_CHANGE", "STRUCTURAL_CHANGE"], ["DBT_SCHEMA", "SCHEMA_CONTRACT", "QUALITY_CONFIG", "PIPELINE_CONFIG"]),
]
MANUAL_ROOTS = ["STRUCTURAL_CHANGE", "CONTRACT_CHANGE", "QUALITY_EXPECTATION_CHANGED", "FIELD_REFERENCE_CHANGED", "DATASET_REFERENCE_CHANGED", "CONFIGURATION_CHANGED", "PIPELINE_TASK_CHANGED", "PIPELINE_DEPENDENCY_CHANGED"]
SIGNIFICANCE = {"owner": "ACCOUNTABILITY", "domain": "ORGANIZATIONAL_GROUPING", "tag": "CLASSIFICATION", "glossary": "BUSINESS_SEMANTICS", "structured_property": "CONFIGURED_METADATA", "data_product": "PRODUCT_GROUPING", "document": "DOCUMENTATION_CONTEXT", "pipeline": "OPERATIONAL_DEPENDENCY_CONTEXT", "bi": "CONSUMER_FACING_CONTEXT"}


def looked_up(values: dict[str, str], key: Column, otherwise: Column | None = None) -> Column:
    """A constant table's value for the key."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def change_set(delta_class: Column) -> Column:
    return reduce(lambda c, kv: c.when(delta_class.isin(kv[1]), kv[0]), CHANGE_SETS.items(), F.when(F.lit(False), ""))


def root_causes(deltas: DataFrame, findings: DataFrame, conflicts: DataFrame) -> DataFrame:
    """root_id, root_type, file, state: of every material delta of a known class, every stale finding and every file of a conflict.

    deltas: delta_id, delta_class, material, file; findings: finding_id, file; conflicts: conflict_id, file (a row for each).
    """
    kind = looked_up(MATERIAL, F.col("delta_class"))
    own = deltas.where("material").select(F.concat(F.lit("root:"), "delta_id").alias("root_id"), kind.alias("root_type"), "file", F.lit("UNRESOLVED").alias("state")).where("root_type is not null")
    stale = findings.select(F.concat(F.lit("root:"), "finding_id"), F.lit("STALE_PIPELINE_OR_QUALITY_REFERENCE"), "file", F.lit("REPOSITORY_INCONSISTENT"))
    clash = conflicts.select(F.concat(F.lit("root:"), "conflict_id"), F.lit("CONFLICTING_FUTURE_FIELD_IDENTITIES"), "file", F.lit("CONFIRMED_CONFLICT"))
    return own.union(stale).union(clash)


def consequence(root_type: Column, state: Column) -> tuple[Column, Column]:
    """Technical consequence of a request's root and its certainty."""
    return looked_up(CONSEQUENCES, root_type, root_type), F.when(state.contains("CONFLICT") | state.contains("INCONSISTENT"), "CONFIRMED_REPOSITORY_STATE").otherwise("UNRESOLVED_RUNTIME_EFFECT")


def semantic_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEMANTIC, "types array<string>, rule_id string, result string, certainty string, reason_code string")


def semantic_compatibility(deltas: DataFrame) -> DataFrame:
    """Deltas with the rule of their type; a type that no rule names has none.  The rules are a constant table."""
    return deltas.join(F.broadcast(semantic_rules(deltas.sparkSession).select(F.explode("types").alias("delta_type"), "rule_id", "result", "certainty", "reason_code")), "delta_type", "left")


def semantic_consequence(types: Column, n_structural: Column) -> tuple[Column, Column]:
    """Consequence and certainty from the set of semantic delta types of a model and its number of structural deltas."""
    joins = F.array(*[F.lit(t) for t in ("JOIN_TYPE_CHANGE", "JOIN_PREDICATE_CHANGE", "JOINED_RELATION_CHANGE")])
    none = F.size(types) == 0
    state = F.when(none & (n_structural == 0), "NO_DEMONSTRATED_MATERIAL_IMPACT").when(none, "UNRESOLVED_SEMANTIC_IMPACT").when(types == F.array(F.lit("FILTER_CHANGE")), "ROW_SET_SEMANTICS_CHANGED").when(F.arrays_overlap(types, joins), "JOIN_SEMANTICS_CHANGED").otherwise("SEMANTIC_DEFINITION_CHANGED")
    return state, F.when(none & (n_structural == 0), "ESTABLISHED").otherwise("UNRESOLVED")


def repair_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIR, "rule_id string, root_types array<string>, categories array<string>")


def rules_for(targets: DataFrame) -> DataFrame:
    """targets (root_type, category and others) with the ids of the repair rules that fit, in order; none, one or several."""
    flat = repair_rules(targets.sparkSession).select("rule_id", F.explode("root_types").alias("root_type"), "categories").select("rule_id", "root_type", F.explode("categories").alias("category"))
    known = flat.groupBy("root_type", "category").agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))
    return targets.join(F.broadcast(known), ["root_type", "category"], "left").withColumn("rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>")))


def repairability(root_type: Column, n_futures: Column, dynamic: Column, n_matches: Column, n_rules: Column) -> tuple[Column, Column]:
    """State and basis of a root: conflict, dynamic target, semantic intent, stale reference with one target and one rule, manual, unsupported."""
    stale = root_type == "STALE_PIPELINE_OR_QUALITY_REFERENCE"
    ladder = [
        ((root_type == "CONFLICTING_FUTURE_FIELD_IDENTITIES") | (n_futures > 1), "BLOCKED_BY_CONFLICT", "explicit-conflict"),
        (dynamic, "UNSUPPORTED", "dynamic-reference"), (root_type == "SEMANTIC_DEFINITION_CHANGED", "MANUAL_DECISION_REQUIRED", "semantic-intent"),
        (stale & (n_matches == 1) & (n_rules == 1), "AUTO_REPAIRABLE", "one-target-one-rule"), (stale & (n_matches != 1), "MANUAL_DECISION_REQUIRED", "target-not-unique"), (stale, "UNSUPPORTED", "no-single-rule"),
        (root_type.isin(MANUAL_ROOTS), "MANUAL_DECISION_REQUIRED", "change-source-or-intent"),
    ]
    pick = lambda i: reduce(lambda c, x: c.when(x[0], x[i]), ladder, F.when(F.lit(False), "")).otherwise("UNSUPPORTED" if i == 1 else "root-type")
    return pick(1), pick(2)


def severity_reasons(technical: Column, criticality: Column, breadth: Column, certainty: Column) -> Column:
    """Reasons in a stated order; what does not hold leaves no gap."""
    return F.array_compact(F.array(
        F.when(technical == "CONFIRMED", "CONFIRMED_TECHNICAL_FAILURE").when(technical == "UNRESOLVED", "UNRESOLVED_TECHNICAL_BOUNDARY").when(technical == "POTENTIAL", "POTENTIAL_DOWNSTREAM_CONSEQUENCE").otherwise("NO_DEMONSTRATED_TECHNICAL_IMPACT"),
        F.when(criticality == "EXPLICIT", "EXPLICIT_CRITICAL_ASSET").otherwise("CRITICALITY_NOT_EXPLICIT"),
        F.when(breadth.isin("BROAD", "WIDESPREAD"), "BROAD_CONSUMER_REACH").otherwise("LIMITED_CONSUMER_REACH"),
        F.when(certainty == "UNRESOLVED", "CERTAINTY_UNRESOLVED").when(certainty == "CONDITIONAL", "CERTAINTY_CONDITIONAL"),
    ))


def diffed(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change: ADDED, REMOVED or CHANGED entries between two keyed tables; equal ones leave no row."""
    a, b = before.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), after.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_in_a").isNull(), "ADDED").when(F.col("_in_b").isNull(), "REMOVED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED").alias("change")).where("change is not null")


def roots_of_groups(roots: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, n_roots: roots that share the group's id or one of its files; both have a row for each file (null: none), so nothing is gathered and
    the overlap is an equi-join.

    roots: root_id, group_id, file; groups: group_id, file.
    """
    every = groups.select("group_id").distinct()
    same = roots.select("root_id", "group_id").distinct().join(every, "group_id").select("group_id", "root_id")
    shared = roots.select("root_id", "file").join(groups.select("group_id", "file").distinct(), "file").select("group_id", "root_id")
    found = shared.unionByName(same).distinct().groupBy("group_id").agg(F.count("*").alias("n_roots"))
    return every.join(found, "group_id", "left").select("group_id", F.coalesce("n_roots", F.lit(0)).alias("n_roots"))


def selected(roots: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted id with the roots it selects; one that selects none is UNKNOWN.  wanted: id."""
    n = roots.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return wanted.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_roots"), F.when(F.col("n").isNull(), "UNKNOWN").otherwise("SELECTED").alias("state"))
