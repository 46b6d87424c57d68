"""Rule tables as data, and the operators that choose among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Precedence, conditions and results of the rules; an empty condition admits all.
BREADTH = [(10, 10, 10, 10, "WIDESPREAD"), (20, 2, 0, 1, "BROAD"), (21, 1, 3, 3, "BROAD"), (30, 1, 0, 1, "LIMITED"), (40, 0, 0, 0, "LOCAL")]
SEVERITY = [
    (10, ["NO_DEMONSTRATED"], [], [], "UNDETERMINED"),
    (20, ["CONFIRMED"], ["EXPLICIT"], ["BROAD", "WIDESPREAD"], "CRITICAL"),
    (21, ["CONFIRMED"], ["EXPLICIT"], ["LOCAL", "LIMITED"], "HIGH"),
    (22, ["CONFIRMED"], ["ELEVATED"], [], "HIGH"),
    (23, ["CONFIRMED"], ["STANDARD", "UNKNOWN"], [], "MODERATE"),
    (30, ["UNRESOLVED", "POTENTIAL"], ["EXPLICIT"], [], "HIGH"),
    (31, ["UNRESOLVED", "POTENTIAL"], ["ELEVATED"], ["BROAD", "WIDESPREAD"], "HIGH"),
    (32, ["UNRESOLVED", "POTENTIAL"], ["ELEVATED"], ["LOCAL", "LIMITED"], "MODERATE"),
    (33, ["UNRESOLVED", "POTENTIAL"], ["STANDARD", "UNKNOWN"], ["BROAD", "WIDESPREAD"], "MODERATE"),
    (34, ["UNRESOLVED", "POTENTIAL"], ["STANDARD"], ["LOCAL", "LIMITED"], "LOW"),
    (35, ["UNRESOLVED", "POTENTIAL"], ["UNKNOWN"], ["LOCAL", "LIMITED"], "UNDETERMINED"),
]
DECISION = [
    (10, ["CONFIRMED"], ["ESTABLISHED"], ["HIGH", "CRITICAL"], [], False, "BLOCK", "HIGH_CONFIDENCE"),
    (20, ["UNRESOLVED"], ["UNRESOLVED"], ["HIGH", "CRITICAL"], ["BROAD", "WIDESPREAD"], False, "HOLD", "HIGH_CONFIDENCE"),
    (30, ["POTENTIAL"], ["CONDITIONAL"], ["LOW", "MODERATE"], [], True, "PROCEED_WITH_CONDITIONS", "SUPPORTED"),
    (40, ["NO_DEMONSTRATED"], ["ESTABLISHED"], [], [], False, "PROCEED", "HIGH_CONFIDENCE"),
]
WIDENINGS = [("SMALLINT", "INTEGER"), ("INTEGER", "BIGINT"), ("REAL", "DOUBLE PRECISION"), ("FLOAT", "DOUBLE PRECISION")]
EXPLICIT_CRITICALITY = [("business.criticality", "critical"), ("business.criticality", "mission_critical"), ("business.criticality", "tier_1"), ("business.importanceTier", "tier_1")]
IMPACT_OF = {"INCOMPATIBLE": ("CONFIRMED", "ESTABLISHED"), "CONDITIONAL": ("POTENTIAL", "CONDITIONAL"), "UNKNOWN": ("UNRESOLVED", "UNRESOLVED"), "COMPATIBLE": ("NO_DEMONSTRATED", "ESTABLISHED")}
RANKED = {"compatibility": ["INCOMPATIBLE", "UNKNOWN", "CONDITIONAL", "COMPATIBLE"], "impact": ["CONFIRMED", "UNRESOLVED", "POTENTIAL", "NO_DEMONSTRATED"], "certainty": ["UNRESOLVED", "CONDITIONAL", "ESTABLISHED"]}


def breadth_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BREADTH, "precedence int, min_datasets int, min_consumers int, min_assets int, breadth string")


def severity_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITY, "precedence int, technicals array<string>, criticalities array<string>, breadths array<string>, severity string")


def decision_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECISION, "precedence int, technicals array<string>, certainties array<string>, severities array<string>, breadths array<string>, needs_conditions boolean, disposition string, confidence string")


def admits(allowed: str, value: Column) -> Column:
    return (F.size(allowed) == 0) | F.array_contains(F.col(allowed), value)


def choose(subjects: DataFrame, rules: DataFrame, matches: Column, key: str, result: list[str]) -> DataFrame:
    """Subjects with the columns of their matching rule of least precedence; ``no_matching_rule`` or ``tied_rules`` in rule_state where there
    is none or two.  Rules are a constant table, so they go by broadcast."""
    own, row = subjects.columns, "_row"
    # Rows are numbered, so that two subjects alike in every column stay two.
    found = subjects.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(rules), matches, "left")
    best = found.groupBy(row, *own).agg(F.min("precedence").alias("rule"), F.min(F.struct("precedence", *result)).alias("_m"), F.sort_array(F.collect_list("precedence")).alias("_all"))
    tied = (F.size("_all") > 1) & (F.get("_all", F.lit(0)) == F.get("_all", F.lit(1)))
    state = F.when(F.col("rule").isNull(), "no_matching_rule").when(tied, "tied_rules").otherwise("matched")
    return best.select(*own, "rule", *[F.col(f"_m.{r}").alias(r) for r in result], state.alias("rule_state"))


def derive_breadth(subjects: DataFrame, key: str, rules: DataFrame | None = None) -> DataFrame:
    """Needs supporting_datasets, consumer_assets, context_assets."""
    rules = rules if rules is not None else breadth_rules(subjects.sparkSession)
    fits = (F.col("supporting_datasets") >= F.col("min_datasets")) & (F.col("consumer_assets") >= F.col("min_consumers")) & (F.col("context_assets") >= F.col("min_assets"))
    return choose(subjects, rules, fits, key, ["breadth"])


def derive_severity(subjects: DataFrame, key: str, rules: DataFrame | None = None) -> DataFrame:
    """Needs technical, criticality, breadth."""
    rules = rules if rules is not None else severity_rules(subjects.sparkSession)
    rules = rules.withColumnRenamed("severity", "_severity")
    fits = admits("technicals", F.col("technical")) & admits("criticalities", F.col("criticality")) & admits("breadths", F.col("breadth"))
    return choose(subjects, rules, fits, key, ["_severity"]).withColumnRenamed("_severity", "severity")


def derive_decision(subjects: DataFrame, key: str, rules: DataFrame | None = None) -> DataFrame:
    """Needs technical, certainty, severity, breadth, has_conditions."""
    rules = rules if rules is not None else decision_rules(subjects.sparkSession)
    fits = admits("technicals", F.col("technical")) & admits("certainties", F.col("certainty")) & admits("severities", F.col("severity")) & admits("breadths", F.col("breadth")) & (~F.col("needs_conditions") | F.col("has_conditions"))
    return choose(subjects, rules, fits, key, ["disposition", "confidence"])


def criticality(explicit: Column, categories: Column) -> Column:
    """Explicit designation, no context, business intelligence with something else, or plain context."""
    return F.when(explicit, "EXPLICIT").when(F.coalesce(F.size(categories), F.lit(0)) == 0, "UNKNOWN").when(F.array_contains(categories, "bi") & (F.size(categories) >= 2), "ELEVATED").otherwise("STANDARD")


def explicitly_critical(prop: Column, value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.coalesce(reduce(lambda a, b: a | b, [(prop == p) & (v == x) for p, x in EXPLICIT_CRITICALITY]), F.lit(False))


def edge_compatibility(behaviour: Column, upstream_changed: Column, endpoints_kept: Column) -> tuple[Column, Column]:
    """State and evidence strength of an edge under a rename."""
    state = F.when(behaviour == "accepts", "COMPATIBLE").when(behaviour == "rejects", "INCOMPATIBLE").when(behaviour == "conditional", "CONDITIONAL").when(upstream_changed, "UNKNOWN").when(endpoints_kept, "CONDITIONAL").otherwise("UNKNOWN")
    strength = F.when(behaviour.isin("accepts", "rejects", "conditional"), "EXPLICIT").when(upstream_changed, "INSUFFICIENT").when(endpoints_kept, "DERIVED").otherwise("INSUFFICIENT")
    return state, strength


def structural_compatibility(operation: Column, dependants: Column, native: Column, proposed: Column, same_family: Column) -> Column:
    widening = reduce(lambda a, b: a | b, [(F.upper(native) == a) & (F.upper(proposed) == b) for a, b in WIDENINGS])
    return F.when(dependants == 0, "COMPATIBLE").when(operation == "FIELD_RENAME", "UNKNOWN").when(operation == "FIELD_DELETE", "INCOMPATIBLE").when((operation == "FIELD_TYPE_CHANGE") & same_family & F.coalesce(widening, F.lit(False)), "CONDITIONAL").otherwise("UNKNOWN")


def technical_impact(compatibility: Column) -> tuple[Column, Column]:
    pick = lambda i: reduce(lambda c, kv: c.when(compatibility == kv[0], kv[1][i]), IMPACT_OF.items(), F.when(F.lit(False), ""))
    return pick(0), pick(1)


def worst(kind: str, state: Column) -> Column:
    """An aggregate: the state that ranks first."""
    order = RANKED[kind]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), state)
    return F.element_at(F.array(*[F.lit(x) for x in order]), F.min(F.when(rank > 0, rank)).cast("int"))


def single_or_unknown(state: Column) -> Column:
    """An aggregate: the state if all agree, else UNKNOWN."""
    return F.when(F.count_distinct(state) > 1, "UNKNOWN").otherwise(F.min(state))


def simple_breadth(datasets: Column) -> Column:
    return F.when(datasets == 0, "LOCAL").when(datasets <= 2, "LIMITED").when(datasets <= 10, "BROAD").otherwise("WIDESPREAD")


def structural_severity(technical: Column, breadth: Column) -> Column:
    return F.when(technical == "NO_DEMONSTRATED", "LOW").when(technical == "CONFIRMED", "HIGH").when(breadth.isin("BROAD", "WIDESPREAD"), "HIGH").otherwise("MODERATE")


def semantic_severity(changed: Column, datasets: Column) -> Column:
    return F.when(~changed, "LOW").when(datasets == 0, "MODERATE").when(simple_breadth(datasets).isin("BROAD", "WIDESPREAD"), "HIGH").otherwise("MODERATE")


def semantic_decision(deltas: Column, reached: Column) -> Column:
    return F.when(deltas == 0, "proceed").when(reached == 0, "proceed_with_conditions").otherwise("hold_for_review")


def change_request_severity(conflicts: Column, material: Column, reached: Column) -> Column:
    return F.when(conflicts > 0, "HIGH").when((material > 0) & (reached > 0), "HIGH").when(material > 0, "MODERATE").otherwise("LOW")


def change_request_decision(material: Column, conflicts: Column) -> Column:
    return F.when(material == 0, "no_material_change").when(conflicts > 0, "block_confirmed_incompatibility").otherwise("hold_for_review")


def coherence(inconsistent: Column, partial: Column, coherent: Column) -> Column:
    return F.when(inconsistent, "INCONSISTENT").when(partial, "PARTIALLY_COHERENT").when(coherent, "COHERENT").otherwise("UNRESOLVED")


def top_of_each(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)
