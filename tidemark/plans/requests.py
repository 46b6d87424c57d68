"""Queries of change requests, their decisions and repairs, with their SQL: orders as deltas, customers as files, nations as fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch
from ..operators import requests, rules
from ..sources import files as repository
from ..sources import registry as reg
from .catalog import _FACTS, _SUBJECTS, MAPPINGS, _mappings, j08_all, query

_CLASS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'StructuralFieldDelta' WHEN '2-HIGH' THEN 'SemanticSqlDelta' WHEN '3-MEDIUM' THEN 'ModelContractDelta' WHEN '4-NOT SPECIFIED' THEN 'PipelineTaskDelta' ELSE 'DocumentationOnlyDelta' END"
_TYPE = "CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'OUTPUT_COLUMN_RENAME' WHEN 'O' THEN 'OUTPUT_COLUMN_REMOVED' ELSE 'OUTPUT_COLUMN_ADDED' END WHEN o_orderpriority = '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'FILTER_CHANGE' WHEN 'O' THEN 'JOIN_TYPE_CHANGE' ELSE 'AGGREGATION_CHANGE' END ELSE 'CHANGED' END"
DELTAS = f"""deltas AS (SELECT 'd' || o_orderkey AS delta_id, 'file_' || o_custkey AS file, {_CLASS} AS delta_class, {_TYPE} AS delta_type, o_orderpriority <> '5-LOW' AS material, 'field_' || c_nationkey AS subject, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey),
stale AS (SELECT DISTINCT 'f' || l_suppkey || '/' || l_returnflag AS finding_id, 'file_' || l_suppkey AS file FROM lineitem),
conflict AS (SELECT 'c' || c_nationkey AS conflict_id, list_sort(list(DISTINCT 'file_' || c_custkey)) AS files FROM customer GROUP BY c_nationkey),
roots AS (SELECT 'root:' || delta_id AS root_id, CASE delta_class WHEN 'StructuralFieldDelta' THEN 'STRUCTURAL_CHANGE' WHEN 'SemanticSqlDelta' THEN 'SEMANTIC_DEFINITION_CHANGED' WHEN 'ModelContractDelta' THEN 'CONTRACT_CHANGE' WHEN 'PipelineTaskDelta' THEN 'PIPELINE_TASK_CHANGED' END AS root_type, file, 'UNRESOLVED' AS state FROM deltas WHERE material
  UNION ALL SELECT 'root:' || finding_id, 'STALE_PIPELINE_OR_QUALITY_REFERENCE', file, 'REPOSITORY_INCONSISTENT' FROM stale
  UNION ALL SELECT 'root:' || conflict_id, 'CONFLICTING_FUTURE_FIELD_IDENTITIES', unnest(files), 'CONFIRMED_CONFLICT' FROM conflict)"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = reg.table(spark, sf_dir, "orders"), reg.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = F.when(p == "1-URGENT", "StructuralFieldDelta").when(p == "2-HIGH", "SemanticSqlDelta").when(p == "3-MEDIUM", "ModelContractDelta").when(p == "4-NOT SPECIFIED", "PipelineTaskDelta").otherwise("DocumentationOnlyDelta")
    structural = F.when(s == "F", "OUTPUT_COLUMN_RENAME").when(s == "O", "OUTPUT_COLUMN_REMOVED").otherwise("OUTPUT_COLUMN_ADDED")
    semantic = F.when(s == "F", "FILTER_CHANGE").when(s == "O", "JOIN_TYPE_CHANGE").otherwise("AGGREGATION_CHANGE")
    own = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    return own.select(text("d", "o_orderkey").alias("delta_id"), text("file_", "o_custkey").alias("file"), kind.alias("delta_class"), F.when(p == "1-URGENT", structural).when(p == "2-HIGH", semantic).otherwise("CHANGED").alias("delta_type"), (p != "5-LOW").alias("material"), text("field_", "c_nationkey").alias("subject"), s.alias("status"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    stale = reg.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct().select(F.concat(text("f", "l_suppkey"), F.lit("/"), F.col("l_returnflag")).alias("finding_id"), text("file_", "l_suppkey").alias("file"))
    clash = reg.table(spark, sf_dir, "customer").select(text("c", "c_nationkey").alias("conflict_id"), text("file_", "c_custkey").alias("file")).distinct()
    return requests.root_causes(_deltas(spark, sf_dir), stale, clash)


@query(f"WITH {DELTAS} SELECT root_id, root_type, file, state FROM roots")
def j19_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root causes from material deltas, stale references and conflicts."""
    return _roots(spark, sf_dir)


@query(f"""WITH {DELTAS} SELECT CASE root_type WHEN 'STALE_PIPELINE_OR_QUALITY_REFERENCE' THEN 'STALE_PIPELINE_REFERENCE' WHEN 'CONFLICTING_FUTURE_FIELD_IDENTITIES' THEN 'CONTRACT_MISMATCH' WHEN 'CONTRACT_CHANGE' THEN 'CONTRACT_MISMATCH' WHEN 'STRUCTURAL_CHANGE' THEN 'UNRESOLVED_RENAME_ADAPTATION' ELSE root_type END AS consequence,
CASE WHEN state IN ('CONFIRMED_CONFLICT', 'REPOSITORY_INCONSISTENT') THEN 'CONFIRMED_REPOSITORY_STATE' ELSE 'UNRESOLVED_RUNTIME_EFFECT' END AS certainty, count(*) AS n FROM roots GROUP BY 1, 2""")
def j18_request_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, certainty = requests.consequence(F.col("root_type"), F.col("state"))
    return _roots(spark, sf_dir).groupBy(kind.alias("consequence"), certainty.alias("certainty")).agg(F.count("*").alias("n"))


@query(f"WITH {DELTAS} SELECT file, array_to_string(list_sort(list(DISTINCT root_type)), ',') AS root_types, count(*) AS n_roots FROM roots GROUP BY 1")
def m08_file_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file contributes to the request."""
    return _roots(spark, sf_dir).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("root_type")), ",").alias("root_types"), F.count("*").alias("n_roots"))


@query(f"WITH {DELTAS} SELECT file, delta_class, array_to_string(list_sort(list(DISTINCT subject)), ',') AS subjects, count(*) AS n_deltas FROM deltas WHERE material AND subject NOT IN (SELECT 'field_' || n_nationkey FROM nation WHERE n_regionkey <> 0) GROUP BY 1, 2")
def m03_ungrouped_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material deltas of fields that no group claims (those of the first region), by file and class."""
    claimed = reg.table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("field_"), F.col("n_nationkey").cast("string")).alias("subject"))
    rest = _deltas(spark, sf_dir).where("material").join(claimed, "subject", "left_anti")
    return rest.groupBy("file", "delta_class").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"), F.count("*").alias("n_deltas"))


@query(f"""WITH {DELTAS}, keys AS (SELECT 'field_' || n_nationkey AS k FROM nation WHERE n_regionkey <> 0), c AS (SELECT DISTINCT subject, delta_id FROM deltas WHERE delta_type = 'OUTPUT_COLUMN_RENAME')
SELECT subject, CASE WHEN subject IN (SELECT k FROM keys) THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, count(*) AS n_counterfactual FROM c GROUP BY 1, 2""")
def m04_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that renames start from: known to the registry or not, and how many counterfactual fields they lead to."""
    keys = reg.table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("field_"), F.col("n_nationkey").cast("string")).alias("subject"), F.lit(True).alias("known"))
    c = _deltas(spark, sf_dir).where("delta_type = 'OUTPUT_COLUMN_RENAME'").groupBy("subject").agg(F.count_distinct("delta_id").alias("n_counterfactual"))
    return c.join(F.broadcast(keys), "subject", "left").select("subject", F.when(F.col("known"), "RESOLVED").otherwise("UNRESOLVED").alias("resolution"), "n_counterfactual")


@query(f"WITH {DELTAS} SELECT CASE WHEN delta_class = 'StructuralFieldDelta' THEN 'structural' WHEN delta_class = 'SemanticSqlDelta' THEN 'semantic' WHEN delta_class = 'PipelineTaskDelta' THEN 'pipeline' ELSE 'contract_quality' END AS change_set, delta_class, count(*) AS n, count(DISTINCT file) AS n_files FROM deltas GROUP BY 1, 2")
def m05_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas parted into structural, semantic, pipeline and contract or quality changes."""
    return _deltas(spark, sf_dir).groupBy(requests.change_set(F.col("delta_class")).alias("change_set"), "delta_class").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


@query(f"WITH {DELTAS} SELECT (SELECT count(DISTINCT file) FROM deltas) AS n_files, (SELECT count(*) FROM deltas) AS n_deltas, (SELECT count(*) FROM deltas WHERE material) AS n_material, (SELECT count(*) FROM roots) AS n_roots, (SELECT count(*) FROM conflict) AS n_conflicts, CASE WHEN (SELECT count(*) FROM conflict) > 0 THEN 'INCONSISTENT' ELSE 'UNRESOLVED' END AS coherence")
def m06_composite_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request in one row; each registry is counted on its own."""
    d, r = _deltas(spark, sf_dir), _roots(spark, sf_dir)
    a = d.agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_deltas"), F.count_if("material").alias("n_material"))
    b = r.agg(F.count("*").alias("n_roots"), F.count_distinct(F.when(F.col("state") == "CONFIRMED_CONFLICT", F.col("root_id"))).alias("n_conflicts"))
    return a.join(F.broadcast(b.withColumn("_k", F.lit(1))), F.col("_k") == 1).drop("_k").withColumn("coherence", F.when(F.col("n_conflicts") > 0, "INCONSISTENT").otherwise("UNRESOLVED"))


_RULE = "CASE delta_type WHEN 'FILTER_CHANGE' THEN 'semantic-filter-population-unresolved' WHEN 'JOIN_TYPE_CHANGE' THEN 'semantic-join-behavior-unresolved' WHEN 'AGGREGATION_CHANGE' THEN 'semantic-aggregation-definition-unresolved' END"


@query(f"WITH {DELTAS} SELECT delta_id, delta_type, {_RULE} AS rule_id, 'SEMANTIC_COMPATIBILITY_UNKNOWN' AS result, 'UNRESOLVED' AS certainty, CASE delta_type WHEN 'FILTER_CHANGE' THEN 'ROW_SET_DEFINITION_CHANGED_WITHOUT_CONTRACT' WHEN 'JOIN_TYPE_CHANGE' THEN 'JOIN_BEHAVIOR_CHANGED_WITHOUT_EXECUTION_EVIDENCE' ELSE 'AGGREGATION_DEFINITION_CHANGED_WITHOUT_APPROVAL' END AS reason_code FROM deltas WHERE delta_class = 'SemanticSqlDelta'")
def j03_semantic_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every semantic delta with the rule of its type."""
    own = _deltas(spark, sf_dir).where("delta_class = 'SemanticSqlDelta'").select("delta_id", "delta_type")
    return requests.semantic_compatibility(own).select("delta_id", "delta_type", "rule_id", "result", "certainty", "reason_code")


@query(f"""WITH {DELTAS} SELECT 'SEMANTIC_COMPATIBILITY' AS dimension, 'SEMANTIC_COMPATIBILITY_UNKNOWN' AS result, {_RULE} AS rule_id, count(*) AS n FROM deltas WHERE delta_class = 'SemanticSqlDelta' GROUP BY delta_type
UNION ALL SELECT 'STRUCTURAL_COMPATIBILITY', CASE WHEN n_lines = 0 THEN 'COMPATIBLE' WHEN delta_type = 'OUTPUT_COLUMN_RENAME' THEN 'UNKNOWN' ELSE 'INCOMPATIBLE' END, lower(delta_type), count(*) FROM (SELECT d.*, (SELECT count(*) FROM lineitem) AS n_lines FROM deltas d) WHERE delta_type IN ('OUTPUT_COLUMN_RENAME', 'OUTPUT_COLUMN_REMOVED') GROUP BY delta_type, 2""")
def m07_compatibility_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic and structural compatibility side by side; neither decides the other."""
    d = _deltas(spark, sf_dir)
    semantic = requests.semantic_compatibility(d.where("delta_class = 'SemanticSqlDelta'")).select(F.lit("SEMANTIC_COMPATIBILITY").alias("dimension"), "result", "rule_id")
    dependants = F.broadcast(reg.table(spark, sf_dir, "lineitem").agg(F.count("*").alias("dependants")).withColumn("_k", F.lit(1)))
    own = d.where("delta_type IN ('OUTPUT_COLUMN_RENAME', 'OUTPUT_COLUMN_REMOVED')").join(dependants, F.col("_k") == 1)
    operation = F.when(F.col("delta_type") == "OUTPUT_COLUMN_RENAME", "FIELD_RENAME").otherwise("FIELD_DELETE")
    structural = own.select(F.lit("STRUCTURAL_COMPATIBILITY").alias("dimension"), rules.structural_compatibility(operation, F.col("dependants"), F.lit(""), F.lit(""), F.lit(False)).alias("result"), F.lower("delta_type").alias("rule_id"))
    return semantic.unionByName(structural).groupBy("dimension", "result", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {DELTAS}, m AS (SELECT 'file_' || c_custkey AS file FROM customer), t AS (SELECT m.file, coalesce(list_sort(list(DISTINCT delta_type) FILTER (WHERE delta_class = 'SemanticSqlDelta')), []) AS types, count(*) FILTER (WHERE delta_class = 'StructuralFieldDelta') AS n_structural FROM m LEFT JOIN deltas d ON d.file = m.file GROUP BY 1)
SELECT file, CASE WHEN len(types) = 0 AND n_structural = 0 THEN 'NO_DEMONSTRATED_MATERIAL_IMPACT' WHEN len(types) = 0 THEN 'UNRESOLVED_SEMANTIC_IMPACT' WHEN types = ['FILTER_CHANGE'] THEN 'ROW_SET_SEMANTICS_CHANGED' WHEN list_contains(types, 'JOIN_TYPE_CHANGE') THEN 'JOIN_SEMANTICS_CHANGED' ELSE 'SEMANTIC_DEFINITION_CHANGED' END AS consequence,
CASE WHEN len(types) = 0 AND n_structural = 0 THEN 'ESTABLISHED' ELSE 'UNRESOLVED' END AS certainty FROM t""")
def j17_semantic_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deltas of each model change in meaning; models without any have no demonstrated impact."""
    models = reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("file_"), F.col("c_custkey").cast("string")).alias("file")).distinct()
    t = _deltas(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_set(F.when(F.col("delta_class") == "SemanticSqlDelta", F.col("delta_type")))).alias("types"), F.count_if(F.col("delta_class") == "StructuralFieldDelta").alias("n_structural"))
    own = models.join(t, "file", "left").select("file", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("n_structural", F.lit(0)).alias("n_structural"))
    state, certainty = requests.semantic_consequence(F.col("types"), F.col("n_structural"))
    return own.select("file", state.alias("consequence"), certainty.alias("certainty"))


@query("""WITH d AS (SELECT p_partkey AS node, count(DISTINCT l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1), c AS (SELECT d.node, n, CASE p_type WHEN 'PROMO' THEN 'INCOMPATIBLE' WHEN 'STANDARD' THEN 'CONDITIONAL' ELSE 'UNKNOWN' END AS state FROM d JOIN part ON p_partkey = d.node)
SELECT node, CASE WHEN n = 0 THEN 'NO_DEMONSTRATED' WHEN state = 'INCOMPATIBLE' THEN 'CONFIRMED' WHEN state = 'CONDITIONAL' THEN 'POTENTIAL' ELSE 'UNRESOLVED' END AS consequence, CASE WHEN n = 0 OR state = 'INCOMPATIBLE' THEN 'ESTABLISHED' WHEN state = 'CONDITIONAL' THEN 'CONDITIONAL' ELSE 'UNRESOLVED' END AS certainty FROM c""")
def j16_structural_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consequence of a change of each field: none without a dependant, else by its compatibility."""
    n = reg.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_orderkey").alias("n"))
    own = reg.fields(spark, sf_dir).join(n, "node", "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "COMPATIBLE").when(F.col("native_type") == "PROMO", "INCOMPATIBLE").when(F.col("native_type") == "STANDARD", "CONDITIONAL").otherwise("UNKNOWN")
    impact, certainty = rules.technical_impact(F.col("state"))
    return own.select("node", state.alias("state")).select("node", impact.alias("consequence"), certainty.alias("certainty"))


@query(f"""WITH {_SUBJECTS}, {_FACTS} SELECT subject, array_to_string(list_filter([CASE technical WHEN 'CONFIRMED' THEN 'CONFIRMED_TECHNICAL_FAILURE' WHEN 'UNRESOLVED' THEN 'UNRESOLVED_TECHNICAL_BOUNDARY' WHEN 'POTENTIAL' THEN 'POTENTIAL_DOWNSTREAM_CONSEQUENCE' ELSE 'NO_DEMONSTRATED_TECHNICAL_IMPACT' END,
CASE WHEN criticality = 'EXPLICIT' THEN 'EXPLICIT_CRITICAL_ASSET' ELSE 'CRITICALITY_NOT_EXPLICIT' END, CASE WHEN breadth IN ('BROAD', 'WIDESPREAD') THEN 'BROAD_CONSUMER_REACH' ELSE 'LIMITED_CONSUMER_REACH' END, CASE technical WHEN 'UNRESOLVED' THEN 'CERTAINTY_UNRESOLVED' WHEN 'POTENTIAL' THEN 'CERTAINTY_CONDITIONAL' END], lambda x: x IS NOT NULL), ',') AS reasons FROM graded""")
def j09_severity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each subject has its severity, in a stated order."""
    certainty = F.when(F.col("technical") == "UNRESOLVED", "UNRESOLVED").when(F.col("technical") == "POTENTIAL", "CONDITIONAL").otherwise("ESTABLISHED")
    return j08_all(spark, sf_dir).select("subject", F.array_join(requests.severity_reasons(F.col("technical"), F.col("criticality"), F.col("breadth"), certainty), ",").alias("reasons"))


_TARGETS = """targets AS (SELECT o_orderkey AS root_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'STALE_PIPELINE_OR_QUALITY_REFERENCE' WHEN o_orderpriority = '2-HIGH' THEN 'STRUCTURAL_CHANGE' WHEN o_orderpriority = '3-MEDIUM' THEN 'CONTRACT_CHANGE' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'SEMANTIC_DEFINITION_CHANGED' ELSE 'CONFLICTING_FUTURE_FIELD_IDENTITIES' END AS root_type,
['PIPELINE_DAG', 'QUALITY_CONFIG', 'PIPELINE_CONFIG', 'DBT_SCHEMA', 'SCHEMA_CONTRACT', 'SQL_MODEL', 'DBT_MODEL'][o_custkey % 7 + 1] AS category, o_orderstatus AS status FROM orders),
fits AS (SELECT * FROM (VALUES ('repair.stale-field.dag-static.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'PIPELINE_DAG'), ('repair.stale-field.quality-config.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'QUALITY_CONFIG'), ('repair.stale-field.pipeline-config.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'PIPELINE_CONFIG'),
('repair.stale-dataset.static-reference.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'PIPELINE_DAG'), ('repair.stale-dataset.static-reference.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'PIPELINE_CONFIG'), ('repair.stale-dataset.static-reference.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'QUALITY_CONFIG'),
('repair.schema.column-name.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'DBT_SCHEMA'), ('repair.schema.column-name.v1', 'CONTRACT_CHANGE', 'DBT_SCHEMA'), ('repair.schema.column-name.v1', 'STRUCTURAL_CHANGE', 'DBT_SCHEMA'),
('repair.contract.field.v1', 'STALE_PIPELINE_OR_QUALITY_REFERENCE', 'SCHEMA_CONTRACT'), ('repair.contract.field.v1', 'CONTRACT_CHANGE', 'SCHEMA_CONTRACT'), ('repair.contract.field.v1', 'STRUCTURAL_CHANGE', 'SCHEMA_CONTRACT'), ('repair.sql.identifier.v1', 'STRUCTURAL_CHANGE', 'SQL_MODEL'),
('repair.dbt.static-model-reference.v1', 'STRUCTURAL_CHANGE', 'DBT_MODEL'), ('repair.dbt.static-model-reference.v1', 'STRUCTURAL_CHANGE', 'PIPELINE_DAG'), ('repair.dbt.static-model-reference.v1', 'STRUCTURAL_CHANGE', 'PIPELINE_CONFIG'),
('repair.delete.structured-stale-reference.v1', 'STRUCTURAL_CHANGE', 'QUALITY_CONFIG'), ('repair.delete.structured-stale-reference.v1', 'STRUCTURAL_CHANGE', 'PIPELINE_CONFIG'), ('repair.delete.structured-stale-reference.v1', 'STRUCTURAL_CHANGE', 'SCHEMA_CONTRACT'), ('repair.delete.structured-stale-reference.v1', 'STRUCTURAL_CHANGE', 'DBT_SCHEMA'),
('repair.type.declaration-alignment.v1', 'STRUCTURAL_CHANGE', 'DBT_SCHEMA'), ('repair.type.declaration-alignment.v1', 'STRUCTURAL_CHANGE', 'SCHEMA_CONTRACT'), ('repair.type.declaration-alignment.v1', 'STRUCTURAL_CHANGE', 'QUALITY_CONFIG'), ('repair.type.declaration-alignment.v1', 'STRUCTURAL_CHANGE', 'PIPELINE_CONFIG'),
('repair.type.declaration-alignment.v1', 'CONTRACT_CHANGE', 'DBT_SCHEMA'), ('repair.type.declaration-alignment.v1', 'CONTRACT_CHANGE', 'SCHEMA_CONTRACT'), ('repair.type.declaration-alignment.v1', 'CONTRACT_CHANGE', 'QUALITY_CONFIG'), ('repair.type.declaration-alignment.v1', 'CONTRACT_CHANGE', 'PIPELINE_CONFIG')) AS v(rule_id, root_type, category)),
ruled AS (SELECT root_id, t.root_type, t.category, status, coalesce(list_sort(list(rule_id) FILTER (WHERE rule_id IS NOT NULL)), []) AS rule_ids FROM targets t LEFT JOIN fits f ON f.root_type = t.root_type AND f.category = t.category GROUP BY ALL)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "STALE_PIPELINE_OR_QUALITY_REFERENCE").when(p == "2-HIGH", "STRUCTURAL_CHANGE").when(p == "3-MEDIUM", "CONTRACT_CHANGE").when(p == "4-NOT SPECIFIED", "SEMANTIC_DEFINITION_CHANGED").otherwise("CONFLICTING_FUTURE_FIELD_IDENTITIES")
    category = F.get(F.array(*[F.lit(c) for c in ("PIPELINE_DAG", "QUALITY_CONFIG", "PIPELINE_CONFIG", "DBT_SCHEMA", "SCHEMA_CONTRACT", "SQL_MODEL", "DBT_MODEL")]), (F.col("o_custkey") % 7).cast("int"))
    return requests.rules_for(reg.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root_id"), kind.alias("root_type"), category.alias("category"), F.col("o_orderstatus").alias("status")))


@query(f"WITH {_TARGETS} SELECT root_id, root_type, category, array_to_string(rule_ids, ',') AS rule_ids FROM ruled")
def j20_repair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair rules that fit each root and the category of its file."""
    return _targets(spark, sf_dir).select("root_id", "root_type", "category", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(f"""WITH {_TARGETS}, n AS (SELECT l_orderkey AS root_id, count(DISTINCT l_linestatus) AS n_matches FROM lineitem GROUP BY 1), f AS (SELECT r.*, coalesce(n_matches, 0) AS n_matches FROM ruled r LEFT JOIN n USING (root_id))
SELECT root_id, CASE WHEN root_type = 'CONFLICTING_FUTURE_FIELD_IDENTITIES' THEN 'BLOCKED_BY_CONFLICT' WHEN status = 'P' THEN 'UNSUPPORTED' WHEN root_type = 'SEMANTIC_DEFINITION_CHANGED' THEN 'MANUAL_DECISION_REQUIRED' WHEN root_type = 'STALE_PIPELINE_OR_QUALITY_REFERENCE' THEN CASE WHEN n_matches <> 1 THEN 'MANUAL_DECISION_REQUIRED' WHEN len(rule_ids) = 1 THEN 'AUTO_REPAIRABLE' ELSE 'UNSUPPORTED' END ELSE 'MANUAL_DECISION_REQUIRED' END AS state,
CASE WHEN root_type = 'CONFLICTING_FUTURE_FIELD_IDENTITIES' THEN 'explicit-conflict' WHEN status = 'P' THEN 'dynamic-reference' WHEN root_type = 'SEMANTIC_DEFINITION_CHANGED' THEN 'semantic-intent' WHEN root_type = 'STALE_PIPELINE_OR_QUALITY_REFERENCE' THEN CASE WHEN n_matches <> 1 THEN 'target-not-unique' WHEN len(rule_ids) = 1 THEN 'one-target-one-rule' ELSE 'no-single-rule' END ELSE 'change-source-or-intent' END AS basis FROM f""")
def j21_repairability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each root can be repaired, and why; open orders stand for dynamic references, line statuses for targets found."""
    n = reg.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("root_id")).agg(F.count_distinct("l_linestatus").alias("n_matches"))
    own = _targets(spark, sf_dir).join(n, "root_id", "left")
    state, basis = requests.repairability(F.col("root_type"), F.lit(1), F.col("status") == "P", F.coalesce("n_matches", F.lit(0)), F.size("rule_ids"))
    return own.select("root_id", state.alias("state"), basis.alias("basis"))


@query(f"""WITH {MAPPINGS} SELECT category, CASE category WHEN 'owner' THEN 'ACCOUNTABILITY' WHEN 'tag' THEN 'CLASSIFICATION' WHEN 'pipeline' THEN 'OPERATIONAL_DEPENDENCY_CONTEXT' ELSE 'CONSUMER_FACING_CONTEXT' END AS significance, 'CONTEXT_LINKED_TO_' || CASE state WHEN 'RESOLVED' THEN 'CONFIRMED' ELSE 'UNRESOLVED' END || '_TECHNICAL_STATE' AS linkage, count(DISTINCT target_key) AS n_assets FROM mappings GROUP BY 1, 2, 3""")
def j22_context_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each category of context means, and the technical state it is linked to."""
    state = F.concat(F.lit("CONTEXT_LINKED_TO_"), F.when(F.col("state") == "RESOLVED", "CONFIRMED").otherwise("UNRESOLVED"), F.lit("_TECHNICAL_STATE"))
    return _mappings(spark, sf_dir).groupBy("category", requests.looked_up(requests.SIGNIFICANCE, F.col("category")).alias("significance"), state.alias("linkage")).agg(F.count_distinct("target_key").alias("n_assets"))


_DAGS = """side AS (SELECT 'b' AS v, * FROM lineitem WHERE l_returnflag IN ('A', 'N') UNION ALL SELECT 'a', * FROM lineitem WHERE l_returnflag IN ('R', 'N')),
task AS (SELECT v, l_orderkey AS dag, l_linenumber AS i, min(l_partkey) AS part, min(l_suppkey) AS supp, max(l_suppkey) AS other, count(*) AS n FROM side GROUP BY 1, 2, 3),
named AS (SELECT *, 't' || i AS task_id, CASE WHEN dag % 13 = 5 THEN NULL ELSE lead(i) OVER (PARTITION BY v, dag ORDER BY i) END AS following FROM task WHERE dag % 13 <> 7),
entry AS (SELECT v, dag, 'TASK' AS what, task_id AS key, '' AS value FROM named UNION ALL SELECT v, dag, 'DEPENDENCY', 't' || i || '>' || 't' || following, '' FROM named WHERE following IS NOT NULL
  UNION ALL SELECT v, dag, 'REFERENCE', task_id || '.field', 'col_' || part FROM named UNION ALL SELECT v, dag, 'REFERENCE', task_id || '.dataset', 'supplier_' || supp FROM named WHERE i % 2 = 0 UNION ALL SELECT v, dag, 'DYNAMIC', task_id || '.owner', '' FROM named WHERE i % 3 = 0)"""


@query(f"""WITH {_DAGS}, a AS (SELECT * FROM entry WHERE v = 'b'), b AS (SELECT * FROM entry WHERE v = 'a'),
u AS (SELECT coalesce(a.dag, b.dag) AS dag, coalesce(a.what, b.what) AS what, CASE WHEN a.dag IS NULL THEN 'ADDED' WHEN b.dag IS NULL THEN 'REMOVED' WHEN a.value <> b.value THEN 'CHANGED' END AS change FROM a FULL JOIN b ON a.dag = b.dag AND a.what = b.what AND a.key = b.key)
SELECT dag, what, change, count(*) AS n FROM u WHERE change IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT o_orderkey, 'FILE', 'UNPARSED', 1 FROM orders WHERE o_orderkey % 13 = 7 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def l11_dag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, dependencies, references and dynamic places of each order's pipeline file, before and after, read by the parser from the files' text;
    files that do not parse say so."""
    lines = reg.table(spark, sf_dir, "lineitem")
    i, n = F.col("l_linenumber").cast("string"), F.col("l_linenumber")
    task = lambda: F.concat(F.lit("v"), i, F.lit(" = Operator(task_id='t"), i, F.lit("', field=\"col_"), F.col("part").cast("string"), F.lit('"'), F.when(n % 2 == 0, F.concat(F.lit(", dataset='supplier_"), F.col("supp").cast("string"), F.lit("'"))).otherwise(""), F.when(n % 3 == 0, ", owner=lookup(1)").otherwise(""), F.lit(", retries=2)"))

    def side(flags: list[str]) -> DataFrame:
        own = lines.where(F.col("l_returnflag").isin(flags)).groupBy(F.col("l_orderkey").alias("dag"), "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
        listed = own.groupBy("dag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", task().alias("text")))).alias("tasks"))
        names = F.transform("tasks", lambda t: F.concat(F.lit("v"), t["l_linenumber"].cast("string")))
        # five ways to write a chain, one that no parser knows, and a file that is cut off
        way = F.col("dag") % 13
        calls = F.array_join(F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.concat(F.get(names, k - 1), F.lit(".set_downstream("), F.get(names, k), F.lit(")"))), "\n")
        ups = F.array_join(F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.concat(F.get(names, k), F.lit(".set_upstream(["), F.get(names, k - 1), F.lit("])"))), "\n")
        chain = F.when((F.size(names) < 2) | (way == 5), F.lit("print('no chain')")).when(way % 4 == 0, F.array_join(names, " >> ")).when(way % 4 == 1, F.array_join(F.reverse(names), " << ")).when(way % 4 == 2, calls).otherwise(ups)
        source = F.concat(F.lit("from airlines import Operator\n# order "), F.col("dag").cast("string"), F.lit("\n"), F.array_join(F.transform("tasks", lambda t: t["text"]), "\n"), F.lit("\n"), chain, F.when(way == 7, "\nv1 = (").otherwise("\n"))
        return listed.select("dag", source.alias("source"))

    def entries(dag, source):
        try:
            found = repository.pipeline_structure(source)
        except SyntaxError:
            return dag, None
        ids = found["tasks"]
        rows = [("TASK", t, "") for t in ids.values()] + [("DEPENDENCY", f"{ids[a]}>{ids[b]}", "") for a, b in found["edges"]] + [("REFERENCE", k, v) for k, v in found["references"]] + [("DYNAMIC", k, "") for k in found["dynamic"]]
        return dag, rows

    parsed = lambda flags: repository.each(side(flags), entries, "dag long, found array<struct<what: string, key: string, value: string>>")
    with Scratch(spark) as scratch:
        before, after = scratch.keep(parsed(["A", "N"]), "before"), scratch.keep(parsed(["R", "N"]), "after")
        flat = lambda df: df.select("dag", F.explode("found").alias("f")).select("dag", "f.*")
        changed = requests.diffed(flat(before), flat(after), ["dag", "what", "key"], "value").groupBy("dag", "what", "change").agg(F.count("*").alias("n"))
        failed = before.unionByName(after).where("found IS NULL").select("dag").distinct().select("dag", F.lit("FILE").alias("what"), F.lit("UNPARSED").alias("change"), F.lit(1).cast("long").alias("n"))
        return scratch.result(changed.unionByName(failed))


@query("""WITH k AS (SELECT c_custkey AS contract, 'owner' AS k, c_mktsegment AS a, lower(c_mktsegment) AS b FROM customer UNION ALL SELECT c_custkey, 'dataset', c_name, c_name FROM customer UNION ALL SELECT c_custkey, 'guarantee', c_nationkey::VARCHAR, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey::VARCHAR END FROM customer)
SELECT contract, CASE WHEN k IN ('description', 'owner') THEN 'DocumentationOnlyDelta' ELSE 'ModelContractDelta' END AS delta_class, array_to_string(list_sort(list(k)), ',') AS keys FROM k WHERE a IS DISTINCT FROM b GROUP BY 1, 2""")
def l08_contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts before and after, key by key: technical guarantees apart from documentation."""
    c = reg.table(spark, sf_dir, "customer")
    row = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    side = lambda owner, guarantee: c.select(F.col("c_custkey").alias("contract"), F.explode(F.array(row("owner", owner), row("dataset", F.col("c_name")), row("guarantee", guarantee))).alias("r")).select("contract", "r.key", "r.value").where("value is not null")
    nation = F.col("c_nationkey")
    found = requests.diffed(side(F.col("c_mktsegment"), nation), side(F.lower("c_mktsegment"), F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(nation)), ["contract", "key"], "value")
    kind = F.when(F.col("key").isin("description", "owner"), "DocumentationOnlyDelta").otherwise("ModelContractDelta")
    return found.groupBy("contract", kind.alias("delta_class")).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query(f"""WITH {DELTAS}, g AS (SELECT 'field_' || c_nationkey AS group_id, list_sort(list(DISTINCT 'file_' || c_custkey)) AS files FROM customer GROUP BY c_nationkey), gf AS (SELECT group_id, unnest(files) AS file FROM g),
m AS (SELECT g.group_id, d.delta_id FROM g JOIN deltas d ON d.subject = g.group_id UNION SELECT gf.group_id, d.delta_id FROM gf JOIN deltas d ON d.file = gf.file)
SELECT g.group_id, count(delta_id) AS n_roots FROM g LEFT JOIN m ON m.group_id = g.group_id GROUP BY 1""")
def d16_roots_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root causes of each logical group: the same id or a shared file."""
    groups = reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("field_"), F.col("c_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("file_"), F.col("c_custkey").cast("string")).alias("file"))
    return requests.roots_of_groups(_deltas(spark, sf_dir).select(F.col("delta_id").alias("root_id"), F.col("subject").alias("group_id"), "file"), groups)


@query(f"WITH {DELTAS}, w AS (SELECT DISTINCT 'file_' || c_custkey AS id FROM customer UNION SELECT 'file_0') SELECT id, count(root_id) AS n_roots, CASE WHEN count(root_id) = 0 THEN 'UNKNOWN' ELSE 'SELECTED' END AS state FROM w LEFT JOIN roots ON file = id GROUP BY 1")
def n01_selected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a repair is asked for, with the roots they select; one without is an unknown id."""
    wanted = reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("file_"), F.col("c_custkey").cast("string")).alias("id")).unionByName(spark.createDataFrame([("file_0",)], "id string"))
    return requests.selected(_roots(spark, sf_dir), wanted, "file")


@query("SELECT CASE WHEN starts_with(target, 'urn:li:corpuser:') THEN 'CORP_USER' WHEN starts_with(target, 'urn:li:corpGroup:') THEN 'CORP_GROUP' ELSE 'UNKNOWN' END AS owner_kind, count(*) AS n FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'urn:li:corpuser:' WHEN 'MACHINERY' THEN 'urn:li:corpGroup:' ELSE 'urn:li:other:' END || c_custkey AS target FROM customer) GROUP BY 1")
def c33_owner_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by the kind that their URN says."""
    s = F.col("c_mktsegment")
    urn = F.concat(F.when(s == "BUILDING", "urn:li:corpuser:").when(s == "MACHINERY", "urn:li:corpGroup:").otherwise("urn:li:other:"), F.col("c_custkey").cast("string"))
    own = reg.table(spark, sf_dir, "customer").select(urn.alias("u"))
    kind = F.when(F.col("u").startswith("urn:li:corpuser:"), "CORP_USER").when(F.col("u").startswith("urn:li:corpGroup:"), "CORP_GROUP").otherwise("UNKNOWN")
    return own.groupBy(kind.alias("owner_kind")).agg(F.count("*").alias("n"))


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT subject, severity, technical, supporting_datasets, context_assets FROM graded WHERE technical IN ('CONFIRMED', 'UNRESOLVED') AND severity IN ('HIGH', 'CRITICAL') AND breadth = 'WIDESPREAD' AND contains(lower(criticality), 'e')")
def c36_explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filters of the explorer: text, exposure, severity and breadth."""
    own = j08_all(spark, sf_dir).where(F.col("technical").isin("CONFIRMED", "UNRESOLVED") & F.col("severity").isin("HIGH", "CRITICAL") & (F.col("breadth") == "WIDESPREAD") & F.contains(F.lower("criticality"), F.lit("e")))
    return own.select("subject", "severity", "technical", "supporting_datasets", "context_assets")


@query("SELECT count(*) AS changed_file_count, count(*) FILTER (WHERE c_mktsegment <> 'FURNITURE') AS supported_count, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS unsupported_count, count(*) FILTER (WHERE c_acctbal < 0) AS binary_count FROM customer")
def f17_inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files in one row: supported, unsupported, binary."""
    s = F.col("c_mktsegment") == "FURNITURE"
    return reg.table(spark, sf_dir, "customer").agg(F.count("*").alias("changed_file_count"), F.count_if(~s).alias("supported_count"), F.count_if(s).alias("unsupported_count"), F.count_if(F.col("c_acctbal") < 0).alias("binary_count"))


@query("""WITH a AS (SELECT DISTINCT p_brand, l_partkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT p_brand, l_partkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')
SELECT coalesce(a.p_brand, b.p_brand) AS model, count(*) FILTER (WHERE b.k IS NULL) AS n_removed, count(*) FILTER (WHERE a.k IS NULL) AS n_added, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_kept FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.k = b.k GROUP BY 1""")
def h02_output_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names of each model before and after: removed, added, kept; one pass, two flags a name."""
    lines = reg.table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    own = lines.join(reg.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand"), "k")
    return own.groupBy(F.col("p_brand").alias("model")).agg(F.count_if(~F.col("b")).alias("n_removed"), F.count_if(~F.col("a")).alias("n_added"), F.count_if(F.col("a") & F.col("b")).alias("n_kept"))


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT count(*) AS n_subjects, sum(supporting_datasets)::BIGINT AS n_datasets, max(context_assets) AS most_assets, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS n_grave, count(*) FILTER (WHERE technical = 'UNRESOLVED') AS n_unresolved, count(DISTINCT breadth) AS n_breadths FROM graded")
def f21_scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of a synthesis in one row."""
    return j08_all(spark, sf_dir).agg(F.count("*").alias("n_subjects"), F.sum("supporting_datasets").alias("n_datasets"), F.max("context_assets").alias("most_assets"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("n_grave"), F.count_if(F.col("technical") == "UNRESOLVED").alias("n_unresolved"), F.count_distinct("breadth").alias("n_breadths"))
