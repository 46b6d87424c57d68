"""Queries of what people and files need: predicates, ladders, resolution of SQL names, views, and edits file by file, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import presentation, proposals, repair, resolve, rules
from ..sources import files
from ..sources import registry as reg
from .catalog import _FACTS, _SUBJECTS, EDGES, MAPPINGS, _mappings, j08_all, query

_PATH = "CASE c_mktsegment WHEN 'BUILDING' THEN 'models/m' || c_custkey || '.sql' WHEN 'MACHINERY' THEN '../m' || c_custkey WHEN 'FURNITURE' THEN '/etc/m' || c_custkey WHEN 'HOUSEHOLD' THEN 'a//m' || c_custkey ELSE 'C:m' || c_custkey END"


def _paths(spark, sf_dir):
    s, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    path = F.when(s == "BUILDING", F.concat(F.lit("models/m"), key, F.lit(".sql"))).when(s == "MACHINERY", F.concat(F.lit("../m"), key)).when(s == "FURNITURE", F.concat(F.lit("/etc/m"), key)).when(s == "HOUSEHOLD", F.concat(F.lit("a//m"), key)).otherwise(F.concat(F.lit("C:m"), key))
    return reg.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", path.alias("path"))


@query(f"SELECT c_custkey, {_PATH} AS path, c_mktsegment = 'BUILDING' AS safe FROM customer")
def c22_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that stay inside the repository."""
    return _paths(spark, sf_dir).select("c_custkey", "path", ids.safe_path(F.col("path")).alias("safe"))


@query("SELECT o_orderstatus = 'F' AS held, count(*) AS n FROM orders GROUP BY 1")
def c23_credential_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold credentials, counted; finished orders' notes hold one."""
    note = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("note api_key: k"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("note key "), F.col("o_orderkey").cast("string")))
    return reg.table(spark, sf_dir, "orders").groupBy(ids.holds_credentials(note).alias("held")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, replace(replace(c_name || ' of ' || c_mktsegment, 'MACHINERY', '[REDACTED]'), 'Customer', '[REDACTED]') AS message FROM customer")
def c25_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known secrets in messages, the longest first."""
    text = F.concat_ws(" of ", "c_name", "c_mktsegment")
    return reg.table(spark, sf_dir, "customer").select("c_custkey", ids.redacted(text, ["Customer", "MACHINERY"]).alias("message"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'business.criticality' WHEN 'STANDARD' THEN 'business.importanceTier' ELSE 'other' END AS property, p_type IN ('PROMO', 'STANDARD') AND p_size > 25 AS explicit FROM part")
def c34_explicit_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designations of an allow-list; values are compared trimmed and lower-cased."""
    prop = F.when(F.col("p_type") == "PROMO", "business.criticality").when(F.col("p_type") == "STANDARD", "business.importanceTier").otherwise("other")
    own = reg.table(spark, sf_dir, "part").select("p_partkey", prop.alias("property"), F.when(F.col("p_size") > 25, " Tier_1 ").otherwise("tier_3").alias("value"))
    return own.select("p_partkey", "property", rules.explicitly_critical(F.col("property"), F.col("value")).alias("explicit"))


@query(f"""WITH {EDGES}, e AS (SELECT src, dst, CASE a.p_type WHEN 'PROMO' THEN 'accepts' WHEN 'ECONOMY' THEN 'rejects' WHEN 'STANDARD' THEN 'conditional' END AS behaviour, a.p_size > 40 AS changed, b.p_size > 10 AS kept FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst)
SELECT CASE behaviour WHEN 'accepts' THEN 'COMPATIBLE' WHEN 'rejects' THEN 'INCOMPATIBLE' WHEN 'conditional' THEN 'CONDITIONAL' ELSE CASE WHEN changed THEN 'UNKNOWN' WHEN kept THEN 'CONDITIONAL' ELSE 'UNKNOWN' END END AS state,
CASE WHEN behaviour IS NOT NULL THEN 'EXPLICIT' WHEN changed THEN 'INSUFFICIENT' WHEN kept THEN 'DERIVED' ELSE 'INSUFFICIENT' END AS strength, count(*) AS n FROM e GROUP BY 1, 2""")
def j02_edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge under a rename: state and strength of evidence."""
    part = reg.table(spark, sf_dir, "part")
    behaviour = F.when(F.col("p_type") == "PROMO", "accepts").when(F.col("p_type") == "ECONOMY", "rejects").when(F.col("p_type") == "STANDARD", "conditional")
    a, b = part.select(F.col("p_partkey").alias("src"), behaviour.alias("behaviour"), (F.col("p_size") > 40).alias("changed")), part.select(F.col("p_partkey").alias("dst"), (F.col("p_size") > 10).alias("kept"))
    state, strength = rules.edge_compatibility(F.col("behaviour"), F.col("changed"), F.col("kept"))
    return reg.lineage_edges(spark, sf_dir).join(a, "src").join(b, "dst").groupBy(state.alias("state"), strength.alias("strength")).agg(F.count("*").alias("n"))


_BRANDS = "brands AS (SELECT c_custkey AS request, count(o_orderkey) AS deltas, count(DISTINCT o_orderpriority) - 1 AS datasets, count(*) FILTER (WHERE o_orderstatus = 'P') AS conflicts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


def _requests(spark, sf_dir):
    own = reg.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("deltas"), (F.count_distinct("o_orderpriority") - 1).alias("datasets"), F.count_if(F.col("o_orderstatus") == "P").alias("conflicts"))
    all_ = reg.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request")).join(own, F.col("request") == F.col("o_custkey"), "left")
    return all_.select("request", F.coalesce("deltas", F.lit(0)).alias("deltas"), F.coalesce("datasets", F.lit(-1)).alias("datasets"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


@query(f"""WITH {_BRANDS} SELECT request, CASE WHEN deltas = 0 THEN 'LOW' WHEN datasets = 0 THEN 'MODERATE' WHEN datasets > 2 THEN 'HIGH' ELSE 'MODERATE' END AS severity, CASE WHEN deltas = 0 THEN 'proceed' WHEN datasets <= 0 THEN 'proceed_with_conditions' ELSE 'hold_for_review' END AS decision FROM brands""")
def j11_semantic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and decision of semantic changes, by deltas and datasets reached."""
    own = _requests(spark, sf_dir)
    return own.select("request", rules.semantic_severity(F.col("deltas") > 0, F.col("datasets")).alias("severity"), rules.semantic_decision(F.col("deltas"), F.greatest("datasets", F.lit(0))).alias("decision"))


@query(f"WITH {_BRANDS} SELECT request, CASE WHEN conflicts > 0 THEN 'HIGH' WHEN deltas > 0 AND datasets > 0 THEN 'HIGH' WHEN deltas > 0 THEN 'MODERATE' ELSE 'LOW' END AS severity, CASE WHEN deltas = 0 THEN 'no_material_change' WHEN conflicts > 0 THEN 'block_confirmed_incompatibility' ELSE 'hold_for_review' END AS decision FROM brands")
def j12_request_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and decision of each change request."""
    own = _requests(spark, sf_dir)
    return own.select("request", rules.change_request_severity(F.col("conflicts"), F.col("deltas"), F.col("datasets")).alias("severity"), rules.change_request_decision(F.col("deltas"), F.col("conflicts")).alias("decision"))


@query(f"""WITH {_SUBJECTS}, {_FACTS} SELECT subject, upper(severity[1]) || lower(severity[2:]) AS label, CASE WHEN len(id) <= 19 THEN id ELSE substr(id, 1, 12) || '…' || right(id, 6) END AS short_id FROM (SELECT *, repeat('subject-', 2) || subject || '-' || technical AS id FROM graded)""")
def i17_text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and shortened identifiers for a screen."""
    long = F.concat(F.lit("subject-subject-"), F.col("subject").cast("string"), F.lit("-"), F.col("technical"))
    return j08_all(spark, sf_dir).select("subject", ids.humanized(F.lower("severity")).alias("label"), ids.compact_id(long).alias("short_id"))


@query(f"WITH {MAPPINGS} SELECT p_partkey AS node, CASE WHEN count(target_key) > 0 THEN 'present' ELSE 'absent' END AS tags FROM part LEFT JOIN (SELECT * FROM mappings WHERE category = 'tag' AND state = 'UNRESOLVED') m ON node = p_partkey GROUP BY 1")
def c31_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a look for unresolved tags found any; nothing found is a fact too."""
    tags = _mappings(spark, sf_dir).where("category = 'tag' AND state = 'UNRESOLVED'").groupBy("node").agg(F.collect_set("target_key").alias("t"))
    return reg.fields(spark, sf_dir).select("node").join(tags, "node", "left").select("node", presentation.presence(F.col("t")).alias("tags"))


@query(f"WITH {EDGES} SELECT CASE WHEN a.p_brand = b.p_brand THEN 'INTERNAL' WHEN a.p_size > 25 THEN 'UNVERIFIED' ELSE 'CROSS_DATASET' END AS category, count(*) AS n FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY 1")
def c30_edge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside a dataset, across datasets, and unverified ones."""
    f = reg.table(spark, sf_dir, "part")
    a, b = f.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("x"), F.when(F.col("p_size") > 25, "UNKNOWN").otherwise("DIRECT").alias("c")), f.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("y"))
    return reg.lineage_edges(spark, sf_dir).join(a, "src").join(b, "dst").groupBy(presentation.edge_category(F.col("x"), F.col("y"), F.col("c")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, own AS (SELECT p_partkey AS node FROM part WHERE contains(lower(p_brand), '1') OR contains(lower(p_type), 'promo')), e AS (SELECT * FROM edges WHERE src IN (SELECT node FROM own) AND dst IN (SELECT node FROM own)) SELECT src, count(*) AS n FROM e GROUP BY 1")
def c35_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of the fields that a text filter passes."""
    nodes = reg.fields(spark, sf_dir)
    keep = presentation.text_filter(["dataset_urn"], "1") | presentation.text_filter(["native_type"], "Promo")
    return presentation.induced(nodes, reg.lineage_edges(spark, sf_dir), keep)[1].groupBy("src").agg(F.count("*").alias("n"))


@query(f"WITH {MAPPINGS} SELECT DISTINCT category, target_key, state FROM mappings WHERE dataset_urn = 'Brand#11'")
def p06_dataset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of one dataset; the filter reaches the scan of its fields."""
    return presentation.lookup(_mappings(spark, sf_dir), "dataset_urn", "Brand#11").select("category", "target_key", "state").distinct()


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT subject, 'Does ' || subject || ' accept the change? Its state is ' || technical || '.' AS question, 'test_run' AS required_evidence FROM graded WHERE technical IN ('UNRESOLVED', 'POTENTIAL')")
def j24_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and the evidence it needs for every subject in doubt."""
    return presentation.questions(j08_all(spark, sf_dir).where(F.col("technical").isin("UNRESOLVED", "POTENTIAL")), "subject", "technical")


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT subject, 'Decision: undecided. Technical impact is ' || lower(technical) || ' over ' || supporting_datasets || ' datasets, severity ' || lower(severity) || '.' AS narrative FROM graded")
def p02_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each assessment."""
    return j08_all(spark, sf_dir).select("subject", presentation.narrative(F.lit(None).cast("string"), F.col("technical"), F.col("severity"), F.col("supporting_datasets")).alias("narrative"))


@query("""WITH d AS (SELECT DISTINCT lower(p_brand) AS v, p_brand FROM part), r AS (SELECT 'm' || c_custkey AS model, CASE WHEN c_nationkey < 10 THEN 'brand#11' ELSE 'brand#' || c_nationkey END AS relation FROM customer)
SELECT model, relation, p_brand AS dataset_urn, CASE WHEN p_brand IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS resolution FROM r LEFT JOIN d ON v = relation""")
def d01_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of SQL models against the datasets' name variants."""
    n = F.col("c_nationkey")
    r = reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("model"), F.when(n < 10, "brand#11").otherwise(F.concat(F.lit("brand#"), n.cast("string"))).alias("relation"), F.lit("hive").alias("platform"))
    d = reg.fields(spark, sf_dir).select("dataset_urn", F.concat(F.lit("tenant.db."), F.col("dataset_urn")).alias("name"), F.lit("Hive").alias("platform")).distinct()
    return resolve.resolve_relations(r, d)


@query("""WITH rel AS (SELECT DISTINCT 'm' || p_brand AS model, 'b' AS alias, p_brand AS dataset_urn FROM part UNION ALL SELECT DISTINCT 'm' || p_brand, 'other', 'Brand#11' FROM part WHERE p_brand = 'Brand#12'), n AS (SELECT model, count(*) AS n, min(dataset_urn) AS only_ FROM rel GROUP BY 1),
c AS (SELECT 'm' || p_brand AS model, CASE WHEN p_size > 25 THEN 'b' WHEN p_size > 10 THEN NULL ELSE 'zz' END AS qualifier, 'COL_' || (p_partkey + CASE WHEN p_size = 50 THEN 1 ELSE 0 END) AS "column" FROM part),
s AS (SELECT c.model, qualifier, "column", CASE WHEN qualifier IS NOT NULL THEN r.dataset_urn WHEN n = 1 THEN only_ END AS dataset_urn, n FROM c JOIN n ON n.model = c.model LEFT JOIN rel r ON r.model = c.model AND r.alias = qualifier)
SELECT CASE WHEN qualifier IS NULL AND n <> 1 THEN 'AMBIGUOUS' WHEN dataset_urn IS NULL THEN 'UNKNOWN_ALIAS' WHEN p_partkey IS NULL THEN 'UNKNOWN_FIELD' ELSE 'RESOLVED' END AS resolution, count(*) AS n FROM s LEFT JOIN part ON p_brand = dataset_urn AND 'col_' || p_partkey = lower("column") GROUP BY 1""")
def d02_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of SQL models against the fields of their relations, by alias or where there is but one relation."""
    f = reg.fields(spark, sf_dir)
    model = F.concat(F.lit("m"), F.col("dataset_urn"))
    rel = f.select(model.alias("model"), F.lit("b").alias("alias"), "dataset_urn").distinct()
    rel = rel.unionByName(f.where("dataset_urn = 'Brand#12'").select(model.alias("model"), F.lit("other").alias("alias"), F.lit("Brand#11").alias("dataset_urn")).distinct())
    key = F.col("node") + F.when(F.col("size") == 50, 1).otherwise(0)
    c = f.select(model.alias("model"), F.when(F.col("size") > 25, "b").when(F.col("size") > 10, F.lit(None)).otherwise("zz").alias("qualifier"), F.concat(F.lit("COL_"), key.cast("string")).alias("column"))
    return resolve.resolve_columns(c, rel, f).groupBy("resolution").agg(F.count("*").alias("n"))


@query("SELECT 'm' || p_brand AS model, count(*) AS n_fields, min('col_' || p_partkey) AS first_field FROM part WHERE p_brand <> 'Brand#12' GROUP BY 1")
def d03_star_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a star stands for in models of one relation; a model of two has none."""
    f = reg.fields(spark, sf_dir)
    rel = f.select(F.concat(F.lit("m"), F.col("dataset_urn")).alias("model"), "dataset_urn").distinct()
    rel = rel.unionByName(rel.where("model = 'mBrand#12'").select("model", F.lit("Brand#11").alias("dataset_urn")))
    return resolve.expand_star(rel, f).groupBy("model").agg(F.count("*").alias("n_fields"), F.min("field_path").alias("first_field"))


@query("""WITH n AS (SELECT count(*) FILTER (WHERE p_brand = 'Brand#11') AS d, count(*) FILTER (WHERE p_brand = 'Brand#11' AND p_partkey = 11) AS f FROM part)
SELECT 'snapshot_fingerprint' AS name, 'FAILED' AS status FROM n UNION ALL SELECT 'dataset_is_known', CASE WHEN d > 0 THEN 'PASSED' ELSE 'FAILED' END FROM n UNION ALL SELECT 'field_is_there_once', CASE WHEN f = 1 THEN 'PASSED' ELSE 'FAILED' END FROM n UNION ALL SELECT 'new_name_is_free', 'PASSED' FROM n UNION ALL SELECT 'type_changes', 'PASSED' FROM n""")
def c19_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a proposal takes for granted, checked against the schema; its baseline is stale here."""
    p = {"dataset_urn": "Brand#11", "current_field_path": "col_11", "proposed_field_path": "renamed", "source_snapshot_fingerprint": "sha256:0"}
    return proposals.preconditions(p, reg.fields(spark, sf_dir), "sha256:1").select("name", "status")


@query("SELECT 'files' AS name, count(*) <= 200 AS passed FROM customer UNION ALL SELECT 'bytes', max(c_custkey) <= 1048576 FROM customer UNION ALL SELECT 'paths', count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') = 0 FROM customer")
def g09_request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard limits of a change request, as checks."""
    own = _paths(spark, sf_dir).select("path", F.col("c_custkey").alias("size"))
    found = proposals.within_limits(own)
    return found.select(F.when(F.col("name").isin("files", "bytes"), F.col("name")).otherwise("paths").alias("name"), "passed")


@query(f"WITH {MAPPINGS}, e AS (SELECT DISTINCT dataset_urn, category || '/' || target_key AS evidence_id FROM mappings), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_urn ORDER BY evidence_id) AS position FROM e) SELECT dataset_urn, position, evidence_id FROM r WHERE position <= 100")
def g06_evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pieces of evidence of each dataset (a bounded list by design)."""
    e = _mappings(spark, sf_dir).select("dataset_urn", F.concat_ws("/", "category", "target_key").alias("evidence_id")).distinct()
    return rules.top_of_each(e, ["dataset_urn"], ["evidence_id"], presentation.MAX_EVIDENCE).select("dataset_urn", "position", "evidence_id")


# --- file by file -------------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, 'op(field="new_' || p_partkey || '", owner="' || p_brand || '")  # col_' || p_partkey AS candidate FROM part""")
def n03_python_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string argument replaced in a pipeline file for each part; comments and the rest stay."""
    own = reg.table(spark, sf_dir, "part").select("p_partkey", F.format_string('op(field="col_%d", owner="%s")  # col_%d', "p_partkey", "p_brand", "p_partkey").alias("content"))
    return files.each(own, lambda k, c: (k, repair.edit_python(c, f"col_{k}", f"new_{k}")), "p_partkey long, candidate string")


@query("""SELECT p_partkey, 'SELECT new_' || p_partkey || ' AS v, ''col_' || p_partkey || ''' AS t FROM x -- col_' || p_partkey AS candidate FROM part""")
def n05_sql_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier replaced in a model for each part; literals and comments stay."""
    own = reg.table(spark, sf_dir, "part").select("p_partkey", F.format_string("SELECT col_%d AS v, 'col_%d' AS t FROM x -- col_%d", "p_partkey", "p_partkey", "p_partkey").alias("content"))
    return files.each(own, lambda k, c: (k, repair.edit_sql(c, f"col_{k}", f"new_{k}")), "p_partkey long, candidate string")


@query("""SELECT p_partkey, 'select * from {{ ref(''new_' || p_partkey || ''') }} join {{ ref(''other'') }}' AS candidate FROM part""")
def n06_template_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal of one static reference replaced in a template for each part."""
    own = reg.table(spark, sf_dir, "part").select("p_partkey", F.format_string("select * from {{ ref('col_%d') }} join {{ ref('other') }}", "p_partkey").alias("content"))
    return files.each(own, lambda k, c: (k, repair.edit_template_reference(c, f"col_{k}", f"new_{k}")), "p_partkey long, candidate string")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MODIFIED' WHEN 'O' THEN 'ADDED' ELSE 'RENAMED' END AS kind, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'a/' || o_orderkey END AS base_path, CASE WHEN o_orderstatus = 'P' THEN 'b/' ELSE 'a/' END || o_orderkey AS head_path FROM orders")
def a25_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files from NUL-separated output: one path, or two for a rename."""
    s, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    raw = F.when(s == "F", F.concat(F.lit("M|a/"), key)).when(s == "O", F.concat(F.lit("A|a/"), key)).otherwise(F.concat(F.lit("R090|a/"), key, F.lit("|b/"), key))

    def parsed(k, raw):
        (status, base, head), = files.name_status((raw + "|").replace("|", "\0").encode())
        return k, status, base, head

    return files.each(reg.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), parsed, "o_orderkey long, kind string, base_path string, head_path string")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS rejected FROM customer")
def a29_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a key are rejected, where Spark's own reader would keep one of the two."""
    extra = F.when(F.col("c_mktsegment") == "BUILDING", ', "k": 2').otherwise("")
    own = reg.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"k": 1, "n": {"k": '), F.col("c_custkey").cast("string"), F.lit("}"), extra, F.lit("}")).alias("content"))

    def tested(k, content):
        try:
            files.strict_json(content)
        except ValueError:
            return k, True
        return k, False

    return files.each(own, tested, "c_custkey long, rejected boolean")


@query("""SELECT c_custkey, unnest(['$.owner.name', '$.keys[0]', '$.keys[1]']) AS location, unnest([c_name, c_custkey::VARCHAR, c_mktsegment]) AS value FROM customer""")
def i14_flattened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of a document with its place."""
    own = reg.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.col("c_name").alias("name")).alias("owner"), F.array(F.col("c_custkey").cast("string"), "c_mktsegment").alias("keys"))).alias("content"))
    found = files.each(own, lambda k, c: (k, [list(x) for x in files.flattened(files.strict_json(c))]), "c_custkey long, found array<array<string>>")
    return found.select("c_custkey", F.explode("found").alias("f")).select("c_custkey", F.get("f", F.lit(0)).alias("location"), F.get("f", F.lit(1)).alias("value"))


@query("SELECT DISTINCT p_brand AS model, 'gone_' || p_brand AS current, 'come_' || p_brand AS future FROM part WHERE p_brand <> 'Brand#12'")
def d13_schema_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames inferred from schema files: exactly one column gone and one come; a model with two come has none."""

    def claims(brand, extra):
        name = brand.replace("#", "_")
        side = lambda *columns: {"models": [{"name": name, "columns": [{"name": c} for c in ("id", *columns)]}]}
        changes = files.schema_changes(side(f"gone_{brand}"), side(f"come_{brand}", *(["more"] if extra else [])))
        return brand, [[a, b] for _, a, b in files.rename_claims(changes)]

    own = reg.fields(spark, sf_dir).select("dataset_urn").distinct().select("dataset_urn", F.col("dataset_urn") == "Brand#12")
    found = files.each(own, claims, "model string, claims array<array<string>>")
    return found.select("model", F.explode("claims").alias("c")).select("model", F.get("c", F.lit(0)).alias("current"), F.get("c", F.lit(1)).alias("future"))
