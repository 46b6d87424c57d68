"""Queries of snapshots: secrets in nested values, context by category, evidence, and certification of stages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch
from ..operators import certify, graph, snapshots
from ..sources import registry as reg
from .catalog import DEPTHS, EDGES, GROUPS, LINKS, ROOT, query

_BEARER = "'authorization : Bearer ' || c_custkey"


@query(f"""WITH k AS (SELECT c_custkey AS id, c_custkey % 12 AS s, c_custkey % 4 AS n FROM customer)
SELECT id, x.location, x.why FROM (SELECT id, unnest(CASE s WHEN 0 THEN [{{'location': '$.a.b[' || n || '].db_password', 'why': 'NAME'}}] WHEN 1 THEN [{{'location': '$.name', 'why': 'NAME'}}] WHEN 2 THEN [{{'location': '$.list[' || n || ']', 'why': 'TEXT'}}]
  WHEN 4 THEN [{{'location': '$[0][0][0].token_' || id, 'why': 'NAME'}}] WHEN 5 THEN [{{'location': '$', 'why': 'MALFORMED'}}, {{'location': '$', 'why': 'TEXT'}}] WHEN 7 THEN [{{'location': '$.secret', 'why': 'NAME'}}, {{'location': '$.secret.api_key', 'why': 'NAME'}}]
  WHEN 8 THEN [{{'location': '$', 'why': 'TEXT'}}] WHEN 10 THEN [{{'location': '$', 'why': 'MALFORMED'}}] ELSE [] END) AS x FROM k)""")
def c24_nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in customers' nested values: twelve shapes, malformed, empty and missing ones among them."""
    k, n = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 4).cast("int")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    listed = lambda last: F.array_join(F.concat(F.array_repeat(quoted("c_name"), n), F.array(last)), ", ")
    bearer = F.concat(F.lit('"authorization : Bearer '), k, F.lit('"'))
    shapes = [
        F.concat(F.lit('{"a": {"b": ['), listed(F.lit('{"db_password": "x"}')), F.lit("]}}")), F.concat(F.lit('{"name": "api_key", "value": '), k, F.lit("}")), F.concat(F.lit('{"list": ['), listed(bearer), F.lit("]}")),
        F.concat(F.lit('{"tokens": '), quoted("c_mktsegment"), F.lit("}")), F.concat(F.lit('[[[{"token_'), k, F.lit('": null}]]]')), F.concat(F.col("c_name"), F.lit(" authorization = bearer "), k), F.concat(F.lit('{"owner": {"name": '), quoted("c_name"), F.lit("}}")),
        F.concat(F.lit('{"secret": {"api_key": ['), k, F.lit('], "x": {}}, "y": []}')), bearer, F.concat(F.lit('{"a": '), F.col("c_acctbal").cast("string"), F.lit(', "b": [true, null]}')), F.lit(""), F.lit(None).cast("string"),
    ]
    own = reg.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(F.array(*shapes), (F.col("c_custkey") % 12).cast("int")).alias("json"))
    return snapshots.secret_places(own, "id")


_CONTEXT = """of_part AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem),
ctx AS (SELECT DISTINCT 'owner' AS category, p_brand AS dataset_urn, 'nation:' || s_nationkey AS target_key, s_nationkey % 5 <> 0 AS resolved, '{"kind":"' || CASE s_nationkey % 2 WHEN 0 THEN 'TECHNICAL' ELSE 'BUSINESS' END || '"}' AS attributes FROM of_part JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  UNION SELECT 'domain', p_brand, 'domain:' || p_type, true, '{}' FROM part UNION SELECT 'tag', p_brand, 'tag:' || (p_size // 10), p_size % 10 < 5, '{"size_class":' || (p_size // 10) || '}' FROM part
  UNION SELECT 'structured_property', p_brand, 'prop:' || (p_partkey % 9), p_size < 25, '{"many":' || (p_partkey % 9 > 4) || ',"value":' || (p_partkey % 9) || '}' FROM part UNION SELECT 'data_product', p_brand, 'product:' || p_type, false, '{}' FROM part
  UNION SELECT 'pipeline', p_brand, 'job:' || l_suppkey, true, '{}' FROM of_part JOIN part ON p_partkey = l_partkey UNION SELECT 'bi', p_brand, 'dashboard:' || o_orderpriority, o_orderpriority <> '5-LOW', '{}' FROM of_part JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
kept AS (SELECT category, dataset_urn, target_key, min((CASE WHEN resolved THEN 'RESOLVED' ELSE 'UNRESOLVED' END, attributes)) AS m FROM ctx GROUP BY 1, 2, 3)"""


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = reg.table(spark, sf_dir, "part")
    lines = reg.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct().join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    nations = lines.join(reg.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = lines.join(reg.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))

    def rows(df: DataFrame, target: str, key, resolved, **attributes) -> DataFrame:
        return df.select(F.col("p_brand").alias("dataset_urn"), F.concat(F.lit(target), key.cast("string")).alias("target_key"), resolved.alias("resolved"), *[v.alias(k) for k, v in attributes.items()]).distinct()

    size, ninth = F.floor(F.col("p_size") / 10), F.col("p_partkey") % 9
    return snapshots.context_rows(part.select(F.col("p_brand").alias("dataset_urn")), {
        "owner": rows(nations, "nation:", F.col("s_nationkey"), F.col("s_nationkey") % 5 != 0, kind=F.when(F.col("s_nationkey") % 2 == 0, "TECHNICAL").otherwise("BUSINESS")), "domain": rows(part, "domain:", F.col("p_type"), F.lit(True)),
        "tag": rows(part, "tag:", size, F.col("p_size") % 10 < 5, size_class=size), "structured_property": rows(part, "prop:", ninth, F.col("p_size") < 25, value=ninth, many=ninth > 4), "data_product": rows(part, "product:", F.col("p_type"), F.lit(False)),
        "pipeline": rows(lines, "job:", F.col("l_suppkey"), F.lit(True)), "bi": rows(orders, "dashboard:", F.col("o_orderpriority"), F.col("o_orderpriority") != "5-LOW"), "document": spark.createDataFrame([], "dataset_urn string, target_key string, resolved boolean"),
    })


@query(f"WITH {_CONTEXT} SELECT category, dataset_urn, target_key, m[1] AS state, m[2] AS attributes FROM kept")
def p04_context_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of all datasets in one table, each category's attributes in one variant column."""
    return _context(spark, sf_dir)[0].withColumn("attributes", F.to_json("attributes"))


_ALL = ", ".join(f"('{c}')" for c in snapshots.CATEGORIES)


@query(f"""WITH {_CONTEXT}, n AS (SELECT dataset_urn, category, count(*) AS n, count(*) FILTER (WHERE m[1] = 'RESOLVED') AS r FROM kept GROUP BY 1, 2)
SELECT d.dataset_urn, c.category, CASE WHEN c.category = 'glossary' THEN 'NOT_RETRIEVED' WHEN n.n IS NULL THEN 'EMPTY' WHEN r = n.n THEN 'RESOLVED' WHEN r > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS state, coalesce(n.n, 0) AS n_targets
FROM (SELECT DISTINCT p_brand AS dataset_urn FROM part) d CROSS JOIN (VALUES {_ALL}) AS c(category) LEFT JOIN n USING (dataset_urn, category)""")
def p03_context_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each dataset in each of the nine categories."""
    return _context(spark, sf_dir)[1]


@query("""WITH i AS (SELECT p_brand AS d, 'job:' || l_suppkey AS t, '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' AS a, l_shipdate AS seen FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'evidence-' || substr(sha256(concat_ws(chr(31), 'VERIFIED', '1.5', d, 'scan', 'pipeline', d, t, '["' || d || '","' || t || '"]', a)), 1, 20) AS evidence_id, d AS subject_key, t AS target_urn, a AS attributes, min(seen)::VARCHAR AS observed_at, count(*) AS n_seen FROM i GROUP BY d, t, a""")
def p05_evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines say of datasets and jobs as evidence, addressed by content: each different item once, with when it was first seen and how often."""
    own = reg.table(spark, sf_dir, "lineitem").join(reg.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    job, text = F.concat(F.lit("job:"), F.col("l_suppkey").cast("string")), lambda x: F.lit(x)
    items = own.select(
        text("VERIFIED").alias("classification"), text("1.5").alias("source_phase"), F.col("p_brand").alias("subject_key"), text("scan").alias("interface"), text("pipeline").alias("aspect"), F.col("p_brand").alias("source_urn"), job.alias("target_urn"),
        F.array("p_brand", job).alias("relationship_path"), F.parse_json(F.to_json(F.struct(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")))).alias("attributes"), F.col("l_shipdate").cast("string").alias("observed_at"),
    )
    return snapshots.evidence_registry(items).select("evidence_id", "subject_key", "target_urn", F.to_json("attributes").alias("attributes"), "observed_at", "n_seen")


def _tampered(groups: DataFrame) -> DataFrame:
    """The groups as a stage that was written and then changed: some lost, some altered, some twice."""
    k = F.col("group_id")
    own = groups.where(k % 89 != 0).withColumn("confidence", F.when(k % 97 == 0, F.lit(9.5)).otherwise(F.col("confidence")))
    return own.unionByName(own.where(k % 83 == 0))


@query(f"""WITH {GROUPS}, s AS (SELECT g AS k, g % 89 = 0 AS lost, g % 97 = 0 AS altered, g % 83 = 0 AS twice FROM groups)
SELECT k AS group_id, 'DERIVED' AS side, 1::BIGINT AS n FROM s WHERE lost OR altered UNION ALL SELECT k, 'STORED', CASE WHEN altered AND twice THEN 2 ELSE 1 END FROM s WHERE NOT lost AND (altered OR twice)""")
def o02_stage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored stage of mapping groups held against its derivation: digests of buckets first, rows of differing buckets after."""
    with Scratch(spark) as scratch:
        derived = scratch.keep(reg.mapping_groups(spark, sf_dir), "derived")
        stored = scratch.keep(_tampered(derived), "stored")
        return scratch.result(snapshots.stage_differences(stored, derived, ["group_id"]))


@query(f"""WITH {EDGES}, {GROUPS}, {LINKS} SELECT 0 AS position, 'fields' AS stage, (SELECT count(*) FROM part) AS n_rows, 'SAME' AS state UNION ALL SELECT 1, 'edges', (SELECT count(*) FROM edges), 'SAME'
UNION ALL SELECT 2, 'mapping_groups', (SELECT count(*) + count(*) FILTER (WHERE g % 83 = 0) FROM groups WHERE g % 89 <> 0), CASE WHEN (SELECT count(*) FROM groups WHERE g % 89 = 0 OR g % 97 = 0 OR g % 83 = 0) > 0 THEN 'CHANGED' ELSE 'SAME' END
UNION ALL SELECT 3, 'relationships', (SELECT count(*) FROM links), CASE WHEN (SELECT count(*) FROM groups WHERE g % 89 = 0 OR g % 97 = 0 OR g % 83 = 0) > 0 THEN 'AFTER_A_CHANGE' ELSE 'SAME' END""")
def o04_certified_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a snapshot as a chain of fingerprints held against the certified one: the stage that changed, and those behind it.  Stages that both
    chains share are derived and fingerprinted once."""
    with Scratch(spark) as scratch:
        groups, edges, own = scratch.keep(reg.mapping_groups(spark, sf_dir), "groups"), scratch.keep(reg.lineage_edges(spark, sf_dir), "edges"), snapshots.stage_fingerprint
        shared = own(0, "fields", reg.fields(spark, sf_dir)).unionByName(own(1, "edges", edges)).unionByName(own(3, "relationships", reg.relationships(spark, sf_dir)))
        shared = scratch.keep(shared, "shared")
        certified, found = (scratch.keep(snapshots.fingerprint_chain(shared.unionByName(own(2, "mapping_groups", g))), "chain") for g in (groups, _tampered(groups)))
        return scratch.result(snapshots.broken_links(certified, found).join(found.select("position", "n_rows"), "position").select("position", "stage", "n_rows", "state"))


_CHECKS = (
    ("source field exists once", "0 failing", "SELECT count(*) FROM (SELECT node, (SELECT count(*) FROM part WHERE p_partkey = node) AS n FROM root) WHERE n <> 1"),
    ("source dataset exists", "0 dangling", "SELECT count(*) FROM root WHERE node NOT IN (SELECT p_partkey FROM part)"), ("dataset names are not empty", "0 failing", "SELECT count(*) FROM part WHERE coalesce(p_brand, '') = ''"),
    ("field types are not empty", "0 failing", "SELECT count(*) FROM part WHERE coalesce(p_type, '') = ''"), ("schema positions are unique", "0 repeated", "SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_brand, p_partkey HAVING count(*) > 1)"),
    ("every dataset has a context state", "0 dangling", "SELECT count(*) FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT source_key FROM links WHERE source_key IS NOT NULL)"),
    ("parents of reached fields are known", "0 dangling", "SELECT count(*) FROM depths WHERE node NOT IN (SELECT p_partkey FROM part)"), ("reached fields are unique", "0 repeated", "SELECT count(*) FROM (SELECT 1 FROM depths GROUP BY node HAVING count(*) > 1)"),
    ("upstream ends of groups are known", "0 dangling", "SELECT count(DISTINCT x) FROM (SELECT unnest(u) AS x FROM groups) WHERE x NOT IN (SELECT p_partkey FROM part)"), ("downstream ends of groups are known", "0 dangling", "SELECT count(DISTINCT x) FROM (SELECT unnest(d) AS x FROM groups) WHERE x NOT IN (SELECT p_partkey FROM part)"),
    ("group ids are unique", "0 repeated", "SELECT count(*) FROM (SELECT 1 FROM groups GROUP BY g HAVING count(*) > 1)"), ("confidences are shares", "0 failing", "SELECT count(*) FROM groups WHERE NOT coalesce(confidence BETWEEN 0 AND 1, true)"),
    ("relationships are unique", "0 repeated", "SELECT count(*) FROM (SELECT 1 FROM links GROUP BY category, source_key, field_node, target_key HAVING count(*) > 1)"), ("relationships start at datasets", "0 dangling", "SELECT count(DISTINCT source_key) FROM links WHERE source_key IS NOT NULL AND source_key NOT IN (SELECT p_brand FROM part)"),
    ("relationships start at fields", "0 dangling", "SELECT count(DISTINCT field_node) FROM links WHERE field_node IS NOT NULL AND field_node NOT IN (SELECT p_partkey FROM part)"), ("relationships have one start", "0 failing", "SELECT count(*) FROM links WHERE (source_key IS NULL) = (field_node IS NULL)"),
    ("no edge is a loop", "0 failing", "SELECT count(*) FROM edges WHERE src = dst"),
)
_COUNTS = (("groups as the orders declare", "(SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))", "(SELECT count(*) FROM groups)"), ("edges as the walk found", "(SELECT count(*) FROM edges JOIN depths ON node = src)", "(SELECT count(*) FROM edges)"), ("deepest field", "(SELECT max(depth) FROM depths)", "(SELECT max(depth) FROM depths)"))


@query(f"WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS}, {GROUPS}, {LINKS}, c AS (" + " UNION ALL ".join(f"SELECT '{name}' AS name, '{want}' AS expected, ({sql}) AS n" for name, want, sql in _CHECKS) + f"""), k AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, {want}::VARCHAR AS expected, {got}::VARCHAR AS observed" for name, want, got in _COUNTS)})
SELECT name, n = 0 AS passed, expected, n::VARCHAR AS observed FROM c UNION ALL SELECT name, expected = observed, expected, observed FROM k""")
def o01_snapshot_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty more invariants of a snapshot: its source, its schema, ends and ids of all registries, declared counts, depth."""
    with Scratch(spark) as scratch:
        f, edges = scratch.keep(reg.fields(spark, sf_dir), "fields"), scratch.keep(reg.lineage_edges(spark, sf_dir), "edges")
        groups, links, root = scratch.keep(reg.mapping_groups(spark, sf_dir), "groups"), scratch.keep(reg.relationships(spark, sf_dir), "links"), reg.first_node(edges)
        depths = graph.depths(edges, root)
        key = f.select(F.col("node"))
        lines = reg.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
        declared = certify.holders("o_orderkey", reg.table(spark, sf_dir, "orders"), lines).agg(F.count_if(F.col("held") == 3).alias("n"))
        walked = edges.join(depths.select(F.col("node").alias("src")), "src", "left_semi").agg(F.count("*").alias("n"))
        deepest = depths.agg(F.max("depth").alias("v"))
        of_root = root.join(f.groupBy("node").agg(F.count("*").alias("n")), "node", "left")
        filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
        ends = {
            "source dataset exists": root, "parents of reached fields are known": depths.select("node"), "upstream ends of groups are known": certify.elements(groups, "upstream"),
            "downstream ends of groups are known": certify.elements(groups, "downstream"), "relationships start at fields": links.select("field_node"),
        }
        starts = links.where("source_key IS NOT NULL").select(F.col("source_key").alias("dataset_urn"))
        return scratch.result(certify.report(
            certify.every(of_root, F.col("n") == 1, "source field exists once"), certify.every(f, filled("dataset_urn"), "dataset names are not empty"), certify.every(f, filled("native_type"), "field types are not empty"),
            certify.unique(f, ["dataset_urn", "field_path"], "schema positions are unique"), certify.references(f, "dataset_urn", starts, "dataset_urn", "every dataset has a context state"),
            certify.unique(depths, ["node"], "reached fields are unique"), certify.references_of(key, "node", ends),
            certify.unique(groups, ["group_id"], "group ids are unique"), certify.every(groups, F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidences are shares"), certify.unique(links, ["category", "source_key", "field_node", "target_key"], "relationships are unique"),
            certify.references(links, "source_key", f.select(F.col("dataset_urn").alias("source_key")), "source_key", "relationships start at datasets"),
            certify.every(links, F.col("source_key").isNull() != F.col("field_node").isNull(), "relationships have one start"), certify.every(edges, F.col("src") != F.col("dst"), "no edge is a loop"),
            certify.counted(groups, declared, "groups as the orders declare"), certify.counted(edges, walked, "edges as the walk found"), certify.value_is(depths.agg(F.max("depth").alias("d")), "d", deepest, "deepest field"),
        ))
