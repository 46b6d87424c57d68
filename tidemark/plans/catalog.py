"""The registered queries of the lineage engine, and their SQL, by the operator each shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.store import Scratch, materialize
from ..operators import certify, changes, components, context, graph, repair, resolve, rules, sqlmodel
from ..sources import files
from ..sources import registry as reg
from . import structural

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Parts that many of the SQL texts share.
EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
ROOT = "root AS (SELECT min(src) AS node FROM edges)"
DEPTHS = """walk(node, depth) AS (SELECT node, 0 FROM root UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 12),
depths AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""
PATHS = """paths(target, nodes, hops) AS (SELECT node, [node], 0 FROM root UNION ALL SELECT e.dst, list_append(p.nodes, e.dst), p.hops + 1 FROM paths p JOIN edges e ON e.src = p.target WHERE p.hops < 3 AND NOT list_contains(p.nodes, e.dst))"""


def _best(may_lead: str = "true", levels: int = 8) -> str:
    """The shortest, then smallest path to each node, a level at a time."""
    parts = ["b0 AS (SELECT node, [node] AS path FROM root)", "s0 AS (SELECT node FROM root)"]
    for k in range(1, levels + 1):
        parts.append(f"b{k} AS (SELECT e.dst AS node, min(list_append(b.path, e.dst)) AS path FROM b{k - 1} b JOIN edges e ON e.src = b.node WHERE ({may_lead if k > 1 else 'true'}) AND e.dst NOT IN (SELECT node FROM s{k - 1}) GROUP BY e.dst)")
        parts.append(f"s{k} AS (SELECT node FROM s{k - 1} UNION ALL SELECT node FROM b{k})")
    parts.append("best AS (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(levels + 1)) + ")")
    return ", ".join(parts)


LISTED = PATHS + """, after_ AS (SELECT DISTINCT e.dst AS node FROM paths p JOIN edges e ON e.src = p.target WHERE p.hops = 3 AND NOT list_contains(p.nodes, e.dst)),
closure_(node) AS (SELECT node FROM after_ UNION SELECT e.dst FROM closure_ c JOIN edges e ON e.src = c.node), cut AS (SELECT node FROM closure_ WHERE node NOT IN (SELECT node FROM root)), """ + _best() + """,
listed AS (SELECT target, nodes, hops FROM paths WHERE hops > 0 UNION ALL SELECT node, path, len(path) - 1 FROM best WHERE len(path) > 4)"""
GROUPS = """sides AS (SELECT l_orderkey AS g, list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 2 = 1)) AS u, list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 2 = 0)) AS d FROM lineitem GROUP BY 1),
groups AS (SELECT g, coalesce(u, []) AS u, coalesce(d, []) AS d,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'identity' WHEN '2-HIGH' THEN 'copy_column' WHEN '3-MEDIUM' THEN 'sum' WHEN '4-NOT SPECIFIED' THEN '' WHEN '5-LOW' THEN 'cast' END AS op,
  CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 WHEN 'P' THEN 1.5 END AS confidence FROM sides JOIN orders ON o_orderkey = g),
stated AS (SELECT *, CASE WHEN len(u) < 1 OR len(d) < 1 OR NOT coalesce(confidence BETWEEN 0 AND 1, true) THEN 'MALFORMED' WHEN len(u) > 1 AND len(d) > 1 THEN 'AMBIGUOUS' ELSE 'EXPANDED' END AS state,
  CASE WHEN len(u) > 1 AND len(d) = 1 THEN 'DERIVED' WHEN coalesce(trim(op), '') = '' THEN 'UNKNOWN' WHEN op IN ('none', 'identity', 'noop', 'no_op') OR starts_with(op, 'copy') THEN 'DIRECT' ELSE 'DERIVED' END AS class FROM groups)"""
LINKS = """of_part AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
links AS (
  SELECT 'owner' AS category, p_brand AS source_key, NULL::BIGINT AS field_node, 'nation:' || s_nationkey AS target_key, 'RESOLVED' AS state FROM of_part JOIN supplier ON s_suppkey = l_suppkey
  UNION SELECT 'pipeline', NULL, l_partkey, 'job:' || l_suppkey, 'RESOLVED' FROM of_part
  UNION SELECT 'bi', p_brand, NULL, 'dashboard:' || o_orderpriority, 'RESOLVED' FROM of_part JOIN orders ON o_orderkey = l_orderkey
  UNION SELECT 'tag', NULL, p_partkey, 'tag:' || (p_size // 10), CASE WHEN p_size > 45 THEN 'UNRESOLVED' ELSE 'RESOLVED' END FROM part)"""
MAPPINGS = LINKS + """,
mappings AS (
  SELECT p_partkey AS node, p_brand AS dataset_urn, category, target_key, state, 'dataset' AS anchor FROM part JOIN links ON source_key = p_brand
  UNION ALL SELECT p_partkey, p_brand, category, target_key, state, 'field' FROM part JOIN links ON field_node = p_partkey AND source_key IS NULL)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _graph(spark, sf_dir):
    edges = materialize(reg.lineage_edges(spark, sf_dir), "edges")
    return edges, reg.first_node(edges)


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _cut_by_hops(found: DataFrame, cut: DataFrame) -> DataFrame:
    return found.join(cut.withColumn("_cut", F.lit(True)), "target", "left").withColumn("paths_truncated", F.coalesce("_cut", F.lit(False))).drop("_cut")


# --- scans and identity -------------------------------------------------------------------------------------------------------------------


@query("SELECT 'urn:li:dataset:(urn:li:dataPlatform:' || lower(p_type) || ',' || p_brand || ',PROD)' AS urn, count(*) AS n_fields FROM part WHERE contains(lower(p_brand), '2') GROUP BY p_type, p_brand")
def a05_dataset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets whose name contains a text; the filter works on the scan's own columns."""
    part = reg.table(spark, sf_dir, "part").where(F.contains(F.lower("p_brand"), F.lit("2")))
    return part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n_fields")).select(ids.dataset_urn(F.lower("p_type"), F.col("p_brand"), F.lit("PROD")).alias("urn"), "n_fields")


@query("SELECT lower(p_type) AS platform, p_brand AS name, 'PROD' AS environment, count(*) AS n_fields FROM part GROUP BY ALL")
def a06_urn_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URN's parts, parsed back from its text."""
    urns = reg.table(spark, sf_dir, "part").select(ids.dataset_urn(F.lower("p_type"), F.col("p_brand"), F.lit("PROD")).alias("urn"))
    return urns.groupBy(*[ids.urn_part(F.col("urn"), p).alias(p) for p in ("platform", "name", "environment")]).agg(F.count("*").alias("n_fields"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS n_downstream, min(dst) AS first_downstream, max(dst) AS last_downstream FROM edges GROUP BY src")
def a10_direct_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct downstream entities of every field, each once."""
    return reg.lineage_edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_downstream"), F.min("dst").alias("first_downstream"), F.max("dst").alias("last_downstream"))


@query("""WITH known AS (SELECT DISTINCT l_partkey AS node FROM lineitem), req AS (SELECT p_partkey AS node FROM part UNION SELECT p_partkey + 1000000000 FROM part)
SELECT CASE WHEN k.node IS NOT NULL THEN 'exists' ELSE 'missing' END AS state, count(*) AS n FROM req LEFT JOIN known k USING (node) GROUP BY 1""")
def a12_field_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence test of field entities."""
    part = reg.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    req = part.unionByName(part.select((F.col("node") + 1_000_000_000).alias("node"))).distinct()
    known = reg.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node")).distinct().withColumn("hit", F.lit(1))
    return req.join(known, "node", "left").groupBy(F.when(F.col("hit").isNotNull(), "exists").otherwise("missing").alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS subject, 'nation:' || s_nationkey AS reference, coalesce(n_name, NULL) AS name, CASE WHEN n_name IS NULL THEN 'unresolved' ELSE 'present' END AS state
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 0""")
def a14_dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the names they lead to; one without is unresolved, not lost."""
    names = reg.table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    own = reg.table(spark, sf_dir, "supplier").join(names, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return own.select(F.col("s_suppkey").alias("subject"), F.concat(F.lit("nation:"), F.col("s_nationkey")).alias("reference"), F.col("n_name").alias("name"), F.when(F.col("n_name").isNull(), "unresolved").otherwise("present").alias("state"))


@query("""WITH observed AS (SELECT lower(p_name) AS k, count(*) AS n FROM part GROUP BY 1),
req AS (SELECT DISTINCT 'r:' || p_name AS request_id, upper(p_name) AS name FROM part UNION SELECT 'c:' || c_mktsegment, c_mktsegment FROM customer UNION SELECT 'e:' || event_type, ' ' || event_type FROM events)
SELECT request_id, name, coalesce(n, 0) AS n_matches, CASE WHEN trim(name) = '' OR trim(name) <> name THEN 'INVALID' WHEN n IS NULL THEN 'NOT_FOUND' WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS resolution
FROM req LEFT JOIN observed ON k = lower(name)""")
def c01_resolve_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested names against observed ones, case aside: resolved, not found, ambiguous or invalid."""
    part, customer, events = (reg.table(spark, sf_dir, t) for t in ("part", "customer", "events"))
    req = part.select(F.concat(F.lit("r:"), F.col("p_name")).alias("request_id"), F.upper("p_name").alias("name"))
    req = req.unionByName(customer.select(F.concat(F.lit("c:"), F.col("c_mktsegment")).alias("request_id"), F.col("c_mktsegment").alias("name")))
    req = req.unionByName(events.select(F.concat(F.lit("e:"), F.col("event_type")).alias("request_id"), F.concat(F.lit(" "), F.col("event_type")).alias("name"))).distinct()
    return resolve.resolve(req, part.select(F.col("p_name").alias("name")), ["name"], "request_id")


@query("""SELECT c_custkey, a.attribute, a.requested, a.observed, coalesce(lower(a.requested) = lower(a.observed), false) AS matches FROM (
SELECT c_custkey, unnest([{'attribute': 'segment', 'requested': c_mktsegment, 'observed': upper(c_mktsegment)}, {'attribute': 'nation', 'requested': c_nationkey::VARCHAR, 'observed': n_name}]) AS a FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)""")
def c04_match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested and observed values, attribute by attribute."""
    own = reg.table(spark, sf_dir, "customer").join(reg.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("seen", F.upper("c_mktsegment"))
    return resolve.match_evidence(own, [("segment", "c_mktsegment", "seen"), ("nation", "c_nationkey", "n_name")], "c_custkey")


@query("""SELECT coalesce(CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'name' WHEN n > 1 THEN 'unique_path' WHEN p_size <= 10 THEN 'size' WHEN p_retailprice < 950 THEN 'price' END, 'valid') AS first_failure, count(*) AS n_fields
FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM part) GROUP BY 1""")
def c05_schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered checks of fields, the first failure wins; uniqueness by counts joined back, not by a window over a dataset's rows."""
    part = reg.table(spark, sf_dir, "part")
    counts = part.groupBy(F.col("p_brand").alias("b"), F.col("p_name").alias("k")).agg(F.count("*").alias("n"))
    own = part.join(counts, F.col("p_brand").eqNullSafe(F.col("b")) & F.col("p_name").eqNullSafe(F.col("k")))
    failure = resolve.first_failure([("name", F.trim("p_name") != ""), ("unique_path", F.col("n") <= 1), ("size", F.col("p_size") > 10), ("price", F.col("p_retailprice") >= 950)])
    return own.groupBy(F.coalesce(failure, F.lit("valid")).alias("first_failure")).agg(F.count("*").alias("n_fields"))


@query("""WITH ref AS (SELECT DISTINCT l_partkey AS node FROM lineitem UNION SELECT p_partkey * 3 FROM part), schema_ AS (SELECT p_partkey AS node FROM part WHERE p_size > 10)
SELECT CASE WHEN s.node IS NOT NULL THEN 'SCHEMA_MEMBER' WHEN p.p_partkey IS NOT NULL THEN 'SCHEMA_FIELD_ENTITY' ELSE 'UNRESOLVED' END AS reference, count(*) AS n
FROM ref r LEFT JOIN schema_ s ON s.node = r.node LEFT JOIN part p ON p.p_partkey = r.node GROUP BY 1""")
def c09_reference_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where references are verified: in a schema, as an entity, or nowhere."""
    part = reg.table(spark, sf_dir, "part")
    refs = reg.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node")).unionByName(part.select((F.col("p_partkey") * 3).alias("node"))).distinct()
    found = resolve.reference_ladder(refs, part.where("p_size > 10").select(F.col("p_partkey").alias("node")), part.select(F.col("p_partkey").alias("node")), "node")
    return found.groupBy("reference").agg(F.count("*").alias("n"))


# --- graph --------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS} SELECT node, depth, p_brand AS dataset_urn FROM depths JOIN part ON p_partkey = node")
def e06_reach_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that a change of the first part reaches, with its least depth and dataset."""
    edges, root = _graph(spark, sf_dir)
    found = graph.depths(edges, root)
    return found.join(reg.fields(spark, sf_dir).select("node", "dataset_urn"), "node").select("node", F.col("depth").cast("int").alias("depth"), "dataset_urn")


@query(f"WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS} SELECT e.src, count(*) AS n_edges, sum(CASE WHEN b.depth <= a.depth THEN 1 ELSE 0 END)::BIGINT AS n_back FROM edges e JOIN depths a ON a.node = e.src JOIN depths b ON b.node = e.dst GROUP BY e.src")
def e11_reachable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave reachable fields, and how many of them lead back to a field no deeper."""
    edges, root = _graph(spark, sf_dir)
    d = graph.depths(edges, root)
    a, b = d.select(F.col("node").alias("src"), F.col("depth").alias("da")), d.select(F.col("node").alias("dst"), F.col("depth").alias("db"))
    return edges.join(a, "src").join(b, "dst").groupBy("src").agg(F.count("*").alias("n_edges"), F.sum(F.when(F.col("db") <= F.col("da"), 1).otherwise(0)).alias("n_back"))


@query(f"""WITH RECURSIVE {EDGES}, {ROOT}, {LISTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY nodes) AS r, count(*) OVER (PARTITION BY target) AS c FROM listed)
SELECT target, array_to_string(nodes, ',') AS nodes, hops, c AS path_count, c > 128 OR target IN (SELECT node FROM cut) AS paths_truncated FROM ranked WHERE r <= 128""")
def e07_capped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of up to three hops, at most 128 for each target, in order of their nodes; targets beyond have their shortest path, and
    the mark is also set where longer paths may lead to a target."""
    edges, root = _graph(spark, sf_dir)
    paths, cut = graph.marked_paths(edges, root, 3)
    found = _cut_by_hops(graph.capped_paths(paths).withColumnRenamed("paths_truncated", "capped"), cut).withColumn("paths_truncated", F.col("capped") | F.col("paths_truncated"))
    return found.select("target", _joined("nodes").alias("nodes"), "hops", "path_count", "paths_truncated")


@query(f"""WITH RECURSIVE {EDGES}, {ROOT}, {LISTED}
SELECT target, min(hops) AS depth, count(*) AS path_count, count(DISTINCT nodes[len(nodes) - 1]) AS incoming, CASE WHEN count(*) > 1 THEN 'multipath' WHEN min(hops) = 1 THEN 'direct' ELSE 'transitive' END AS exposure, target IN (SELECT node FROM cut) AS paths_truncated FROM listed GROUP BY target""")
def e19_path_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reachable target with its depth, and the path count, incoming fields and exposure state of its paths of up to three hops (of the
    shortest path beyond); paths_truncated where longer paths may lead to it."""
    edges, root = _graph(spark, sf_dir)
    paths, cut = graph.marked_paths(edges, root, 3)
    return _cut_by_hops(graph.path_exposure(paths), cut)


@query(f"""WITH {GROUPS} SELECT state, class AS classification, count(*) AS n_groups, sum(CASE WHEN state = 'EXPANDED' THEN len(u) * len(d) ELSE 0 END)::BIGINT AS n_edges FROM stated GROUP BY 1, 2""")
def e03_group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyper-edges by state and class; only one-sided ones count edges."""
    g = reg.mapping_groups(spark, sf_dir)
    state, size = graph.group_state(F.col("upstream"), F.col("downstream"), F.col("confidence")), F.size("upstream") * F.size("downstream")
    own = g.select(state.alias("state"), graph.classification(F.col("upstream"), F.col("downstream"), F.col("operation")).alias("classification"), size.alias("size"))
    return own.groupBy("state", "classification").agg(F.count("*").alias("n_groups"), F.sum(F.when(F.col("state") == "EXPANDED", F.col("size")).otherwise(0)).alias("n_edges"))


@query(f"""WITH {GROUPS}, ex AS (SELECT g, src, unnest(d) AS dst, class, op, confidence FROM (SELECT *, unnest(u) AS src FROM stated WHERE state = 'EXPANDED'))
SELECT src, dst, array_to_string(list_sort(list(DISTINCT g)), ',') AS group_ids, coalesce(array_to_string(list_sort(list(DISTINCT op) FILTER (WHERE op <> '')), ','), '') AS operations,
  CASE WHEN count(DISTINCT class) FILTER (WHERE class <> 'UNKNOWN') = 1 THEN min(class) FILTER (WHERE class <> 'UNKNOWN') ELSE 'UNKNOWN' END AS classification, count(DISTINCT class) FILTER (WHERE class <> 'UNKNOWN') > 1 AS conflict FROM ex GROUP BY src, dst""")
def e04_consolidated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from all expanded groups, one for each pair of fields."""
    e = graph.consolidate(graph.expand_groups(reg.mapping_groups(spark, sf_dir)))
    return e.select("src", "dst", _joined("group_ids").alias("group_ids"), F.array_join("operations", ",").alias("operations"), "classification", "conflict")


@query(f"""WITH {EDGES}, {ROOT}, {_best()}, back AS (SELECT path[list_position(path, e.dst):] AS l, e.src, e.dst FROM edges e JOIN best b ON b.node = e.src WHERE list_contains(b.path, e.dst))
SELECT array_to_string(l, ',') AS cycle, src, dst, len(l) AS n_edges FROM back""")
def e14_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles that edges close on the shortest paths from the root, of any length."""
    edges, root = _graph(spark, sf_dir)
    return components.closed_on_best_paths(edges, root).select(_joined("cycle").alias("cycle"), "src", "dst", F.size("cycle").cast("long").alias("n_edges"))


_CLOSURE = """reach(a, b) AS (SELECT src, dst FROM own UNION SELECT r.a, e.dst FROM reach r JOIN own e ON e.src = r.b),
nodes AS (SELECT src AS node FROM own UNION SELECT dst FROM own), both_ AS (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a),
component AS (SELECT node, least(node, coalesce(min(b), node)) AS component FROM nodes LEFT JOIN both_ ON a = node GROUP BY node)"""


@query(f"WITH RECURSIVE {EDGES}, own AS (SELECT * FROM edges), {_CLOSURE} SELECT node, component, count(*) OVER (PARTITION BY component) AS n_members FROM component")
def e14_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every field: fields that lead to each other, over the whole graph and without a bound on hops."""
    found = components.strong_components(materialize(reg.lineage_edges(spark, sf_dir), "edges"))
    return found.join(found.groupBy("component").agg(F.count("*").alias("n_members")), "component").select("node", "component", "n_members")


@query(f"""WITH RECURSIVE {EDGES}, own AS (SELECT e.src, e.dst FROM edges e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_brand = b.p_brand AND a.p_type = b.p_type), {_CLOSURE}
SELECT p_brand AS dataset_urn, p_type AS native_type, count(DISTINCT component) AS n_components, count(DISTINCT CASE WHEN n > 1 THEN component END) AS n_cyclic, max(n) AS largest
FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM component) JOIN part ON p_partkey = node GROUP BY 1, 2""")
def e14_dataset_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of each dataset's fields of one type: how many, how many with a cycle, the largest."""
    f, edges = reg.fields(spark, sf_dir).select("node", "dataset_urn", "native_type"), reg.lineage_edges(spark, sf_dir)
    a, b = f.toDF("src", "da", "ta"), f.toDF("dst", "db", "tb")
    found = components.strong_components(edges.join(a, "src").join(b, "dst").where("da = db AND ta = tb"))
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("n")), "component").join(f, "node")
    return sized.groupBy("dataset_urn", "native_type").agg(F.count_distinct("component").alias("n_components"), F.count_distinct(F.when(F.col("n") > 1, F.col("component"))).alias("n_cyclic"), F.max("n").alias("largest"))


@query("SELECT p_brand AS dataset_urn, array_to_string(list_sort(list(DISTINCT 'col_' || p_partkey)), ',') AS field_paths, count(*) AS n_fields FROM part GROUP BY 1")
def e15_dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dataset_index(reg.fields(spark, sf_dir)).select("dataset_urn", F.array_join("field_paths", ",").alias("field_paths"), "n_fields")


@query(f"""WITH {EDGES}, {ROOT}, opened AS (SELECT p_partkey AS node FROM part WHERE p_type <> 'PROMO'), {_best("b.node IN (SELECT node FROM opened)")}
SELECT node, array_to_string(path, ',') AS path FROM best""")
def e16_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest, then smallest path to each field; PROMO parts lead no further."""
    edges, root = _graph(spark, sf_dir)
    opened = reg.fields(spark, sf_dir).where("native_type <> 'PROMO'").select("node")
    return graph.best_paths(edges, root, opened).select("node", _joined("path").alias("path"))


@query(f"""WITH {EDGES}, fut AS (SELECT DISTINCT CASE WHEN src = 7 THEN -7 ELSE src END AS src, CASE WHEN dst = 7 THEN -7 ELSE dst END AS dst FROM edges)
SELECT CASE WHEN f.src IS NULL THEN 'REMOVED' WHEN e.src IS NULL THEN 'ADDED' ELSE 'UNCHANGED' END AS state, count(*) AS n FROM edges e FULL JOIN fut f ON e.src = f.src AND e.dst = f.dst GROUP BY 1""")
def e17_projected_graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after one field's key is renamed, against the present one."""
    edges, _ = _graph(spark, sf_dir)
    return graph.graph_diff(edges, graph.rebase(edges, ["src", "dst"], 7, -7)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES}, {GROUPS}, amb AS (SELECT DISTINCT src, unnest(d) AS dst FROM (SELECT d, unnest(u) AS src FROM stated WHERE state = 'AMBIGUOUS')),
l AS (SELECT src, dst, 0 AS r FROM edges UNION ALL SELECT dst, src, 1 FROM edges WHERE src > dst UNION ALL SELECT src, dst, 2 FROM amb), m AS (SELECT src, dst, min(r) AS r FROM l GROUP BY 1, 2)
SELECT CASE r WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'COUNTERFACTUAL' ELSE 'UNRESOLVED' END AS state, count(*) AS n FROM m GROUP BY 1""")
def e13_composite_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed, counterfactual and unresolved edges in one graph; earlier layers stand."""
    edges, _ = _graph(spark, sf_dir)
    g = reg.mapping_groups(spark, sf_dir).where(graph.group_state(F.col("upstream"), F.col("downstream"), F.col("confidence")) == "AMBIGUOUS")
    amb = g.select("downstream", F.explode("upstream").alias("src")).select("src", F.explode("downstream").alias("dst"))
    turned = edges.where("src > dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.composite(("OBSERVED", edges), ("COUNTERFACTUAL", turned), ("UNRESOLVED", amb)).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS group_key, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS action_id, lag(l_linenumber || '/' || l_partkey || '/' || l_suppkey) OVER w AS depends_on, row_number() OVER w AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def e25_chained_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action of a group waits for the one before it."""
    lines = reg.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_key"), "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("action_id", F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey"))
    return graph.chained(lines, "group_key", ["l_linenumber", "l_partkey", "l_suppkey"]).select("group_key", "action_id", "depends_on", "position")


# --- aggregations -------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS} SELECT count(*) FILTER (WHERE depth = 1) AS n_direct, count(*) FILTER (WHERE depth > 1) AS n_transitive, count(DISTINCT p_brand) AS n_datasets, max(depth) AS max_depth FROM depths JOIN part ON p_partkey = node WHERE depth > 0""")
def f01_propagation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = e06_reach_depths(spark, sf_dir).where("depth > 0")
    return d.agg(F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 1).alias("n_transitive"), F.count_distinct("dataset_urn").alias("n_datasets"), F.max("depth").alias("max_depth"))


_EDGE_STATES = """states AS (SELECT g, src, unnest(d) AS dst, CASE WHEN class = 'DIRECT' THEN 'CONDITIONAL' WHEN class = 'UNKNOWN' THEN 'UNKNOWN' WHEN op = 'sum' THEN 'INCOMPATIBLE' ELSE 'COMPATIBLE' END AS state FROM (SELECT *, unnest(u) AS src FROM stated WHERE state = 'EXPANDED'))"""


def _edge_states(spark, sf_dir):
    e = graph.expand_groups(reg.mapping_groups(spark, sf_dir))
    state = F.when(F.col("classification") == "DIRECT", "CONDITIONAL").when(F.col("classification") == "UNKNOWN", "UNKNOWN").when(F.col("operation") == "sum", "INCOMPATIBLE").otherwise("COMPATIBLE")
    return e.select("group_id", "src", "dst", state.alias("state"))


@query(f"""WITH {GROUPS}, {_EDGE_STATES}, p AS (SELECT g, dst, min(CASE state WHEN 'INCOMPATIBLE' THEN 1 WHEN 'UNKNOWN' THEN 2 WHEN 'CONDITIONAL' THEN 3 ELSE 4 END) AS k FROM states GROUP BY g, dst),
q AS (SELECT dst, ['INCOMPATIBLE', 'UNKNOWN', 'CONDITIONAL', 'COMPATIBLE'][k] AS s FROM p), f AS (SELECT dst AS node, CASE WHEN count(DISTINCT s) > 1 THEN 'UNKNOWN' ELSE min(s) END AS field_state FROM q GROUP BY dst)
SELECT p_brand AS dataset_urn, count(*) AS n_fields, count(*) FILTER (WHERE field_state = 'UNKNOWN') AS n_unknown, CASE WHEN count(DISTINCT field_state) > 1 THEN 'UNKNOWN' ELSE min(field_state) END AS dataset_state FROM f JOIN part ON p_partkey = node GROUP BY 1""")
def f03_compatibility_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to groups by the worst state, groups to fields and fields to datasets by agreement."""
    paths = _edge_states(spark, sf_dir).groupBy("group_id", "dst").agg(rules.worst("compatibility", F.col("state")).alias("s"))
    f = paths.groupBy(F.col("dst").alias("node")).agg(rules.single_or_unknown(F.col("s")).alias("field_state"))
    own = f.join(reg.fields(spark, sf_dir).select("node", "dataset_urn"), "node")
    return own.groupBy("dataset_urn").agg(F.count("*").alias("n_fields"), F.count_if(F.col("field_state") == "UNKNOWN").alias("n_unknown"), rules.single_or_unknown(F.col("field_state")).alias("dataset_state"))


@query(f"""WITH {GROUPS}, {_EDGE_STATES} SELECT p_brand AS dataset_urn, count(*) FILTER (WHERE state = 'INCOMPATIBLE') AS n_confirmed, count(*) FILTER (WHERE state = 'UNKNOWN') AS n_unresolved, count(*) FILTER (WHERE state = 'CONDITIONAL') AS n_potential, count(*) FILTER (WHERE state = 'COMPATIBLE') AS n_none,
['CONFIRMED', 'UNRESOLVED', 'POTENTIAL', 'NO_DEMONSTRATED'][min(CASE state WHEN 'INCOMPATIBLE' THEN 1 WHEN 'UNKNOWN' THEN 2 WHEN 'CONDITIONAL' THEN 3 ELSE 4 END)] AS impact,
['UNRESOLVED', 'CONDITIONAL', 'ESTABLISHED'][min(CASE state WHEN 'UNKNOWN' THEN 1 WHEN 'CONDITIONAL' THEN 2 ELSE 3 END)] AS certainty FROM states JOIN part ON p_partkey = dst GROUP BY 1""")
def f07_impact_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility as technical impact, the worst of each dataset, and the weakest certainty."""
    impact, certainty = rules.technical_impact(F.col("state"))
    own = _edge_states(spark, sf_dir).select(F.col("dst").alias("node"), impact.alias("impact"), certainty.alias("certainty")).join(reg.fields(spark, sf_dir).select("node", "dataset_urn"), "node")
    n = lambda s: F.count_if(F.col("impact") == s)
    return own.groupBy("dataset_urn").agg(n("CONFIRMED").alias("n_confirmed"), n("UNRESOLVED").alias("n_unresolved"), n("POTENTIAL").alias("n_potential"), n("NO_DEMONSTRATED").alias("n_none"), rules.worst("impact", F.col("impact")).alias("impact"), rules.worst("certainty", F.col("certainty")).alias("certainty"))


def _scope(scratch, spark, sf_dir):
    """Links and fields, written once for the plans that read them several times."""
    return scratch.keep(reg.relationships(spark, sf_dir), "links"), reg.fields(spark, sf_dir).select("node", "dataset_urn")


def _mappings(spark, sf_dir):
    return context.technical_mappings(reg.relationships(spark, sf_dir), reg.fields(spark, sf_dir))


@query(f"WITH {MAPPINGS} SELECT target_key, CASE WHEN count(DISTINCT category) > 1 THEN 'mixed' ELSE min(category) END AS category, count(DISTINCT dataset_urn) AS n_datasets, count(DISTINCT node) AS n_fields, max(CASE WHEN state = 'UNRESOLVED' THEN 1 ELSE 0 END) AS unresolved FROM mappings GROUP BY 1")
def f09_context_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.result(context.context_assets(*_scope(scratch, spark, sf_dir)))


@query(f"WITH {MAPPINGS} SELECT dataset_urn, count(DISTINCT target_key) FILTER (WHERE category = 'owner') AS n_owner, count(DISTINCT target_key) FILTER (WHERE category = 'pipeline') AS n_pipeline, count(DISTINCT target_key) FILTER (WHERE category = 'bi') AS n_bi, count(DISTINCT target_key) FILTER (WHERE category = 'tag') AS n_tag, count(DISTINCT target_key) AS n_assets, count(DISTINCT node) AS n_fields FROM mappings GROUP BY 1")
def f10_dataset_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.result(context.dataset_summaries(*_scope(scratch, spark, sf_dir)))


@query(f"WITH {MAPPINGS} SELECT p.p_partkey AS node, coalesce(array_to_string(list_sort(list(DISTINCT target_key) FILTER (WHERE target_key IS NOT NULL)), ','), '') AS assets FROM part p LEFT JOIN (SELECT * FROM mappings WHERE anchor = 'field' AND category = 'pipeline') m ON m.node = p.p_partkey GROUP BY 1")
def f11_reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipelines of every field; fields without one keep an empty list."""
    own = _mappings(spark, sf_dir).where("anchor = 'field' and category = 'pipeline'")
    return context.reverse_index(own, reg.fields(spark, sf_dir), "node").select("node", F.array_join("assets", ",").alias("assets"))


@query(f"WITH {MAPPINGS} SELECT dataset_urn, CASE WHEN bool_or(category = 'tag' AND target_key = 'tag:0') THEN 'SENSITIVE' WHEN bool_or(category = 'tag' AND state = 'UNRESOLVED') THEN 'UNRESOLVED' ELSE 'NONE' END AS sensitivity FROM mappings GROUP BY 1")
def j23_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sensitivity(_mappings(spark, sf_dir), "dataset_urn", "tag:0")


@query(f"WITH {LINKS} SELECT category, target_key, count(*) AS n FROM links WHERE EXISTS (SELECT 1 FROM region WHERE contains(source_key, r_regionkey::VARCHAR) OR contains(target_key, r_regionkey::VARCHAR)) GROUP BY 1, 2")
def d11_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose keys contain one of a few names."""
    names = reg.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("name"))
    return context.mentions(reg.relationships(spark, sf_dir), names, "name").groupBy("category", "target_key").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def f22_last_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each composite key, the last one by id."""
    e = reg.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return context.deduplicated(e, ["user_id", "event_type"], [-F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT 'orders' AS registry, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_repeated FROM orders UNION ALL SELECT 'lines', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) FROM lineitem")
def f23_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, keys and repeated keys of two registries."""
    out = None
    for name, table, keys in (("orders", "orders", ["o_orderkey"]), ("lines", "lineitem", ["l_orderkey", "l_linenumber"])):
        c = reg.table(spark, sf_dir, table).groupBy(*keys).count()
        part = c.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("count") > 1).alias("n_repeated")).select(F.lit(name).alias("registry"), "n_rows", "n_keys", "n_repeated")
        out = part if out is None else out.unionByName(part)
    return out


# --- rules --------------------------------------------------------------------------------------------------------------------------------

_SUBJECTS = """subjects AS (SELECT l_suppkey AS subject, count(DISTINCT p_brand) AS supporting_datasets, count(DISTINCT l_orderkey) AS consumer_assets, count(DISTINCT l_partkey) AS context_assets, min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"""
_FACTS = """facts AS (SELECT *, CASE WHEN subject % 4 = 0 THEN 'CONFIRMED' WHEN subject % 4 = 1 THEN 'UNRESOLVED' WHEN subject % 4 = 2 THEN 'POTENTIAL' ELSE 'NO_DEMONSTRATED' END AS technical, CASE WHEN subject % 5 = 0 THEN 'EXPLICIT' WHEN subject % 5 = 1 THEN 'UNKNOWN' WHEN subject % 5 = 2 THEN 'ELEVATED' ELSE 'STANDARD' END AS criticality,
CASE WHEN supporting_datasets >= 10 AND consumer_assets >= 10 AND context_assets >= 10 THEN 'WIDESPREAD' WHEN supporting_datasets >= 2 AND context_assets >= 1 THEN 'BROAD' WHEN supporting_datasets >= 1 AND consumer_assets >= 3 AND context_assets >= 3 THEN 'BROAD' WHEN supporting_datasets >= 1 AND context_assets >= 1 THEN 'LIMITED' ELSE 'LOCAL' END AS breadth FROM subjects),
graded AS (SELECT *, CASE WHEN technical = 'NO_DEMONSTRATED' THEN 'UNDETERMINED' WHEN technical = 'CONFIRMED' THEN CASE criticality WHEN 'EXPLICIT' THEN CASE WHEN breadth IN ('BROAD', 'WIDESPREAD') THEN 'CRITICAL' ELSE 'HIGH' END WHEN 'ELEVATED' THEN 'HIGH' ELSE 'MODERATE' END
  WHEN criticality = 'EXPLICIT' THEN 'HIGH' WHEN criticality = 'ELEVATED' THEN CASE WHEN breadth IN ('BROAD', 'WIDESPREAD') THEN 'HIGH' ELSE 'MODERATE' END WHEN breadth IN ('BROAD', 'WIDESPREAD') THEN 'MODERATE' WHEN criticality = 'STANDARD' THEN 'LOW' ELSE 'UNDETERMINED' END AS severity FROM facts)"""


def _facts(spark, sf_dir):
    lines = reg.table(spark, sf_dir, "lineitem").join(reg.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    subjects = lines.groupBy(F.col("l_suppkey").alias("subject")).agg(F.count_distinct("p_brand").alias("supporting_datasets"), F.count_distinct("l_orderkey").alias("consumer_assets"), F.count_distinct("l_partkey").alias("context_assets"))
    k, c = F.col("subject") % 4, F.col("subject") % 5
    return subjects.withColumns({
        "technical": F.when(k == 0, "CONFIRMED").when(k == 1, "UNRESOLVED").when(k == 2, "POTENTIAL").otherwise("NO_DEMONSTRATED"),
        "criticality": F.when(c == 0, "EXPLICIT").when(c == 1, "UNKNOWN").when(c == 2, "ELEVATED").otherwise("STANDARD"),
    })


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT subject, supporting_datasets, consumer_assets, context_assets, breadth FROM facts")
def j05_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each subject's exposure spreads, by thresholds kept as data."""
    return rules.derive_breadth(_facts(spark, sf_dir), "subject").select("subject", "supporting_datasets", "consumer_assets", "context_assets", "breadth")


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT subject, technical, criticality, breadth, severity FROM graded")
def j08_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rules.derive_breadth(_facts(spark, sf_dir), "subject").drop("rule", "rule_state")
    return rules.derive_severity(own, "subject").select("subject", "technical", "criticality", "breadth", "severity")


@query(f"""WITH {_SUBJECTS}, {_FACTS}, c AS (SELECT *, CASE technical WHEN 'UNRESOLVED' THEN 'UNRESOLVED' WHEN 'POTENTIAL' THEN 'CONDITIONAL' ELSE 'ESTABLISHED' END AS certainty, subject % 3 = 0 AS has_conditions FROM graded)
SELECT subject, severity, CASE WHEN technical = 'CONFIRMED' AND severity IN ('HIGH', 'CRITICAL') THEN 'BLOCK' WHEN technical = 'UNRESOLVED' AND severity IN ('HIGH', 'CRITICAL') AND breadth IN ('BROAD', 'WIDESPREAD') THEN 'HOLD' WHEN technical = 'POTENTIAL' AND severity IN ('LOW', 'MODERATE') AND has_conditions THEN 'PROCEED_WITH_CONDITIONS' WHEN technical = 'NO_DEMONSTRATED' THEN 'PROCEED' END AS disposition,
CASE WHEN technical = 'CONFIRMED' AND severity IN ('HIGH', 'CRITICAL') OR technical = 'UNRESOLVED' AND severity IN ('HIGH', 'CRITICAL') AND breadth IN ('BROAD', 'WIDESPREAD') OR technical = 'POTENTIAL' AND severity IN ('LOW', 'MODERATE') AND has_conditions OR technical = 'NO_DEMONSTRATED' THEN 'matched' ELSE 'no_matching_rule' END AS rule_state FROM c""")
def j13_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of each subject; a gap in the rules shows as data."""
    own = rules.derive_severity(rules.derive_breadth(_facts(spark, sf_dir), "subject").drop("rule", "rule_state"), "subject").drop("rule", "rule_state")
    certainty = F.when(F.col("technical") == "UNRESOLVED", "UNRESOLVED").when(F.col("technical") == "POTENTIAL", "CONDITIONAL").otherwise("ESTABLISHED")
    own = own.withColumn("certainty", certainty).withColumn("has_conditions", F.col("subject") % 3 == 0)
    return rules.derive_decision(own, "subject").select("subject", "severity", "disposition", "rule_state")


@query(f"WITH {_SUBJECTS}, {_FACTS} SELECT severity, count(*) AS n, sum(supporting_datasets)::BIGINT AS datasets FROM graded GROUP BY 1")
def f15_severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j08_all(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.sum("supporting_datasets").alias("datasets"))


def j08_all(spark, sf_dir):
    return rules.derive_severity(rules.derive_breadth(_facts(spark, sf_dir), "subject").drop("rule", "rule_state"), "subject")


@query("""WITH d AS (SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), c AS (SELECT p_partkey AS node, ['FIELD_RENAME', 'FIELD_DELETE', 'FIELD_TYPE_CHANGE'][p_partkey % 3 + 1] AS operation, coalesce(n, 0) AS dependants, ['SMALLINT', 'INTEGER', 'REAL', 'TEXT'][p_partkey % 4 + 1] AS native, ['INTEGER', 'BIGINT', 'DOUBLE PRECISION'][p_partkey % 5 % 3 + 1] AS proposed FROM part LEFT JOIN d ON node = p_partkey),
s AS (SELECT *, CASE WHEN dependants = 0 THEN 'COMPATIBLE' WHEN operation = 'FIELD_RENAME' THEN 'UNKNOWN' WHEN operation = 'FIELD_DELETE' THEN 'INCOMPATIBLE' WHEN native <> 'TEXT' AND (native, proposed) IN (('SMALLINT', 'INTEGER'), ('INTEGER', 'BIGINT'), ('REAL', 'DOUBLE PRECISION'), ('FLOAT', 'DOUBLE PRECISION')) THEN 'CONDITIONAL' ELSE 'UNKNOWN' END AS compatibility FROM c)
SELECT node, operation, compatibility, CASE compatibility WHEN 'INCOMPATIBLE' THEN 'CONFIRMED' WHEN 'CONDITIONAL' THEN 'POTENTIAL' WHEN 'UNKNOWN' THEN 'UNRESOLVED' ELSE 'NO_DEMONSTRATED' END AS technical,
CASE WHEN compatibility = 'COMPATIBLE' THEN 'LOW' WHEN compatibility = 'INCOMPATIBLE' THEN 'HIGH' WHEN dependants > 2 THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM s""")
def j01_structural_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename, delete and type change proposals for every field, judged by the structural rules."""
    dependants = reg.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_orderkey").alias("n"))
    k = F.col("node")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    own = reg.fields(spark, sf_dir).select("node").join(dependants, "node", "left").select(
        "node", F.coalesce("n", F.lit(0)).alias("dependants"), pick(["FIELD_RENAME", "FIELD_DELETE", "FIELD_TYPE_CHANGE"], k % 3).alias("operation"),
        pick(["SMALLINT", "INTEGER", "REAL", "TEXT"], k % 4).alias("native"), pick(["INTEGER", "BIGINT", "DOUBLE PRECISION"], k % 5 % 3).alias("proposed"),
    )
    own = own.withColumn("compatibility", rules.structural_compatibility(F.col("operation"), F.col("dependants"), F.col("native"), F.col("proposed"), F.col("native") != "TEXT"))
    technical, _ = rules.technical_impact(F.col("compatibility"))
    return own.withColumn("technical", technical).select("node", "operation", "compatibility", "technical", rules.structural_severity(F.col("technical"), rules.simple_breadth(F.col("dependants"))).alias("severity"))


@query(f"WITH {_SUBJECTS}, {_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY breadth ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, subject) AS position FROM graded) SELECT breadth, position, subject, severity FROM r WHERE position <= 3")
def g03_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gravest subjects of each breadth (a top-k report)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MODERATE", "LOW", "UNDETERMINED")]), F.col("severity"))
    return rules.top_of_each(j08_all(spark, sf_dir), ["breadth"], [rank, "subject"], 3).select("breadth", "position", "subject", "severity")


# --- sets, functions, diffs ---------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE WHEN b.k IS NULL THEN 'REMOVED' WHEN a.k IS NULL THEN 'ADDED' ELSE 'KEPT' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def h03_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References before and after: removed, added, kept."""
    lines = reg.table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    a, b = (lines.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct() for f in "AR")
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "REMOVED").when(F.col("a").isNull(), "ADDED").otherwise("KEPT").alias("change")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 'cust-' || substr(sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_nationkey), 1, 20) AS stable_id FROM customer")
def i01_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.table(spark, sf_dir, "customer").select("c_custkey", ids.stable_id("cust", F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("stable_id"))


@query("SELECT doc_id, 'sha256:' || sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS fingerprint FROM documents")
def i06_content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.table(spark, sf_dir, "documents").select("doc_id", ids.content_fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Number' WHEN 'MEDIUM' THEN 'String' WHEN 'PROMO' THEN 'Date' ELSE 'Unknown' END AS category FROM part")
def i07_normalized_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_type") == "STANDARD", "NumberType").when(F.col("p_type") == "MEDIUM", "StringType").when(F.col("p_type") == "PROMO", "DateType").otherwise(F.col("p_type"))
    return reg.table(spark, sf_dir, "part").select("p_partkey", ids.normalized_type(name).alias("category"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS documentation FROM pages")
def i10_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.table(spark, sf_dir, "pages").select("page_id", ids.documentation(F.col("html")).alias("documentation"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS observed_at FROM events")
def i13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("observed_at"))


@query("WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) SELECT 'order' AS invariant, count(*) AS n_dangling FROM e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT 'part', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'supplier', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey + 1)")
def d21_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys that lead nowhere, by anti joins."""
    e = reg.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().withColumn("next_supp", F.col("l_suppkey") + 1)
    out = None
    for name, key, table, other in (("order", "l_orderkey", "orders", "o_orderkey"), ("part", "l_partkey", "part", "p_partkey"), ("supplier", "next_supp", "supplier", "s_suppkey")):
        part = e.join(reg.table(spark, sf_dir, table).select(F.col(other).alias(key)), key, "left_anti").agg(F.count("*").alias("n_dangling")).select(F.lit(name).alias("invariant"), "n_dangling")
        out = part if out is None else out.unionByName(part)
    return out


# --- schema changes, change requests, SQL models ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS node, CASE WHEN p_partkey = 11 THEN 'renamed_11' ELSE 'col_' || p_partkey END AS field_path, CASE WHEN p_partkey = 11 THEN 'RENAMED' ELSE 'UNCHANGED' END AS identity,
CASE WHEN p_partkey = 12 THEN 'TEXT' ELSE p_type END AS native_type FROM part WHERE p_partkey <> 13""")
def c16_counterfactual_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema after a rename, a type change and a delete, with each field's identity."""
    s = reg.fields(spark, sf_dir).withColumn("normalized_type", F.lit("Unknown"))
    s = changes.retype_field(changes.rename_field(s, "col_11", "renamed_11"), "col_12", "TEXT", "String")
    return changes.delete_field(s, "col_13").select("node", "field_path", "identity", "native_type")


_PATHS = """paths AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'models/m' || o_orderkey || '.sql' WHEN 1 THEN 'dags/d' || o_orderkey || '.py' WHEN 2 THEN 'docs/x.md' WHEN 3 THEN 'models/schema.yml' WHEN 4 THEN 'contracts/c.json' WHEN 5 THEN 'conf/quality.yaml' WHEN 6 THEN 'pipelines/p.yaml' ELSE 'lib/x.bin' END AS path,
CASE WHEN o_orderstatus = 'F' THEN 'select {{ ref() }}' ELSE 'select 1' END AS content FROM orders)"""


@query(f"""WITH {_PATHS} SELECT CASE WHEN path LIKE '%.sql' THEN CASE WHEN contains(content, '{{{{') THEN 'DBT_MODEL' ELSE 'SQL_MODEL' END WHEN path LIKE 'dags/%.py' THEN 'PIPELINE_DAG' WHEN path LIKE '%.md' THEN 'DOCUMENTATION_ONLY' WHEN path LIKE '%/schema.yml' THEN 'DBT_SCHEMA' WHEN path LIKE 'contracts/%' THEN 'SCHEMA_CONTRACT'
WHEN path LIKE '%quality.yaml' THEN 'QUALITY_CONFIG' WHEN path LIKE 'pipelines/%' THEN 'PIPELINE_CONFIG' ELSE 'UNSUPPORTED' END AS category, count(*) AS n FROM paths GROUP BY 1""")
def c21_file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the category that their path and content give."""
    k = F.col("o_orderkey") % 8
    key = F.col("o_orderkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("models/m"), key, F.lit(".sql"))).when(k == 1, F.concat(F.lit("dags/d"), key, F.lit(".py"))).when(k == 2, "docs/x.md").when(k == 3, "models/schema.yml").when(k == 4, "contracts/c.json").when(k == 5, "conf/quality.yaml").when(k == 6, "pipelines/p.yaml").otherwise("lib/x.bin")
    own = reg.table(spark, sf_dir, "orders").select(path.alias("path"), F.when(F.col("o_orderstatus") == "F", "select {{ ref() }}").otherwise("select 1").alias("content"))
    return own.groupBy(files.classify(F.col("path"), F.col("content")).alias("category")).agg(F.count("*").alias("n"))


_CLAIMS = """claims AS (SELECT DISTINCT l_partkey AS current, 'v' || (l_suppkey % 2) AS future, 'file_' || l_suppkey AS file FROM lineitem WHERE l_returnflag = 'R'),
refs AS (SELECT DISTINCT 'file_' || l_suppkey AS file, l_partkey::VARCHAR AS value FROM lineitem UNION SELECT DISTINCT 'doc_' || n_nationkey, 'v' || (n_nationkey % 3) FROM nation),
groups AS (SELECT current, list_sort(list(DISTINCT future)) AS futures, list_sort(list(DISTINCT file)) AS files FROM claims GROUP BY 1),
states AS (SELECT c.current, r.file, 'STALE' AS state FROM refs r JOIN claims c ON r.value = c.current::VARCHAR AND r.file <> c.file UNION SELECT c.current, r.file, 'ADAPTED' FROM refs r JOIN claims c ON r.value = c.future AND r.file <> c.file),
counts AS (SELECT current, count(*) FILTER (WHERE state = 'STALE') AS n_stale, count(*) FILTER (WHERE state = 'ADAPTED') AS n_adapted FROM states GROUP BY 1),
correlated AS (SELECT g.current, array_to_string(futures, ',') AS futures, len(files) AS n_files, coalesce(n_stale, 0) AS n_stale, coalesce(n_adapted, 0) AS n_adapted,
  CASE WHEN len(futures) > 1 OR (coalesce(n_stale, 0) > 0 AND coalesce(n_adapted, 0) = 0) THEN 'INCONSISTENT' WHEN coalesce(n_stale, 0) > 0 THEN 'PARTIALLY_COHERENT' WHEN coalesce(n_adapted, 0) > 0 OR len(files) > 1 THEN 'COHERENT' ELSE 'UNRESOLVED' END AS coherence FROM groups g LEFT JOIN counts c ON c.current = g.current)"""


def _correlated(spark, sf_dir):
    lines = reg.table(spark, sf_dir, "lineitem")
    file = F.concat(F.lit("file_"), F.col("l_suppkey").cast("string")).alias("file")
    claims = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("current"), F.concat(F.lit("v"), (F.col("l_suppkey") % 2).cast("string")).alias("future"), file).distinct()
    refs = lines.select(file, F.col("l_partkey").cast("string").alias("value"))
    refs = refs.unionByName(reg.table(spark, sf_dir, "nation").select(F.concat(F.lit("doc_"), F.col("n_nationkey").cast("string")).alias("file"), F.concat(F.lit("v"), (F.col("n_nationkey") % 3).cast("string")).alias("value"))).distinct()
    return claims, changes.correlated(claims, refs)


@query(f"WITH {_CLAIMS} SELECT current::VARCHAR AS current, futures, n_files, n_stale, n_adapted, coherence FROM correlated")
def m01_correlated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a change request by field, with stale and adapted references and coherence."""
    _, g = _correlated(spark, sf_dir)
    return g.select("current", F.array_join("futures", ",").alias("futures"), F.size("files").cast("long").alias("n_files"), "n_stale", "n_adapted", "coherence")


@query(f"WITH {_CLAIMS} SELECT current::VARCHAR AS current, array_to_string(futures, ',') AS futures, array_to_string(files, ',') AS files FROM groups WHERE len(futures) > 1")
def m02_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that two files rename differently."""
    claims, _ = _correlated(spark, sf_dir)
    return changes.conflicts(claims).select("current", F.array_join("futures", ",").alias("futures"), F.array_join("files", ",").alias("files"))


@query(f"""WITH {_CLAIMS} SELECT CASE min(CASE coherence WHEN 'INCONSISTENT' THEN 1 WHEN 'PARTIALLY_COHERENT' THEN 2 WHEN 'UNRESOLVED' THEN 3 ELSE 4 END) WHEN 1 THEN 'INCONSISTENT' WHEN 2 THEN 'PARTIALLY_COHERENT' WHEN 3 THEN 'UNRESOLVED' ELSE 'COHERENT' END AS coherence,
count(*) AS n_groups, sum(n_stale)::BIGINT AS n_stale, count(*) FILTER (WHERE contains(futures, ',')) AS n_conflicts, CASE WHEN count(*) = 0 THEN 'no_material_change' WHEN count(*) FILTER (WHERE contains(futures, ',')) > 0 THEN 'block_confirmed_incompatibility' ELSE 'hold_for_review' END AS decision FROM correlated""")
def j15_change_request_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request: the weakest coherence, and the decision."""
    _, g = _correlated(spark, sf_dir)
    return changes.overall_coherence(g).withColumn("decision", rules.change_request_decision(F.col("n_groups"), F.col("n_conflicts")))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O'), t AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_tax > 0.05),
u AS (SELECT coalesce(a.k, b.k) AS k, a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k) SELECT CASE WHEN x IS NULL THEN 'NEW' WHEN y IS NULL THEN 'CLOSED' WHEN t.k IS NOT NULL THEN 'STILL_OPEN' ELSE 'UNCHANGED' END AS state, count(*) AS n FROM u LEFT JOIN t ON t.k = u.k GROUP BY 1""")
def h04_closed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots before and after a repair."""
    lines = reg.table(spark, sf_dir, "lineitem").withColumn("root_id", F.col("l_partkey"))
    parts = [lines.where(c).select("root_id") for c in ("l_returnflag = 'A'", "l_linestatus = 'O'", "l_tax > 0.05")]
    return changes.closed_roots(*parts).groupBy("state").agg(F.count("*").alias("n"))


# One model for each brand and type of parts, in two versions whose clauses differ as the group's figures say.
_MODELS = "SELECT p_brand || ':' || p_type AS model, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand, p_type"
_CHANGES = f"""m AS ({_MODELS}), d AS (
  SELECT model, 'AGGREGATION_CHANGE' AS delta_type, 'v' AS output, 'function_changed' AS components FROM m WHERE n % 2 = 1
  UNION ALL SELECT model, 'OUTPUT_RENAME', 'kind', 'renamed' FROM m WHERE n % 3 = 0
  UNION ALL SELECT model, 'OUTPUT_ADD', 'w', 'added' FROM m WHERE hi % 3 = 1
  UNION ALL SELECT model, 'DERIVED_EXPRESSION_CHANGE', 'd', 'operator_changed' FROM m WHERE lo % 3 = 1
  UNION ALL SELECT model, 'DERIVED_EXPRESSION_CHANGE', 'd', 'operator_changed,literal_changed' FROM m WHERE lo % 3 = 2
  UNION ALL SELECT model, 'FILTER_CHANGE', NULL, 'predicate_modified,literal_changed' FROM m WHERE lo <> hi
  UNION ALL SELECT model, 'JOIN_TYPE_CHANGE', NULL, 'type_changed' FROM m WHERE n % 5 IN (0, 1)
  UNION ALL SELECT model, 'JOIN_PREDICATE_CHANGE', NULL, 'predicate_changed' FROM m WHERE hi % 2 = 0
  UNION ALL SELECT model, 'UNCLASSIFIED_CHANGE', NULL, concat_ws(',', CASE WHEN n % 4 = 0 THEN 'ordering' END, CASE WHEN n % 7 < 3 THEN 'limit' END, CASE WHEN lo % 2 = 0 THEN 'ctes' END, CASE WHEN hi % 5 < 2 THEN 'relations' END) FROM m WHERE n % 4 = 0 OR n % 7 < 3 OR lo % 2 = 0 OR hi % 5 < 2)"""


def _versions(n: int, lo: int, hi: int) -> tuple[str, str]:
    def text(new: bool) -> str:
        of = lambda hit, then, otherwise: then if new and hit else otherwise
        derived = "c.size * 2" if not new or lo % 3 == 0 else "c.size + 2" if lo % 3 == 1 else "c.size - 7"
        return (
            f"WITH c AS (SELECT p_type, p_size AS size, id FROM part WHERE p_size < {of(lo % 2 == 0, 90, 99)}) SELECT c.p_type AS {of(n % 3 == 0, 'sort', 'kind')}, {derived} AS d, {of(n % 2, 'AVG', 'SUM')}(c.size) AS v{of(hi % 3 == 1, ', MAX(c.size) AS w', '')} "
            f"FROM {of(hi % 5 < 2, 'archive', 'stock')} s {of(n % 5 < 2, 'JOIN', 'LEFT JOIN')} c ON s.id = c.id{of(hi % 2 == 0, ' AND s.day = 1', '')} WHERE s.size > {hi if new else lo} GROUP BY c.p_type, c.size ORDER BY {of(n % 4 == 0, 'v', 'c.p_type')} LIMIT {of(n % 7 < 3, 50, 10)}"
        )

    return text(False), text(True)


@query(f"WITH {_CHANGES} SELECT model, delta_type, CASE WHEN output IS NULL THEN 'MODEL_WIDE' ELSE 'OUTPUT' END AS scope, output, components FROM d")
def l01_model_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of a SQL model for each brand and type of parts, by Catalyst's own trees; clauses that no delta type
    covers are named beside the others."""
    found = reg.table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit(":"), "p_type").alias("model")).agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return sqlmodel.deltas_frame(spark, [(r.model, *_versions(r.n, r.lo, r.hi)) for r in found.limit(sqlmodel.MAX_MODELS).collect()])


@query(f"""WITH {EDGES}, {GROUPS}, {LINKS} SELECT (SELECT count(*) FROM part) AS n_fields, (SELECT count(DISTINCT p_brand) FROM part) AS n_datasets, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM groups) AS n_groups, (SELECT count(*) FROM links) AS n_relationships, (SELECT count(DISTINCT target_key) FROM links) AS n_assets""")
def f19_snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.snapshot_summary(reg.fields(spark, sf_dir), reg.lineage_edges(spark, sf_dir), reg.mapping_groups(spark, sf_dir), reg.relationships(spark, sf_dir))


@query(f"""WITH {EDGES}, c AS (SELECT 'fields are unique' AS name, 'repeated' AS what, count(*) AS n FROM (SELECT 1 FROM part GROUP BY p_partkey HAVING count(*) > 1)
UNION ALL SELECT 'edges start at fields', 'dangling', count(DISTINCT src) FROM edges WHERE src NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'edges end at fields', 'dangling', count(DISTINCT dst) FROM edges WHERE dst NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'edges are unique', 'repeated', count(*) FROM (SELECT 1 FROM edges GROUP BY src, dst HAVING count(*) > 1) UNION ALL SELECT 'lines are unique', 'repeated', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders have customers', 'dangling', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'suppliers have known regions', 'dangling', count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)
UNION ALL SELECT 'names hold no secrets', 'with secrets', count(*) FROM part WHERE regexp_matches(p_name, '(?i)(password|secret|token)\\s*[:=]')
UNION ALL SELECT 'groups are the orders', 'different', count(*) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a FULL JOIN orders ON o_orderkey = k WHERE k IS NULL OR o_orderkey IS NULL)
SELECT name, n = 0 AS passed, '0 ' || what AS expected, n::VARCHAR AS observed FROM c""")
def o01_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the registries as a table of checks."""
    f, lines, edges = reg.fields(spark, sf_dir), reg.table(spark, sf_dir, "lineitem"), materialize(reg.lineage_edges(spark, sf_dir), "edges")
    orders, customer, supplier = (reg.table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    known = reg.table(spark, sf_dir, "nation").where("n_regionkey <> 0")
    ends = lambda c: edges.select(F.col(c).alias("node"))
    return certify.report(
        certify.unique(f, ["node"], "fields are unique"), certify.references(ends("src"), "node", f, "node", "edges start at fields"), certify.references(ends("dst"), "node", f, "node", "edges end at fields"),
        certify.unique(edges, ["src", "dst"], "edges are unique"), certify.unique(lines, ["l_orderkey", "l_linenumber"], "lines are unique"),
        certify.references(orders.select(F.col("o_custkey").alias("c")), "c", customer.select(F.col("c_custkey").alias("c")), "c", "orders have customers"),
        certify.references(supplier.select(F.col("s_nationkey").alias("k")), "k", known.select(F.col("n_nationkey").alias("k")), "k", "suppliers have known regions"),
        certify.without_secrets(f, ["description"], "names hold no secrets"),
        certify.same_rows(reg.mapping_groups(spark, sf_dir).select("group_id"), orders.select(F.col("o_orderkey").alias("group_id")), "groups are the orders"),
    )


@query(f"""WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS}, {LINKS}, ex AS (SELECT node, p_brand AS dataset_urn FROM depths JOIN part ON p_partkey = node WHERE depth > 0),
m AS (SELECT l.category, l.target_key FROM ex JOIN links l ON l.source_key = ex.dataset_urn UNION SELECT l.category, l.target_key FROM ex JOIN links l ON l.field_node = ex.node AND l.source_key IS NULL),
s AS (SELECT (SELECT count(*) FROM ex) AS dependants, (SELECT count(DISTINCT dataset_urn) FROM ex) AS supporting_datasets, (SELECT count(DISTINCT target_key) FROM m) AS context_assets, (SELECT count(DISTINCT target_key) FROM m WHERE category IN ('pipeline', 'bi')) AS consumer_assets)
SELECT dependants, supporting_datasets, context_assets, consumer_assets, 'INCOMPATIBLE' AS compatibility, 'CONFIRMED' AS technical, 'ELEVATED' AS criticality, CASE WHEN supporting_datasets >= 10 AND consumer_assets >= 10 AND context_assets >= 10 THEN 'WIDESPREAD' ELSE 'BROAD' END AS breadth, 'HIGH' AS severity, 'BLOCK' AS disposition FROM s""")
def p31_structural_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field deletion end to end: reach, context, breadth, severity and the decision."""
    edges, root = _graph(spark, sf_dir)
    d = structural.analyse(edges, reg.fields(spark, sf_dir), reg.relationships(spark, sf_dir), root, "FIELD_DELETE")["decision"]
    return d.select("dependants", "supporting_datasets", "context_assets", "consumer_assets", "compatibility", "technical", "criticality", "breadth", "severity", "disposition")


@query(f"""WITH RECURSIVE {EDGES}, {ROOT}, {DEPTHS} SELECT node, 'Field ' || node || ' of ' || p_brand || ' is reached ' || CASE WHEN depth = 1 THEN 'directly' ELSE 'through others' END || ', ' || depth || ' steps from the change.' AS statement FROM depths JOIN part ON p_partkey = node WHERE depth > 0""")
def p01_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each exposed field."""
    return structural.explanations(e06_reach_depths(spark, sf_dir).where("depth > 0"))


@query(f"WITH {MAPPINGS} SELECT dataset_urn, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, CASE WHEN bool_or(target_key = 'tag:1') THEN 'EXPLICIT' WHEN count(*) = 0 THEN 'UNKNOWN' WHEN bool_or(category = 'bi') AND count(DISTINCT category) >= 2 THEN 'ELEVATED' ELSE 'STANDARD' END AS criticality FROM mappings GROUP BY 1")
def j07_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How critical each dataset's context is; one tag stands for an explicit designation."""
    m = _mappings(spark, sf_dir).groupBy("dataset_urn").agg(F.array_sort(F.collect_set("category")).alias("c"), F.bool_or(F.col("target_key") == "tag:1").alias("explicit"))
    return m.select("dataset_urn", F.array_join("c", ",").alias("categories"), rules.criticality(F.col("explicit"), F.col("c")).alias("criticality"))


@query()
def n07_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names in configuration files replaced by a plan of actions, one file for each part; a diff that applies back for each."""
    part = reg.table(spark, sf_dir, "part")
    path = F.concat(F.lit("conf/"), F.col("p_partkey").cast("string"), F.lit(".yaml"))
    own = part.select(path.alias("path"), F.format_string("field: col_%d  # kept\nowner: %s\n", "p_partkey", "p_brand").alias("content"))
    todo = part.select(path.alias("path"), F.lit(1).alias("position"), F.lit("yaml").alias("editor"), F.lit("$.field").alias("location"), F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("current"), F.concat(F.lit("new_"), F.col("p_partkey").cast("string")).alias("future"))
    return repair.apply_plan(own, todo)


@query()
def i04_table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of a registry's rows that no ordering or partitioning changes."""
    return ids.table_fingerprint(reg.fields(spark, sf_dir))


# The other parts of the catalogue register themselves.
from . import propagation, repairs, requests, reviews, scans, snapshots  # noqa: E402, F401
