"""Typed registries: schemas, strict readers, and the projection of a star schema into a lineage graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.store import dealt

SCHEMAS = {
    "datasets": "dataset_urn STRING, platform STRING, environment STRING, qualified_name STRING, logical_name STRING, schema_field_paths ARRAY<STRING>, lineage_field_keys ARRAY<STRING>, metadata_states MAP<STRING,ARRAY<STRING>>, evidence_ids ARRAY<STRING>",
    "source_schema": "position INT, field_path STRING, field_name STRING, native_type STRING, normalized_type STRING, description STRING, nullable BOOLEAN, is_part_of_key BOOLEAN, is_partitioning_key BOOLEAN, json_path STRING, label STRING, recursive BOOLEAN, schema_field_urn STRING, evidence_ids ARRAY<STRING>",
    "fields": "dataset_urn STRING, field_path STRING, field_key STRING, platform STRING, dataset_name STRING, environment STRING, native_type STRING, normalized_type STRING, schema_position INT, reference_resolution STRING, lineage_depth INT, path_count INT, paths_truncated BOOLEAN, evidence_ids ARRAY<STRING>",
    "edges": "edge_id STRING, src STRING, dst STRING, classification STRING, mapping_group_ids ARRAY<STRING>, source_entity_urns ARRAY<STRING>, source_aspects ARRAY<STRING>, transform_operations ARRAY<STRING>, confidence_scores ARRAY<DOUBLE>, evidence_ids ARRAY<STRING>",
    "mapping_groups": "group_id STRING, source_entity_urn STRING, source_entity_type STRING, source_aspect STRING, source_group_index INT, upstream ARRAY<STRING>, downstream ARRAY<STRING>, transform_operation STRING, confidence_score DOUBLE, query STRING, match_type STRING, expansion_state STRING, ambiguity_reason STRING",
    "relationships": "relationship_id STRING, category STRING, source_key STRING, target_key STRING, relationship_path ARRAY<STRING>, state STRING, attributes MAP<STRING,ARRAY<STRING>>, evidence_ids ARRAY<STRING>",
    "evidence": "evidence_id STRING, classification STRING, source_phase STRING, subject_key STRING, interface STRING, aspect_or_relationship STRING, source_urn STRING, target_urn STRING, relationship_path ARRAY<STRING>, observed_at STRING, attributes MAP<STRING,ARRAY<STRING>>",
}


def load_registry(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A registry kept as JSON lines: declared types only, and a malformed row ends the read."""
    return spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fields: node, dataset_urn (brand), field_path, native_type (type), size."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("dataset_urn"), F.concat(F.lit("col_"), F.col("p_partkey")).alias("field_path"), F.col("p_type").alias("native_type"), F.col("p_name").alias("description"), F.col("p_size").alias("size"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part to the next one of its order.  Lines that agree in number and part stand for the same node, so nothing else orders them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return lines.where("dst is not null and src <> dst").select("src", "dst").distinct()


def acyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that go up: an acyclic graph."""
    return lineage_edges(spark, sf_dir).where("src < dst")


#: How an order's priority reads as a transform.
OPERATIONS = {"1-URGENT": "identity", "2-HIGH": "copy_column", "3-MEDIUM": "sum", "4-NOT SPECIFIED": "", "5-LOW": "cast"}


def mapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hyper-edges: parts of odd lines upstream, of even lines downstream, a transform by priority, a confidence by status."""
    side = lambda odd: F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_partkey"))))
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side(1).alias("upstream"), side(0).alias("downstream"))
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(op, "o_orderpriority").alias("operation"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).when(F.col("o_orderstatus") == "P", 1.5).alias("confidence"))
    return sides.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("group_id"), "upstream", "downstream", "operation", "confidence")


def first_node(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("src").alias("node")).where("node is not null")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, source_key (a dataset or null), field_node (or null), target_key, state: context links of four kinds.

    owner: supplier nations of a brand's lines; pipeline: suppliers of a part's lines; bi: order priorities that a brand's lines
    stand in; tag: a field's size class, unresolved where it is over 45.  Owners and priorities come from one pass: lines meet their order, then their
    part, and what is left of them is distinct by brand.  All exchanges of lines are dealt by rows and the smaller side is hashed, so no plan turns into a
    broadcast or a sort of all lines as tables grow.  Pairs of part and supplier are distinct where they are dealt and are the pipelines' rows.
    """
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit(True).alias("supplied"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit(True).alias("ordered"))
    rows, none, text = lines.count(), F.lit(None), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    hashed = lambda left, a, right, b, how="inner": dealt(left, rows, a).join(dealt(right, rows, b).hint("shuffle_hash"), F.col(a) == F.col(b), how)
    of_order = hashed(lines.select("l_orderkey", "l_partkey", "l_suppkey").where("l_partkey is not null"), "l_orderkey", orders, "o_orderkey", "left")
    of_part = hashed(of_order.select("l_partkey", "l_suppkey", "o_orderpriority", "ordered"), "l_partkey", part.select("p_partkey", "p_brand"), "p_partkey")
    seen = of_part.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("p_brand", "supplied", "s_nationkey", "ordered", "o_orderpriority").distinct()
    link = lambda category, target: F.struct(F.lit(category).alias("category"), target.alias("target_key"))
    both = F.array_compact(F.array(F.when(F.col("supplied"), link("owner", text("nation:", "s_nationkey"))), F.when(F.col("ordered"), link("bi", text("dashboard:", "o_orderpriority")))))
    of_brand = seen.select("p_brand", F.explode(both).alias("k")).select(F.col("k.category").alias("category"), F.col("p_brand").alias("source_key"), none.cast("long").alias("field_node"), F.col("k.target_key").alias("target_key"), F.lit("RESOLVED").alias("state"))
    pairs = dealt(lines.select("l_partkey", "l_suppkey"), rows, "l_partkey").distinct()
    known = pairs.join(dealt(part.select("p_partkey"), rows, "p_partkey").distinct().hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    pipeline = known.select(F.lit("pipeline").alias("category"), none.cast("string").alias("source_key"), F.col("l_partkey").alias("field_node"), text("job:", "l_suppkey").alias("target_key"), F.lit("RESOLVED").alias("state"))
    tag = part.select(F.lit("tag").alias("category"), none.cast("string").alias("source_key"), F.col("p_partkey").alias("field_node"), F.concat(F.lit("tag:"), F.floor(F.col("p_size") / 10).cast("string")).alias("target_key"), F.when(F.col("p_size") > 45, "UNRESOLVED").otherwise("RESOLVED").alias("state"))
    return of_brand.distinct().unionByName(pipeline).unionByName(tag.distinct())
