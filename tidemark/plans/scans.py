"""Queries of paged scans: tables written as pages of a catalogue, read through the data source, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, shared_dir
from ..sources import paged
from ..sources import registry as reg
from .catalog import query


def _pages(scratch: Scratch, df: DataFrame, chain: str, order: list[str], paging: str, size: int) -> str:
    import uuid

    path = f"{shared_dir(scratch.spark)}/pages-{uuid.uuid4().hex}"
    scratch.paths.append(path)
    paged.write_pages(df, path, chain, order, paging, size)
    return path


_KIND = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DATASET' WHEN 'BUILDING' THEN 'DATA_JOB' WHEN 'FURNITURE' THEN 'CHART' WHEN 'MACHINERY' THEN 'DASHBOARD' ELSE 'DATASET' END"
_NEIGHBOURS = f"SELECT DISTINCT 'nation' || c_nationkey AS chain, {_KIND} AS entity_type, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'urn:li:dataset:' || (c_custkey // 3) END AS urn, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS degree FROM customer"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the entities that each nation's dataset leads to; some have no name, some are two steps away."""
    kinds = {"AUTOMOBILE": "DATASET", "BUILDING": "DATA_JOB", "FURNITURE": "CHART", "MACHINERY": "DASHBOARD"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), "c_mktsegment"), F.lit("DATASET"))
    urn = F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("urn:li:dataset:"), F.floor(F.col("c_custkey") / 3).cast("string")))
    return reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("chain"), urn.alias("urn"), kind.alias("entity_type"), F.when(F.col("c_acctbal") < 0, 2).otherwise(1).alias("degree"), "c_custkey")


@query("SELECT 'nation' || c_nationkey AS chain, c_custkey, c_name, c_acctbal FROM customer")
def a10_paged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, through chains of cursor pages and back."""
    own = reg.table(spark, sf_dir, "customer").select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("chain"), "c_custkey", "c_name", "c_acctbal")
    with Scratch(spark) as scratch:
        path = _pages(scratch, own, "chain", ["c_custkey"], "cursor", 20)
        return scratch.result(paged.scan(spark, path, "c_custkey long NOT NULL, c_name string, c_acctbal double").select("chain", "c_custkey", "c_name", "c_acctbal"))


@query(f"SELECT DISTINCT chain, entity_type, urn FROM ({_NEIGHBOURS}) WHERE degree = 1 AND urn <> '' AND entity_type IN ('DATASET', 'DATA_JOB')")
def a10_paged_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets and jobs directly downstream, from cursor pages of 500."""
    with Scratch(spark) as scratch:
        path = _pages(scratch, _neighbours(spark, sf_dir), "chain", ["c_custkey"], "cursor", paged.CURSOR_PAGE)
        items = paged.scan(spark, path, "urn string, entity_type string NOT NULL, degree int NOT NULL")
        return scratch.result(paged.direct_neighbours(items, ("DATASET", "DATA_JOB")))


@query(f"SELECT DISTINCT chain, entity_type, urn FROM ({_NEIGHBOURS}) WHERE degree = 1 AND urn <> '' AND entity_type IN ('DATASET', 'CHART', 'DASHBOARD') AND chain IN ('nation3', 'nation7')")
def a20_context_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets, charts and dashboards one step from two datasets; only their chains are read."""
    with Scratch(spark) as scratch:
        path = _pages(scratch, _neighbours(spark, sf_dir), "chain", ["c_custkey"], "cursor", paged.CURSOR_PAGE)
        items = paged.scan(spark, path, "urn string, entity_type string NOT NULL, degree int NOT NULL", chains=["nation3", "nation7"])
        return scratch.result(paged.direct_neighbours(items, ("DATASET", "CHART", "DASHBOARD")))


_PROPERTIES = "SELECT p_partkey AS n, 'properties' || p_size % 4 AS chain, 'urn:li:structuredProperty:' || p_name AS property_urn, p_type AS value_type, p_size > 25 AS many FROM part"


@query(f"SELECT chain, property_urn, arg_max(value_type, n) AS value_type, arg_max(many, n) AS many FROM ({_PROPERTIES}) GROUP BY 1, 2")
def a15_property_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property definitions from offset pages of 1,000; of those with one urn the last stands."""
    own = reg.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.concat(F.lit("properties"), (F.col("p_size") % 4).cast("string")).alias("chain"), F.concat(F.lit("urn:li:structuredProperty:"), F.col("p_name")).alias("property_urn"), F.col("p_type").alias("value_type"), (F.col("p_size") > 25).alias("many"))
    with Scratch(spark) as scratch:
        path = _pages(scratch, own, "chain", ["n"], "offset", paged.OFFSET_PAGE)
        items = paged.scan(spark, path, "property_urn string NOT NULL, value_type string, many boolean", "offset")
        return scratch.result(paged.last_of_each(items, "chain", "property_urn").select("chain", "property_urn", "value_type", "many"))


@query("""WITH v AS (SELECT 'mfgr' || p_size % 4 AS chain, 'prop:' || p_partkey AS property_urn, [p_name, p_retailprice::VARCHAR, p_type] AS t, p_retailprice AS r FROM part)
SELECT chain, property_urn, i::INTEGER AS position, CASE WHEN i = 1 THEN 'NUMBER' ELSE 'STRING' END AS kind, CASE WHEN i <> 1 THEN t[i + 1] END AS string_value, CASE WHEN i = 1 THEN r::DOUBLE END AS number_value FROM v, unnest(range(3)) AS x(i)""")
def a16_property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned property values, texts and numbers in one list, from offset pages."""
    quoted = lambda c: F.get(F.split(F.to_json(F.struct(F.col(c).alias("v"))), '"v":', 2), F.lit(1))
    json_of = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    own = reg.table(spark, sf_dir, "part").select(F.concat(F.lit("mfgr"), (F.col("p_size") % 4).cast("string")).alias("chain"), F.concat(F.lit("prop:"), F.col("p_partkey").cast("string")).alias("property_urn"), F.array(json_of("p_name"), json_of("p_retailprice"), json_of("p_type")).alias("values"))
    with Scratch(spark) as scratch:
        path = _pages(scratch, own, "chain", ["property_urn"], "offset", paged.OFFSET_PAGE)
        return scratch.result(paged.property_values(paged.scan(spark, path, "property_urn string NOT NULL, values array<string>", "offset")))
