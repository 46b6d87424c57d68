"""A structural change end to end: reach, compatibility, context, severity and the decision, as one plan over registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import materialize
from ..operators import certify, context, graph, rules


def analyse(edges: DataFrame, fields: DataFrame, links: DataFrame, source: DataFrame, operation: str, native: str = "", proposed: str = "") -> dict[str, DataFrame]:
    """exposure, datasets, assets, decision and checks of one proposal.

    edges (src, dst), fields (node, dataset_urn, ...), links (context), source (one row: node).  Every step is a join or an
    aggregation over written tables; the decision is one row.
    """
    depths = materialize(graph.depths(edges, source), "depths")
    exposure = depths.where("depth > 0").join(fields.select("node", "dataset_urn"), "node").select("node", "dataset_urn", "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("exposure"))
    exposure = materialize(exposure, "exposure")
    links = materialize(links, "links")
    datasets = exposure.groupBy("dataset_urn").agg(F.count("*").alias("n_exposed"), F.min("depth").alias("depth"))
    summaries = context.dataset_summaries(links, exposure)
    datasets = datasets.join(summaries.select("dataset_urn", "n_owner", "n_pipeline", "n_bi", "n_tag", "n_assets"), "dataset_urn", "left").fillna(0)
    assets = materialize(context.context_assets(links, exposure), "assets")
    facts = exposure.agg(F.count("*").alias("dependants"), F.count_distinct("dataset_urn").alias("supporting_datasets"))
    of = assets.agg(F.count("*").alias("context_assets"), F.count_if(F.col("category").isin("pipeline", "bi")).alias("consumer_assets"), F.array_sort(F.collect_set("category")).alias("categories"))
    one = facts.withColumn("_k", F.lit(1)).join(of.withColumn("_k", F.lit(1)), "_k").drop("_k")
    compatibility = rules.structural_compatibility(F.lit(operation), F.col("dependants"), F.lit(native), F.lit(proposed), F.lit(True))
    one = one.withColumn("compatibility", compatibility)
    technical, certainty = rules.technical_impact(F.col("compatibility"))
    one = one.withColumn("technical", technical).withColumn("certainty", certainty).withColumn("criticality", rules.criticality(F.lit(False), F.col("categories"))).withColumn("has_conditions", F.lit(False)).drop("categories")
    one = rules.derive_breadth(one, "dependants").drop("rule", "rule_state")
    one = rules.derive_severity(one, "dependants").drop("rule", "rule_state")
    decision = rules.derive_decision(one, "dependants")
    checks = certify.report(
        certify.unique(exposure, ["node"], "exposed fields are unique"),
        certify.references(exposure, "node", fields, "node", "exposed fields are known"),
        certify.references(assets, "target_key", links, "target_key", "assets come from links"),
    )
    return {"exposure": exposure, "datasets": datasets, "assets": assets, "decision": decision, "checks": checks}


def explanations(exposure: DataFrame, limit_depth: int = 1_000) -> DataFrame:
    """A sentence for each exposed field."""
    text = F.format_string("Field %s of %s is reached %s, %s steps from the change.", F.col("node").cast("string"), F.col("dataset_urn"), F.when(F.col("depth") == 1, "directly").otherwise("through others"), F.col("depth").cast("string"))
    return exposure.where(F.col("depth") <= limit_depth).select("node", text.alias("statement"))
