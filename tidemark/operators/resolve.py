"""Resolving requested identities against observed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(requests: DataFrame, observed: DataFrame, keys: list[str], request_id: str, fold: bool = True) -> DataFrame:
    """RESOLVED, NOT_FOUND, AMBIGUOUS or INVALID by the number of observed rows that equal the request on all keys.

    A request with an empty or padded key is INVALID.  One hash join on the folded keys; observed rows are counted by key first, so a key
    that many rows share is one row in the join.
    """
    f = (lambda c: F.lower(c)) if fold else (lambda c: c)
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull() | (F.trim(k) == "") | (F.trim(k) != F.col(k))
    counts = observed.groupBy(*[f(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n_matches"))
    on = [f(requests[k]) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    joined = requests.join(counts, on, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    state = F.when(bad, "INVALID").when(F.col("n_matches") == 0, "NOT_FOUND").when(F.col("n_matches") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return joined.select(request_id, *keys, "n_matches", state.alias("resolution"))


def match_evidence(pairs: DataFrame, attributes: list[tuple[str, str, str]], key: str) -> DataFrame:
    """A row per attribute: requested, observed, whether they match.  attributes: (name, requested column, observed column)."""
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(a).cast("string").alias("requested"), F.col(b).cast("string").alias("observed"), F.coalesce(F.lower(F.col(a).cast("string")) == F.lower(F.col(b).cast("string")), F.lit(False)).alias("matches")) for n, a, b in attributes])
    return pairs.select(key, F.inline(rows))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null if all hold; a null check fails."""
    out = None
    for name, ok in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def reference_ladder(references: DataFrame, schema: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Each reference is a member of a schema, else known as an entity, else unresolved."""
    a = schema.select(F.col(key).alias("_a")).distinct()
    b = entities.select(F.col(key).alias("_b")).distinct()
    out = references.join(a, references[key] == F.col("_a"), "left").join(b, references[key] == F.col("_b"), "left")
    return out.withColumn("reference", F.when(F.col("_a").isNotNull(), "SCHEMA_MEMBER").when(F.col("_b").isNotNull(), "SCHEMA_FIELD_ENTITY").otherwise("UNRESOLVED")).drop("_a", "_b")


def resolve_relations(relations: DataFrame, datasets: DataFrame) -> DataFrame:
    """model, relation, dataset_urn, resolution: each relation's name against all name variants of datasets on its platform.

    relations: model, relation, platform.  datasets: dataset_urn, name, platform.  Variants (the whole name and each tail behind a dot) are
    exploded once and counted by key, so the join is an equi join whatever the names' depth.
    """
    parts = F.split(F.lower("name"), r"\.")
    variants = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    alias = datasets.select("dataset_urn", F.lower("platform").alias("_p"), F.explode(F.array_distinct(variants)).alias("_v")).groupBy("_p", "_v").agg(F.count_distinct("dataset_urn").alias("n"), F.min("dataset_urn").alias("dataset_urn"))
    out = relations.join(alias, (F.lower(relations["platform"]) == F.col("_p")) & (F.lower(relations["relation"]) == F.col("_v")), "left")
    return out.select("model", "relation", F.when(F.col("n") == 1, F.col("dataset_urn")).alias("dataset_urn"), F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("resolution"))


def resolve_columns(columns: DataFrame, relations: DataFrame, fields: DataFrame) -> DataFrame:
    """model, qualifier, column, dataset_urn, resolution.  An unqualified column needs exactly one relation in its model.

    columns: model, qualifier (or null), column.  relations: model, alias, dataset_urn.  fields: dataset_urn, field_path.
    """
    only = relations.groupBy("model").agg(F.count("*").alias("_n"), F.min("dataset_urn").alias("_only"))
    own = columns.join(only, "model", "left")
    named = relations.select(F.col("model").alias("_m"), F.lower("alias").alias("_a"), F.col("dataset_urn").alias("_d"))
    own = own.join(named, (own["model"] == F.col("_m")) & (F.lower("qualifier") == F.col("_a")), "left")
    own = own.withColumn("dataset_urn", F.when(F.col("qualifier").isNotNull(), F.col("_d")).when(F.col("_n") == 1, F.col("_only")))
    f = fields.select(F.col("dataset_urn").alias("_fd"), F.lower("field_path").alias("_f")).distinct()
    out = own.join(f, (F.col("dataset_urn") == F.col("_fd")) & (F.lower("column") == F.col("_f")), "left")
    state = F.when(F.col("qualifier").isNull() & (F.coalesce("_n", F.lit(0)) != 1), "AMBIGUOUS").when(F.col("dataset_urn").isNull(), "UNKNOWN_ALIAS").when(F.col("_f").isNull(), "UNKNOWN_FIELD").otherwise("RESOLVED")
    return out.select("model", "qualifier", "column", "dataset_urn", state.alias("resolution"))


def expand_star(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """model, field_path for models of one relation."""
    one = relations.groupBy("model").agg(F.count("*").alias("_n"), F.min("dataset_urn").alias("dataset_urn")).where("_n = 1")
    return one.join(fields.select("dataset_urn", "field_path").distinct(), "dataset_urn").select("model", "field_path")
