"""Change requests: correlating claims across files, conflicts, stale references, coherence; and the projection of a schema change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

def rename_field(schema: DataFrame, current: str, proposed: str) -> DataFrame:
    """The schema with one field renamed; raises if the field is not there once or the new name is taken."""
    n = schema.agg(F.count_if(F.col("field_path") == current).alias("a"), F.count_if(F.col("field_path") == proposed).alias("b")).first()
    if n["a"] != 1:
        raise ValueError(f"{current} is there {n['a']} times")
    if n["b"]:
        raise ValueError(f"{proposed} is taken")
    return schema.withColumn("identity", F.when(F.col("field_path") == current, "RENAMED").otherwise("UNCHANGED")).withColumn("field_path", F.when(F.col("field_path") == current, proposed).otherwise(F.col("field_path")))


def delete_field(schema: DataFrame, current: str) -> DataFrame:
    return schema.where(~F.col("field_path").eqNullSafe(F.lit(current)))


def retype_field(schema: DataFrame, current: str, native: str, normalized: str) -> DataFrame:
    hit = F.col("field_path") == current
    return schema.withColumn("native_type", F.when(hit, native).otherwise(F.col("native_type"))).withColumn("normalized_type", F.when(hit, normalized).otherwise(F.col("normalized_type")))


def conflicts(claims: DataFrame) -> DataFrame:
    """current, futures: fields that are claimed under more than one new name.  claims: current, future, file."""
    return claims.groupBy("current").agg(F.array_sort(F.collect_set("future")).alias("futures"), F.array_sort(F.collect_set("file")).alias("files")).where(F.size("futures") > 1)


def reference_states(claims: DataFrame, references: DataFrame) -> DataFrame:
    """current, file, state: STALE where another file still names the old field, ADAPTED where it names a new one.  references: file, value."""
    files = [F.count_distinct("file").alias("_n"), F.min("file").alias("_only")]

    def named(claimed: DataFrame, state: str) -> DataFrame:
        """A name's claims meet its references as one row: all files count where several claim it, the others where one does."""
        met = references.join(claimed, "value").where(F.col("file").isNotNull() & ((F.col("_n") > 1) | (F.col("file") != F.col("_only"))))
        return met.select("current", "file", F.lit(state).alias("state"))

    stale = named(claims.groupBy("current").agg(*files).withColumn("value", F.col("current")), "STALE")
    adapted = named(claims.groupBy("current", F.col("future").alias("value")).agg(*files), "ADAPTED")
    return stale.unionByName(adapted).distinct()


def correlated(claims: DataFrame, references: DataFrame) -> DataFrame:
    """One row for each claimed field: new names, files, stale and adapted references, coherence."""
    groups = claims.groupBy("current").agg(F.array_sort(F.collect_set("future")).alias("futures"), F.array_sort(F.collect_set("file")).alias("files"))
    states = reference_states(claims, references).groupBy("current").agg(F.count_if(F.col("state") == "STALE").alias("n_stale"), F.count_if(F.col("state") == "ADAPTED").alias("n_adapted"))
    out = groups.join(states, "current", "left").fillna(0, ["n_stale", "n_adapted"])
    conflict = F.size("futures") > 1
    state = rules.coherence(conflict | ((F.col("n_stale") > 0) & (F.col("n_adapted") == 0)), F.col("n_stale") > 0, (F.col("n_adapted") > 0) | (F.size("files") > 1))
    return out.withColumn("coherence", state)


def overall_coherence(groups: DataFrame) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("INCONSISTENT", "PARTIALLY_COHERENT", "UNRESOLVED", "COHERENT")])
    return groups.agg(F.element_at(order, F.min(F.array_position(order, F.col("coherence"))).cast("int")).alias("coherence"), F.count("*").alias("n_groups"), F.sum("n_stale").alias("n_stale"), F.count_if(F.size("futures") > 1).alias("n_conflicts"))


def ungrouped(deltas: DataFrame, groups: DataFrame) -> DataFrame:
    """Deltas of subjects that no group claims, by file and class."""
    rest = deltas.join(groups.select(F.col("current").alias("subject")), "subject", "left_anti")
    return rest.groupBy("file", "delta_class").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def closed_roots(original: DataFrame, projected: DataFrame, targeted: DataFrame, key: str = "root_id") -> DataFrame:
    """Each root after a repair: CLOSED, UNCHANGED, STILL_OPEN (targeted but there) or NEW."""
    a, b, t = (df.select(key).distinct().withColumn(n, F.lit(1)) for df, n in ((original, "_a"), (projected, "_b"), (targeted, "_t")))
    all_ = a.join(b, key, "full_outer").join(t, key, "left")
    state = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "CLOSED").when(F.col("_t").isNotNull(), "STILL_OPEN").otherwise("UNCHANGED")
    return all_.select(key, state.alias("state"))
