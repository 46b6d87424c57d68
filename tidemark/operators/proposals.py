"""Change proposals: strict shapes, preconditions against a snapshot, and the contract of what may change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import safe_path

#: Keys of a structural proposal, required and optional, and those that each operation adds.
REQUIRED = ("proposal_id", "analysis_id", "operation", "dataset_urn", "current_field_path", "source_snapshot_fingerprint")
OPTIONAL = ("source_snapshot_id", "description", "created_at", "proposal_metadata")
BY_OPERATION = {"FIELD_RENAME": ("proposed_field_path",), "FIELD_DELETE": (), "FIELD_TYPE_CHANGE": ("proposed_native_type", "proposed_normalized_type")}
TYPE_DETAILS = ("precision", "scale", "length")
CATEGORIES = {"NUMBER", "STRING", "BOOLEAN", "DATE", "TIME", "DATETIME", "BYTES", "MAP", "ARRAY", "STRUCT", "UNKNOWN"}


def validated(proposal: dict) -> dict:
    """The proposal, or ValueError: unknown or missing keys, wrong kinds, nothing coerced."""
    operation = proposal.get("operation")
    if operation not in BY_OPERATION:
        raise ValueError(f"unknown operation {operation!r}")
    own = BY_OPERATION[operation]
    more = TYPE_DETAILS if operation == "FIELD_TYPE_CHANGE" else ()
    if extra := proposal.keys() - {*REQUIRED, *OPTIONAL, *own, *more}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    for k in (*REQUIRED, *own):
        if not isinstance(proposal.get(k), str) or not proposal[k].strip():
            raise ValueError(f"{k} must be a text")
    for k in more:
        if k in proposal and (isinstance(proposal[k], bool) or not isinstance(proposal[k], int) or proposal[k] < 0):
            raise ValueError(f"{k} must be a whole number")
    if not proposal["source_snapshot_fingerprint"].startswith("sha256:"):
        raise ValueError("the fingerprint is no sha256")
    if operation == "FIELD_RENAME" and proposal["proposed_field_path"] == proposal["current_field_path"]:
        raise ValueError("the name does not change")
    if operation == "FIELD_TYPE_CHANGE" and proposal["proposed_normalized_type"] not in CATEGORIES:
        raise ValueError("unknown category")
    return proposal


def preconditions(proposal: dict, schema: DataFrame, fingerprint: str) -> DataFrame:
    """name, status, expected, observed: what the proposal takes for granted, checked against the schema (dataset_urn, field_path, native_type)."""
    new = proposal.get("proposed_field_path")
    here = F.col("dataset_urn") == proposal["dataset_urn"]
    counts = schema.agg(
        F.count_if(here).alias("dataset"), F.count_if(here & (F.col("field_path") == proposal["current_field_path"])).alias("field"),
        F.count_if(here & (F.col("field_path") == F.lit(new))).alias("taken"), F.max(F.when(here & (F.col("field_path") == proposal["current_field_path"]), F.col("native_type"))).alias("native"),
    )
    checks = [
        ("snapshot_fingerprint", F.lit(proposal["source_snapshot_fingerprint"]) == F.lit(fingerprint), F.lit(fingerprint), F.lit(proposal["source_snapshot_fingerprint"])),
        ("dataset_is_known", F.col("dataset") > 0, F.lit("1 or more fields"), F.col("dataset").cast("string")),
        ("field_is_there_once", F.col("field") == 1, F.lit("1"), F.col("field").cast("string")),
        ("new_name_is_free", F.col("taken") == 0, F.lit("0"), F.col("taken").cast("string")),
        ("type_changes", F.lit(proposal.get("proposed_native_type")).isNull() | (F.col("native") != F.lit(proposal.get("proposed_native_type"))), F.lit("another type"), F.col("native")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.coalesce(ok, F.lit(False)), "PASSED").otherwise("FAILED").alias("status"), e.cast("string").alias("expected"), o.cast("string").alias("observed")) for n, ok, e, o in checks])
    return counts.select(F.inline(rows))


def verdict(checks: DataFrame) -> DataFrame:
    """VALID; STALE_BASELINE where the fingerprint alone fails; else INVALID."""
    failed, stale = F.count_if(F.col("status") == "FAILED"), F.count_if((F.col("status") == "FAILED") & (F.col("name") == "snapshot_fingerprint"))
    return checks.agg(F.when(failed == 0, "VALID").when((failed == 1) & (stale == 1), "STALE_BASELINE").otherwise("INVALID").alias("state"), failed.alias("n_failed"))


#: What each operation changes, leaves and must not touch.
CONTRACT = [
    ("FIELD_RENAME", "field_path", "CHANGED"), ("FIELD_RENAME", "native_type", "UNCHANGED"), ("FIELD_RENAME", "position", "UNCHANGED"), ("FIELD_RENAME", "consumers", "UNKNOWN"),
    ("FIELD_DELETE", "field_path", "REMOVED"), ("FIELD_DELETE", "consumers", "UNKNOWN"),
    ("FIELD_TYPE_CHANGE", "native_type", "CHANGED"), ("FIELD_TYPE_CHANGE", "field_path", "UNCHANGED"), ("FIELD_TYPE_CHANGE", "consumers", "UNKNOWN"),
]


def contract(spark, operation: str) -> DataFrame:
    return spark.createDataFrame([r for r in CONTRACT if r[0] == operation], "operation string, property string, state string")


def within_limits(files: DataFrame, max_files: int = 200, max_bytes: int = 1_048_576) -> DataFrame:
    """name, passed, observed of a change request's files (path, size)."""
    n = files.agg(F.count("*").alias("files"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(~F.coalesce(safe_path(F.col("path")), F.lit(False))).alias("unsafe"))
    rows = F.array(*[F.struct(F.lit(k).alias("name"), ok.alias("passed"), o.cast("string").alias("observed")) for k, ok, o in (("files", F.col("files") <= max_files, F.col("files")), ("bytes", F.col("largest") <= max_bytes, F.col("largest")), ("paths", F.col("unsafe") == 0, F.col("unsafe")))])
    return n.select(F.inline(rows))
