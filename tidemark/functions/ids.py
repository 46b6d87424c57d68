"""Identifiers, fingerprints and text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
VOLATILE = ("created_at", "generated_at", "output_dir")
#: The catalog's type classes and the categories they stand for.
TYPE_CATEGORIES = {"NumberType": "Number", "StringType": "String", "BooleanType": "Boolean", "DateType": "Date", "TimeType": "Time", "BytesType": "Bytes", "MapType": "Map", "ArrayType": "Array", "RecordType": "Record", "NullType": "Null", "UnionType": "Unknown"}


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """prefix-hex of the SHA-256 of the parts; a null part counts as empty."""
    joined = F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, length))


def content_fingerprint(content: Column) -> Column:
    """sha256 of a text whose line ends count as line feeds."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(content, "\r\n?", "\n"), 256))


def row_json(columns: list[str]) -> Column:
    """A row as JSON with sorted keys, without volatile columns."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if c not in VOLATILE]), {"ignoreNullFields": "false"})


def table_fingerprint(df):
    """One row: a fingerprint of the multiset of rows that no ordering, partitioning or volatile column changes.

    Row digests are added up as 16 numbers of 16 bits (exact long sums, partial in each task), so no task holds all rows.  They are cut from four
    numbers of 64 bits, as reading a number from text costs more than the digest itself.
    """
    digest = F.sha2(row_json(df.columns), 256)
    longs = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)]
    words = [F.shiftrightunsigned(longs[i // 4], 48 - 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)) for i in range(16)]
    sums = df.select(*[w.alias(f"w{i}") for i, w in enumerate(words)]).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in range(16)])
    return sums.select("n_rows", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(16)]), 256)).alias("fingerprint"))


def normalized_type(name: Column) -> Column:
    """The category of a catalog type class; anything else is Unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_CATEGORIES.items() for x in kv]), name), F.lit("Unknown"))


def leaf_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def urn_part(urn: Column, part: str) -> Column:
    """platform, name or environment of urn:li:dataset:(urn:li:dataPlatform:P,N,E)."""
    at = {"platform": 1, "name": 2, "environment": 3}[part]
    return F.nullif(F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),(.+),([^,)]+)\)$", at), F.lit(""))


def dataset_urn(platform: Column, name: Column, environment: Column) -> Column:
    return F.format_string("urn:li:dataset:(urn:li:dataPlatform:%s,%s,%s)", platform, name, environment)


def documentation(content: Column) -> Column:
    """Lines trimmed, blank ones gone."""
    return F.array_join(F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def redacted(text: Column, secrets: list[str]) -> Column:
    out = text
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return out


def holds_credentials(text: Column) -> Column:
    return text.rlike(r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[:=]\s*\S+)")


def safe_path(path: Column) -> Column:
    """A relative path without empty, dot or dot-dot parts, backslashes, drives or NULs."""
    parts = F.split(path, "/")
    return (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|\x00") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def humanized(x: Column) -> Column:
    return F.initcap(F.regexp_replace(x, "[_-]+", " "))


def compact_id(x: Column, head: int = 12, tail: int = 6) -> Column:
    return F.when(F.length(x) <= head + tail + 1, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("…"), F.substring(x, -tail, tail)))
