"""Invariants as data: uniqueness, foreign keys, counts, fingerprints, and recomputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import holds_credentials, table_fingerprint

CHECKS = "name string, passed boolean, expected string, observed string"


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """No key twice: keys are counted by partial aggregates, only the count of repeats is kept."""
    return _check(name, df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n")), "0 repeated")


def holders(key: str, *registries: DataFrame) -> DataFrame:
    """key, held: every key of the registries (up to 62) once, and a bit for each registry that holds it; null is no key.

    One aggregate over all of them: keys shrink before the exchange, whatever their number.  A join of distinct keys does not always, as Spark pushes a semi
    or anti join below the distinct where it takes one side for small, and sorts all rows when that proves wrong.
    """
    sides = [df.select(F.col(key), F.lit(1 << i).cast("long").alias("held")) for i, df in enumerate(registries)]
    return reduce(DataFrame.unionByName, sides).where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or("held").alias("held"))


def references_of(other: DataFrame, key: str, columns: dict[str, DataFrame]) -> DataFrame:
    """For each name: every value of its one column is a key of the other registry.  One aggregate for all names."""
    own = holders(key, other, *[df.toDF(key) for df in columns.values()])
    lost = lambda bit: F.count_if((F.col("held").bitwiseAND(F.lit(1)) == 0) & (F.col("held").bitwiseAND(F.lit(1 << bit)) != 0))
    counts = own.agg(*[lost(i).alias(f"n{i}") for i in range(1, len(columns) + 1)])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, name in enumerate(columns, 1)])
    return _check(F.col("name"), counts.select(F.inline(rows)), "0 dangling")


def references(df: DataFrame, column: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """Every value of the column is a key of the other registry."""
    return references_of(other, key, {name: df.select(column)})


def without_secrets(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return _check(name, df.agg(F.count_if(reduce(lambda a, b: a | b, [F.coalesce(holds_credentials(F.col(c)), F.lit(False)) for c in columns])).alias("n")), "0 with secrets")


def same_rows(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Two registries hold the same rows, as often: rows are counted signed and cancel out."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    return _check(name, both.groupBy(*columns).agg(F.sum("_s").alias("s")).agg(F.count_if(F.col("s") != 0).alias("n")), "0 different")


def has_fingerprint(df: DataFrame, expected: str, name: str) -> DataFrame:
    return table_fingerprint(df).select(F.lit(name).alias("name"), (F.col("fingerprint") == expected).alias("passed"), F.lit(expected).alias("expected"), F.col("fingerprint").alias("observed"))


def counted(df: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """A registry has as many rows as another source declares.  expected: one row, n."""
    both = df.agg(F.count("*").alias("n")).join(F.broadcast(expected.select(F.col("n").cast("long").alias("_n"))))
    return both.select(F.lit(name).alias("name"), F.col("n").eqNullSafe(F.col("_n")).alias("passed"), F.col("_n").cast("string").alias("expected"), F.col("n").cast("string").alias("observed"))


def value_is(df: DataFrame, column: str, expected: DataFrame, name: str) -> DataFrame:
    """The one value of a column is the one that another source declares; several values or none fail.  expected: one row, v."""
    own = df.agg(F.count_distinct(column).alias("k"), F.min(F.col(column).cast("string")).alias("v")).join(F.broadcast(expected.select(F.col("v").cast("string").alias("_v"))))
    return own.select(F.lit(name).alias("name"), ((F.col("k") == 1) & F.col("v").eqNullSafe(F.col("_v"))).alias("passed"), F.col("_v").alias("expected"), F.when(F.col("k") <= 1, F.coalesce("v", F.lit("nothing"))).otherwise(F.concat(F.col("k").cast("string"), F.lit(" values"))).alias("observed"))


def every(df: DataFrame, condition, name: str) -> DataFrame:
    """A condition holds in every row (a null does not)."""
    return _check(name, df.agg(F.count_if(~F.coalesce(condition, F.lit(False))).alias("n")), "0 failing")


def elements(df: DataFrame, column: str) -> DataFrame:
    """The elements of an array column as rows."""
    return df.select(F.explode(column).alias(column))


def elements_known(df: DataFrame, column: str, other: DataFrame, key: str, name: str) -> DataFrame:
    """Every element of an array column is a key of the other registry."""
    return references(elements(df, column), column, other, key, name)


def _check(name, n: DataFrame, expected: str) -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    return n.select(name.alias("name"), (F.col("n") == 0).alias("passed"), F.lit(expected).alias("expected"), F.col("n").cast("string").alias("observed"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"), F.when(F.bool_and("passed"), "CERTIFIED").otherwise("REJECTED").alias("verdict"))


def snapshot_summary(fields: DataFrame, edges: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts; each registry is counted on its own and only the counts are joined."""
    a = fields.agg(F.count("*").alias("n_fields"), F.count_distinct("dataset_urn").alias("n_datasets"))
    b = edges.agg(F.count("*").alias("n_edges"))
    c = groups.agg(F.count("*").alias("n_groups"))
    d = links.agg(F.count("*").alias("n_relationships"), F.count_distinct("target_key").alias("n_assets"))
    out = None
    for x in (a, b, c, d):
        x = x.withColumn("_one", F.lit(1))
        out = x if out is None else out.join(F.broadcast(x), "_one")
    return out.drop("_one")
