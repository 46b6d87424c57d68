"""Snapshots: context by category with attributes of any shape, a content-addressed evidence registry, secrets at any depth, and certification of
stages by digests of buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.store import Levels

# The categories of context, and what names and texts count as secret.
CATEGORIES = ("owner", "domain", "tag", "glossary", "structured_property", "data_product", "document", "pipeline", "bi")
SECRET_KEY, BEARER = r"(?i)(^|_)(token|password|secret|authorization|api_key)($|_)", r"(?i)\bauthorization\s*[:=]\s*bearer\b"


def secret_places(documents: DataFrame, key: str, most: int = 256) -> DataFrame:
    """key, location, why of every secret in a table of JSON texts (column ``json``): a key or a ``name`` that says secret (NAME), a text that holds a
    bearer authorization (TEXT), a text that is no JSON (MALFORMED; judged as a text besides).

    Documents become variants; a level takes the containers of the level before apart, keys and entries alike, until none is left, so any depth is
    seen; no level needs an exchange.  Beyond ``most`` levels it raises.  A null text holds nothing.
    """
    spark = documents.sparkSession
    levels, found = Levels(spark, "depth", "nested"), Levels(spark, "depth", "secrets")
    own = documents.select(key, "json").where("json IS NOT NULL").select(key, "json", F.try_parse_json("json").alias("v"))
    text_of = F.coalesce(F.try_variant_get("v", "$", "string"), F.lit(""))
    bad = own.where("v IS NULL").select(key, F.lit("$").alias("location"), F.explode(F.array_compact(F.array(F.lit("MALFORMED"), F.when(F.col("json").rlike(BEARER), "TEXT")))).alias("why"))
    found.add(bad, 0)
    todo = levels.add(own.where("v IS NOT NULL").select(key, F.lit("$").alias("location"), F.lit("").alias("entry"), F.to_json("v").alias("json")), 0)
    for depth in range(1, most + 1):
        here = todo.select(key, "location", "entry", F.parse_json("json").alias("v")).withColumn("kind", F.schema_of_variant("v"))
        scalar, text = ~F.col("kind").rlike(r"^(OBJECT|ARRAY)<"), F.col("kind") == "STRING"
        # an entry called name says secret for the object that it names
        secret = (text & text_of.rlike(BEARER)) | ((F.col("entry") == "name") & text & text_of.rlike(SECRET_KEY))
        named = F.col("entry").rlike(SECRET_KEY)
        why = F.when(named | ((F.col("entry") == "name") & text & text_of.rlike(SECRET_KEY)), "NAME").when(secret, "TEXT")
        found.add(here.select(key, "location", why.alias("why")).where("why IS NOT NULL"), depth)
        inside = here.where(~scalar).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "at", "inner"))
        place = F.when(F.col("at").isNull(), F.concat(F.col("location"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.col("location"), F.lit("."), F.col("at")))
        todo = levels.add(inside.select(key, place.alias("location"), F.coalesce("at", F.lit("")).alias("entry"), F.to_json("inner").alias("json")), depth)
        if todo.isEmpty():
            return found.all().select(key, "location", "why")
    raise RuntimeError(f"documents of more than {most} levels")


def context_rows(datasets: DataFrame, sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The relationships of all categories as one table, and the state of each dataset and category.

    datasets: dataset_urn; sources: category -> dataset_urn, target_key, resolved (boolean) and attributes of the category's own, which go into one
    variant column.  relationships: category, dataset_urn, target_key, state, attributes; states: dataset_urn, category, state (RESOLVED, PARTIAL, UNRESOLVED,
    EMPTY, or NOT_RETRIEVED for a category without a source), n_targets.
    """
    if unknown := set(sources) - set(CATEGORIES):
        raise ValueError(f"no categories: {sorted(unknown)}")
    spark = datasets.sparkSession

    def one(category: str, df: DataFrame) -> DataFrame:
        more = [c for c in sorted(df.columns) if c not in ("dataset_urn", "target_key", "resolved")]
        attributes = F.to_json(F.struct(*more)) if more else F.lit("{}")
        return df.select(F.lit(category).alias("category"), "dataset_urn", "target_key", F.when(F.coalesce("resolved", F.lit(False)), "RESOLVED").otherwise("UNRESOLVED").alias("state"), F.parse_json(attributes).alias("attributes"))

    parts = [one(c, sources[c]) for c in CATEGORIES if c in sources]
    empty = spark.createDataFrame([], "category string, dataset_urn string, target_key string, state string").withColumn("attributes", F.parse_json(F.lit("{}")))
    # a target that some row resolves is resolved; its attributes are those of that row, then the smallest
    keyed = reduce(DataFrame.unionByName, parts, empty).withColumn("json", F.to_json("attributes")).drop("attributes")
    best = keyed.groupBy("category", "dataset_urn", "target_key").agg(F.min(F.struct("state", "json")).alias("m"))
    relationships = best.select("category", "dataset_urn", "target_key", F.col("m.state").alias("state"), F.parse_json("m.json").alias("attributes"))
    counts = best.groupBy("dataset_urn", "category").agg(F.count("*").alias("n_targets"), F.count_if(F.col("m.state") == "RESOLVED").alias("_n"))
    asked = spark.createDataFrame([(c, c in sources) for c in CATEGORIES], "category string, _asked boolean")
    every = datasets.select("dataset_urn").distinct().join(F.broadcast(asked)).join(counts, ["dataset_urn", "category"], "left")
    n = F.coalesce("n_targets", F.lit(0))
    state = F.when(~F.col("_asked"), "NOT_RETRIEVED").when(n == 0, "EMPTY").when(F.col("_n") == n, "RESOLVED").when(F.col("_n") > 0, "PARTIAL").otherwise("UNRESOLVED")
    return relationships, every.select("dataset_urn", "category", state.alias("state"), n.alias("n_targets"))


#: What an evidence item says; when it was seen is no part of it.
EVIDENCE = ("classification", "source_phase", "subject_key", "interface", "aspect", "source_urn", "target_urn", "relationship_path")


def evidence_id() -> Column:
    """The id that an item's content gives it; keys of attributes count in order, whatever order they came in."""
    path = F.to_json(F.coalesce("relationship_path", F.array().cast("array<string>")))
    return ids.stable_id("evidence", *[path if c == "relationship_path" else F.col(c) for c in EVIDENCE], F.to_json("attributes"))


def evidence_registry(items: DataFrame) -> DataFrame:
    """evidence_id and the columns of EVIDENCE, attributes, observed_at (the first), n_seen: each different item once.

    items: the columns of EVIDENCE, attributes (variant) and observed_at.  Items of one id say the same by construction, so any of them stands.
    """
    own = items.withColumn("evidence_id", evidence_id()).withColumn("_json", F.to_json("attributes"))
    first = own.groupBy("evidence_id").agg(*[F.min(c).alias(c) for c in EVIDENCE], F.min("_json").alias("_json"), F.min("observed_at").alias("observed_at"), F.count("*").alias("n_seen"))
    return first.select("evidence_id", *EVIDENCE, F.parse_json("_json").alias("attributes"), "observed_at", "n_seen")


def evidence_conflicts(stored: DataFrame) -> DataFrame:
    """evidence_id, why of stored items that break the addressing: an id that its content does not give (FORGED), an id that stands for several contents
    (AMBIGUOUS).  stored: as ``evidence_registry`` gives it."""
    own = stored.withColumn("_id", evidence_id())
    forged = own.where(~F.col("evidence_id").eqNullSafe(F.col("_id"))).select("evidence_id", F.lit("FORGED").alias("why"))
    twice = own.groupBy("evidence_id").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a <> b").select("evidence_id", F.lit("AMBIGUOUS").alias("why"))
    return forged.unionByName(twice).distinct()


def bucket_digests(df: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """bucket, n_rows, digest: rows dealt to buckets by their key; a bucket's digest is a sum over its rows' hashes, so neither order nor partitioning
    counts, repeats do, and every task adds up its own part first."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    own = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    sums = own.groupBy("bucket").agg(F.count("*").alias("n_rows"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    return sums.select("bucket", "n_rows", F.concat_ws(":", *[F.col(f"w{i}").cast("string") for i in range(4)]).alias("digest"))


def stage_differences(stored: DataFrame, derived: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """The rows, with their keys, that a stored stage and its derivation do not share, and side: STORED or DERIVED.

    Digests of buckets are compared first; only rows of buckets that differ are compared, and no bucket list grows beyond ``buckets``.
    """
    a, b = bucket_digests(stored, keys, buckets), bucket_digests(derived.select(*stored.columns), keys, buckets)
    same = (F.col("a.digest").eqNullSafe(F.col("b.digest"))) & (F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")))
    other = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer").where(~same).select(F.coalesce("a.bucket", "b.bucket").alias("_bucket"))
    of = lambda df, sign: df.select(*stored.columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), F.lit(sign).alias("_s")).join(F.broadcast(other), "_bucket", "left_semi")
    both = of(stored, 1).unionByName(of(derived.select(*stored.columns), -1)).groupBy(*stored.columns).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return both.select(*keys, F.when(F.col("_s") > 0, "STORED").otherwise("DERIVED").alias("side"), F.abs("_s").alias("n"))


def stage_fingerprint(position: int, stage: str, df: DataFrame) -> DataFrame:
    """position, stage, n_rows, fingerprint of one stage: one row."""
    return ids.table_fingerprint(df).select(F.lit(position).alias("position"), F.lit(stage).alias("stage"), "n_rows", "fingerprint")


def fingerprint_chain(own: DataFrame) -> DataFrame:
    """The rows of ``stage_fingerprint`` with chain, a digest that covers all stages up to each; the stages' rows are not read again."""
    after = lambda done, x: F.array_append(done, F.sha2(F.concat(F.coalesce(F.get(done, F.size(done) - 1), F.lit("")), x["fingerprint"]), 256))
    listed = own.agg(F.array_sort(F.collect_list(F.struct("position", "stage", "n_rows", "fingerprint"))).alias("s"))
    chained = listed.select(F.explode(F.arrays_zip("s", F.aggregate("s", F.array().cast("array<string>"), after).alias("chain"))).alias("r"))
    return chained.select("r.s.*", "r.chain")


def chained_fingerprints(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """position, stage, n_rows, fingerprint, chain: each stage's own fingerprint, and a chain that covers all stages up to it."""
    return fingerprint_chain(reduce(DataFrame.unionByName, [stage_fingerprint(i, name, df) for i, (name, df) in enumerate(stages)]))


def broken_links(certified: DataFrame, found: DataFrame) -> DataFrame:
    """position, stage, state of a chain held against a certified one: SAME, CHANGED (its own rows differ), AFTER_A_CHANGE, MISSING or ADDED."""
    a, b = certified.select("position", "stage", F.col("fingerprint").alias("fa"), F.col("chain").alias("ca")), found.select("position", F.col("stage").alias("sb"), F.col("fingerprint").alias("fb"), F.col("chain").alias("cb"))
    state = F.when(F.col("ca").isNull(), "ADDED").when(F.col("cb").isNull(), "MISSING").when((F.col("fa") != F.col("fb")) | (F.col("stage") != F.col("sb")), "CHANGED").when(F.col("ca") != F.col("cb"), "AFTER_A_CHANGE").otherwise("SAME")
    return a.join(b, "position", "full_outer").select("position", F.coalesce("stage", "sb").alias("stage"), state.alias("state"))
