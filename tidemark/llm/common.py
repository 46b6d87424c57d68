"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import store
from tidemark.functions.store import Scratch, drop, shared_dir  # noqa: F401

#: ASCII white space, the separators of words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the other named columns; every other column goes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and the path, for ``drop`` when nothing reads it any more."""
    return store.written(df, name)


_OWNERS: list[Scratch] = []


@contextmanager
def owned(spark: SparkSession):
    """What ``kept`` writes in the block is deleted when it ends, but for what the block's owner writes by ``result``."""
    with Scratch(spark) as owner:
        _OWNERS.append(owner)
        try:
            yield owner
        finally:
            _OWNERS.pop()


def claimed(path: str) -> None:
    """Leave a written table to the block that runs, if any."""
    if _OWNERS:
        _OWNERS[-1].paths.append(path)


def kept(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: short lineage, and safe from lost executors."""
    df, path = store.written(df, name)
    claimed(path)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_sample(df: DataFrame, wanted: int, *key: str, by: str | None = None, groups: int | None = 512) -> DataFrame:
    """At most ``wanted`` different rows (of each value of ``by``), those whose key hashes lowest: the same rows at any partitioning.

    The key should name all columns that tell rows apart; rows with one key count once, so neither null ids nor a repeated row can swell the
    sample.  Rows are counted first and a share of the hash range is taken; where repeats leave it short, the share grows until the sample
    is full or the table is read whole.  The sample is cut by a window over its own few rows, and written to the shared folder.  Of ``by`` the
    ``groups`` most frequent values are taken (None: every value; only their counts reach the driver; rows with
    a null there are left out).
    """
    spark = df.sparkSession
    group, h, n, k = (fresh(df, c) for c in ("_group", "_hash", "_rows", "_place"))
    own = df.withColumn(h, F.xxhash64(*[F.col(c).cast("string") for c in key])).withColumn(group, F.col(by).cast("string") if by else F.lit(""))
    counted = own.groupBy(group).agg(F.count("*").alias(n)).orderBy(F.desc(n), group)
    counts = {r[0]: r[1] for r in (counted if groups is None else counted.limit(groups)).collect() if r[0] is not None}
    order = Window.partitionBy(group).orderBy(h)
    want, out, least = dict.fromkeys(counts, 1.3), None, wanted // 2
    while want:
        shares = spark.createDataFrame([(g, min(1.0, f * wanted / counts[g])) for g, f in want.items()], f"`{group}` string, `{n}` double")
        unit = F.pmod(F.col(h), F.lit(1 << 40)) / F.lit(float(1 << 40))
        part = own.join(F.broadcast(shares), group).where(unit < F.col(n)).dropDuplicates([group, h])
        part, path = written(part.withColumn(k, F.row_number().over(order)).where(F.col(k) <= wanted).drop(n, k), spark, "sample")
        got = {r[0]: r[1] for r in part.groupBy(group).count().collect()}
        short = {g: f * 16 for g, f in want.items() if got.get(g, 0) < least and f * wanted < counts[g]}
        full = [g for g in want if g not in short]
        if full:
            part = part.where(F.col(group).isin(full)) if short else part
            out = part if out is None else out.unionByName(part)
        else:
            drop(spark, path)
        want = short
    return (out if out is not None else own.limit(0)).drop(group, h)


def utf8(column: pa.Array) -> list:
    """The values as bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


#: Rows of a batch that are worked on at a time where whole texts pass through a Python worker.
PART_ROWS = 250


def parts(batches):
    """Batches in slices of few rows: Spark's own hold up to 64 MB, and a worker would keep copies of all their texts, and what it gives back, beside them."""
    for b in batches:
        for i in range(0, b.num_rows, PART_ROWS):
            yield b.slice(i, PART_ROWS)


class Generations(dict):
    """A bounded cache: when the young half is full it becomes the old one, from which what is asked for again is taken back.

    Subclasses give ``compute(key)``; ``fits(key)`` says whether a key may be kept.
    """

    def __init__(self, entries: int):
        super().__init__()
        self.most, self.old = entries // 2, {}

    def fits(self, key) -> bool:
        return len(key) <= 64

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if self.fits(key):
            self.put(key, value)
        return value


def _byte_letters() -> dict[int, str]:
    """The visible stand-ins that byte-level BPE vocabularies use for bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def byte_level(word: str) -> str:
    """A word as a byte-level vocabulary writes it."""
    return word.encode().decode("latin-1").translate(_LETTERS)


def simple(word: str) -> bool:
    """Letters of ASCII and Latin-1 alone: one pre-token in any byte-level pre-tokenizer, in normal form already, lower-cased letter by letter."""
    return word.isalpha() and max(word) < "\u0100"


_HELD: dict = {}


def trimmed() -> None:
    """Give memory that this Python worker no longer uses back to the system: workers idle for a while beside those that run."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Drop the caches that this Python worker holds for another operator; operators without caches begin and end with it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    trimmed()


def held(kind, *args):
    """One ``kind(*args)`` for each Python worker, kept from task to task until the worker takes up another operator."""
    key = (kind.__module__, kind.__qualname__, *args)
    if key not in _HELD:
        let_go()
        _HELD[key] = kind(*args)
    return _HELD[key]
