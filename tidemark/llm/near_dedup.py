"""Near-duplicates by SetSketch registers, and exact confirmation on full shingle sets.

1. Sketch (one pass, no exchange of texts): each document's set of word shingles as 64-bit hashes, a 128-bit fingerprint of the set, and ``REGISTERS``
   SetSketch registers: register i is floor(1 - log_b x) clamped to 0..q+1 for the least exponential value x that the set's elements draw for
   it, so values step down exponentially, sketches of parts merge by maximum, and equal registers are likelier the more alike two sets are.
2. Rows with one fingerprint have one set: they form a class with a number of its own, and the class goes on as one member.
3. ``BANDS`` bands of ``ROWS`` registers: classes that agree in a band share a bucket.  Within each bucket registers alone are compared: where
   the likelihood of the similarity (from the counts of greater, less and equal registers, the sizes known) still rises at the threshold less
   ``ESTIMATE_SLACK``, so that its top lies above, classes are tied, and a spanning forest of the ties leaves the bucket.  Its
   components are *clusters*: each pair that a bucket could link lies in one cluster, and each class in one cluster only.
4. Each cluster's full sets, fetched once, are compared exactly: members take turns as centre against the members of other components,
   until all members outside the largest component have been centres, so no link between components is missed; a spanning
   forest of the links leaves.
5. In a bucket or cluster of more than ``CHUNK`` members, ``PROBES`` of them are first compared with all; the member most like them becomes the
   centre and is compared with all.  Those it links are one component; only the rest still meets the others.  The group is then dealt as chunks
   by hash, and pairs of chunks, other than two of the centre's, go to different tasks: a group around a centre costs in proportion to
   its size, no task holds more than two chunks, and no pairs of members are ever emitted.
6. Links make components over doc_ids, and the class's component goes back to all its rows.

A band agrees with probability about J**ROWS: at J = 0.85 a pair is missed by all bands with probability 7e-6, at 0.8 with 2e-4.

Null and empty texts (and texts of white space) have the empty set: linked with nothing.  Fewer words than a shingle: the whole sequence is the
one shingle.  Rows that share a doc_id count as one document for links: each row's own set may link it.  A null doc_id is never
linked and kept.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, fresh, kept, let_go, owned, texts, utf8, written
from .components import components

#: Words of a shingle and least similarity in per cent, where a caller names none.
SHINGLE, PERCENT = 5, 80
REGISTERS, ROWS = 64, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs estimated this far below the threshold are not confirmed: over five standard errors.
ESTIMATE_SLACK = 0.25
CHUNK, PROBES = 512, 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; words are split at ASCII white space after lower-casing A-Z."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n) * _M3)
    for k in range(n):
        out = (out ^ h[k : len(words) - n + 1 + k]) * _M1
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


#: Odd multipliers, one for each register.
_MULTIPLIERS = (_mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _M2) | np.uint64(1))[:, None]


def least_draws(elements: np.ndarray) -> np.ndarray:
    """For each register the least 64-bit draw over the elements; merges by minimum."""
    out = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(elements), 512):
        x = elements[None, i : i + 512] * _MULTIPLIERS
        x ^= x >> np.uint64(31)
        x *= _M2
        out = np.minimum(out, x.min(1))
    return out


def registers(draws: np.ndarray) -> np.ndarray:
    """Truncated exponents of the exponential values that the draws stand for."""
    u = (draws.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    k = np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / math.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def likelihood(up: np.ndarray, down: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log likelihood of the similarity j given how many of the registers are greater and less, u = n_a / (n_a + n_b).

    With v = 1 - u, register pairs are greater, less or equal with probabilities p(u - v j), p(v - u j) and the rest, where
    p(x) = -log_b(1 - x (b - 1) / b); it is concave in j.
    """
    v = 1.0 - u
    p = lambda x: -np.log(1.0 - np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)
    g, l = p(u - v * j), p(v - u * j)
    return up * np.log(np.maximum(g, 1e-300)) + down * np.log(np.maximum(l, 1e-300)) + (REGISTERS - up - down) * np.log(np.maximum(1 - g - l, 1e-300))


def _sides(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greater and less registers, u, and the most that the similarity can be."""
    u = n_a / (n_a + n_b)
    return (a > b).sum(1), (a < b).sum(1), u, np.minimum(n_a, n_b) / np.maximum(n_a, n_b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likelihood estimate of the Jaccard similarity from rows of registers and the set sizes, by golden section."""
    up, down, u, hi = _sides(a, b, n_a, n_b)
    lo = np.zeros(len(u))
    for _ in range(30):
        m1, m2 = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(up, down, u, m1) > likelihood(up, down, u, m2)
        hi, lo = np.where(left, m2, hi), np.where(left, lo, m1)
    return (lo + hi) / 2


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the likelihood estimate is ``least`` or more: a concave likelihood that still rises there has its top above."""
    up, down, u, most = _sides(a, b, n_a, n_b)
    return (most >= least) & (likelihood(up, down, u, np.minimum(least + 1e-4, most)) >= likelihood(up, down, u, np.full(len(u), least - 1e-4)))


SKETCH = "doc_id long, text_hash long, n long, fp1 long, fp2 long, registers binary"


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, a hash of the text, set size, fingerprint and registers of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("registers", pa.binary())])

    def run(batches):
        let_go()
        for b in batches:
            n, f1, f2, regs = [], [], [], []
            for t in utf8(b.column("text")):
                s = shingles(t, size)
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(_mix(s + _M2).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                regs.append(registers(least_draws(s)).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(x, pa.int64()) for x in (n, f1, f2)), pa.array(regs, pa.binary())], schema=schema)
        let_go()

    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SKETCH)


def _packed(s: np.ndarray) -> bytes:
    """Six bytes of each hash, ascending."""
    return np.unique(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if len(s) else b""


def _unpacked(x: bytes) -> np.ndarray:
    raw = np.zeros((len(x) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view(np.uint64)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, elements: the full sets of the classes in wanted (id, doc_id, text_hash: a row that has the set)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_packed(shingles(t, size)) for t in utf8(b.column("text"))], pa.binary())], ["id", "elements"])
        let_go()

    own = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return own.join(wanted, ["doc_id", "text_hash"]).select("id", "text").mapInArrow(run, "id long, elements binary").dropDuplicates(["id"])


def _grouped(df: DataFrame, keys: list[str], make, schema: str, twos=None) -> DataFrame:
    """make(table of one group) -> a record batch or None, for each group of the keys; rows stream in sorted order, a group at a time and
    by id in it, so that buckets with the same members give the same pairs.  ``twos(batch, firsts)`` takes all groups of two rows
    that a batch holds at once.  The work is in the tasks, not in the bytes, so the number of partitions is stated."""

    def run(batches):
        let_go()
        held, last = [], None
        for x in batches:
            if not x.num_rows:
                continue
            k = [x.column(c).to_numpy(zero_copy_only=False) for c in keys]
            starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1])
            ends = np.append(starts[1:], x.num_rows)
            if twos is not None:
                # The first and the last group of a batch may go on in another one.
                small = (ends - starts == 2) & (starts > 0) & (ends < x.num_rows)
                if small.any() and (y := twos(x, starts[small])) is not None:
                    yield y
                starts, ends = starts[~small], ends[~small]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                key = tuple(c[s] for c in k)
                if key != last and held:
                    if (y := make(pa.Table.from_batches(held).combine_chunks())) is not None:
                        yield y
                    held = []
                held.append(x.slice(s, e - s))
                last = key
        if held and (y := make(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield y
        held = None
        let_go()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, "id").mapInArrow(run, schema)


PAIR = "a long, b long"


def _pairs(a, b) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if len(a) else None


class Registers:
    """Comparing by registers: the columns it needs, similarity of one member to others, and whether they are tied."""

    columns = ("n", "registers")

    def __init__(self, percent: int):
        self.percent, self.least = percent, percent / 100 - ESTIMATE_SLACK

    def read(self, t) -> tuple:
        return t.column("n").to_numpy().astype(float), np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(t.num_rows, REGISTERS)

    def linked(self, own: tuple, c: int, others: np.ndarray) -> np.ndarray:
        n, r = own
        others = others[np.minimum(n[others], n[c]) * 100 >= self.percent * np.maximum(n[others], n[c])]
        if not len(others):
            return others
        return others[likely(np.broadcast_to(r[c], (len(others), REGISTERS)), r[others], np.full(len(others), n[c]), n[others], self.least)]

    def similar(self, own: tuple, c: int) -> np.ndarray:
        """Of each member, on a scale of its own."""
        n, r = own
        return (r == r[c]).sum(1) * (np.minimum(n, n[c]) / np.maximum(n, n[c]))

    def twos(self, x: pa.RecordBatch, firsts: np.ndarray) -> pa.RecordBatch | None:
        n, r = self.read(x)
        ids, seconds = x.column("id").to_numpy(), firsts + 1
        fits = np.minimum(n[firsts], n[seconds]) * 100 >= self.percent * np.maximum(n[firsts], n[seconds])
        firsts, seconds = firsts[fits], seconds[fits]
        hit = likely(r[firsts], r[seconds], n[firsts], n[seconds], self.least) if len(firsts) else np.zeros(0, bool)
        return _pairs(ids[firsts[hit]], ids[seconds[hit]])


class Sets:
    """Comparing by full sets: 100 * intersection >= percent * union, exactly."""

    columns = ("elements",)
    twos = None

    def __init__(self, percent: int):
        self.percent = percent

    def read(self, t) -> tuple:
        sets = [_unpacked(x) for x in t.column("elements").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        return size, place, np.concatenate([[0], np.cumsum(size)[:-1]]), np.zeros(place.max() + 1, bool)

    def both(self, own: tuple, c: int) -> np.ndarray:
        size, place, starts, mark = own
        mine = place[starts[c] : starts[c] + size[c]]
        mark[mine] = True
        n = np.add.reduceat(mark[place], starts, dtype=np.int64)
        mark[mine] = False
        return n

    def linked(self, own: tuple, c: int, others: np.ndarray) -> np.ndarray:
        size, both = own[0], self.both(own, c)
        return others[100 * both[others] >= self.percent * (size[c] + size[others] - both[others])]

    def similar(self, own: tuple, c: int) -> np.ndarray:
        size, both = own[0], self.both(own, c)
        return both / (size[c] + size - both)


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, centre: int, others: np.ndarray) -> np.ndarray:
        """Joins the centre with the others; returns one of each component that was new to it."""
        top = self.roots()
        top = top.copy()
        _, first = np.unique(top[others], return_index=True)
        new = others[first]
        new = new[top[new] != top[centre]]
        least = min(top[centre], *top[new]) if len(new) else top[centre]
        self.up = np.where(np.isin(top, np.append(top[new], top[centre])), least, top)
        return new


def _spanning(n: int, linked_to, joined: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph whose neighbours of i among candidates linked_to(i, candidates) gives; members in ``joined`` are known to be
    of one component.

    Centres come from the largest component while they gain, then every member outside it takes its turn: after that no two components
    have an untested pair.
    """
    forest, been = _Forest(n), np.zeros(n, bool)
    a, b = [], []
    known = joined is not None and joined.sum() > 1
    if known:
        forest.up[joined] = np.flatnonzero(joined)[0]

    def turn(c: int) -> int:
        been[c] = True
        others = np.flatnonzero(forest.roots() != forest.roots()[c])
        new = forest.join(c, linked_to(c, others)) if len(others) else others
        a.extend([c] * len(new))
        b.extend(new.tolist())
        return len(new)

    c = int(np.flatnonzero(joined)[0]) if known else 0
    while True:
        gained = turn(c)
        roots = forest.roots()
        names, counts = np.unique(roots, return_counts=True)
        if len(names) == 1:
            return a, b
        inside = roots == names[counts.argmax()]
        fresh = np.flatnonzero(inside & ~been) if gained else np.empty(0, int)
        if not len(fresh):
            fresh = np.flatnonzero(~inside & ~been)
        if not len(fresh):
            return a, b
        c = int(fresh[0])


def _forests(rows: DataFrame, key: str, facts: DataFrame, by, name: str) -> DataFrame:
    """a, b: spanning forests of the links within the groups of rows (key, id); facts: id and the columns that ``by`` compares."""
    spark = rows.sparkSession
    members = rows.groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    own = kept(rows.join(members, key).select(key, "id", "members"), spark, f"{name}-members")
    small = own.where(F.col("members") <= CHUNK).select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), "id", F.lit(False).alias("central"))
    big = own.where(F.col("members") > CHUNK)
    stars = None
    if big.limit(1).count():
        stars, dealt = _around_centres(big, key, facts, by, name)
        small = small.unionByName(dealt)

    def forest(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        ids, read = t.column("id").to_numpy(), by.read(t)
        a, b = _spanning(len(ids), lambda c, others: by.linked(read, c, others), t.column("central").to_numpy(zero_copy_only=False).astype(bool))
        return _pairs(ids[a], ids[b])

    found = _grouped(small.join(facts, "id").select(key, "i", "j", "id", "central", *by.columns), [key, "i", "j"], forest, PAIR, by.twos)
    return found if stars is None else found.unionByName(stars)


def _around_centres(big: DataFrame, key: str, facts: DataFrame, by, name: str) -> tuple[DataFrame, DataFrame]:
    """The links of each group's centre with its members, and the pairs of chunks (key, i, j, id, central) in which the rest meets all.

    A few probes (those whose ids hash lowest) are compared with every member; the centre is the member most like them.  Both go to
    all of a group's lanes of about CHUNK members, so no task sees a whole group.
    """
    spark = big.sparkSession
    lanes = F.ceil(F.col("members") / CHUNK).cast("int")
    lane = F.pmod(F.xxhash64("id"), lanes).cast("int")
    hashed = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    some = F.collect_set(F.when(F.pmod(F.xxhash64("id"), F.col("members")) < 4 * PROBES, hashed))
    probe = big.groupBy(key, "members").agg(F.slice(F.array_sort(F.array_union(some, F.array(F.min(hashed)))), 1, PROBES).alias("p"))
    probe = kept(probe.select(key, "members", F.explode("p.id").alias("id")), spark, f"{name}-probes")

    def compared(chosen: DataFrame, make, schema: str) -> DataFrame:
        """make over each lane: its members, and the chosen ones as ``probe``."""
        rest = big.join(chosen.select(key, "id"), [key, "id"], "left_anti").select(key, lane.alias("lane"), "id", F.lit(False).alias("probe"))
        sent = chosen.select(key, F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), "id", F.lit(True).alias("probe"))
        return _grouped(rest.unionByName(sent).join(facts, "id").select(key, "lane", "id", "probe", *by.columns), [key, "lane"], make, schema)

    def likeness(t: pa.Table) -> pa.RecordBatch:
        probes, read = np.flatnonzero(t.column("probe").to_numpy(zero_copy_only=False)), by.read(t)
        score, met = np.zeros(t.num_rows), np.full(t.num_rows, len(probes))
        met[probes] -= 1
        for c in probes:
            own = by.similar(read, c)
            own[c] = 0
            score += own
        score /= np.maximum(met, 1)
        best = int(score.argmax())
        return pa.RecordBatch.from_arrays([t.column(key)[:1].combine_chunks(), t.column("id")[best : best + 1].combine_chunks(), pa.array(score[best : best + 1])], [key, "id", "score"])

    top = compared(probe, likeness, f"{key} long, id long, score double").groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m"))
    centre = kept(top.join(probe.select(key, "members").distinct(), key).select(key, "members", F.col("m.id").alias("id")), spark, f"{name}-centres")

    def star(t: pa.Table) -> pa.RecordBatch | None:
        c, ids = int(np.flatnonzero(t.column("probe").to_numpy(zero_copy_only=False))[0]), t.column("id").to_numpy()
        hit = by.linked(by.read(t), c, np.flatnonzero(np.arange(len(ids)) != c))
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array([t.column(key)[0].as_py()] * len(hit), pa.int64()), pa.array(np.full(len(hit), ids[c])), pa.array(ids[hit])], [key, "a", "b"])

    stars = kept(compared(centre, star, f"{key} long, a long, b long"), spark, f"{name}-stars")
    around = stars.select(key, F.col("b").alias("id")).unionByName(centre.select(key, "id")).withColumn("central", F.lit(True))
    state = kept(big.join(around, [key, "id"], "left").select(key, "id", F.coalesce("central", F.lit(False)).alias("central")), spark, f"{name}-state")
    chunks = lambda c: F.ceil(F.count_if(c) / CHUNK).cast("int")
    counts = state.groupBy(key).agg(chunks(~F.col("central")).alias("rest"), chunks(F.col("central")).alias("mid")).where("rest > 0").withColumnRenamed(key, "_key")
    own = state.join(counts, state[key] == F.col("_key")).drop("_key")
    # Chunks 0..rest-1 hold the rest, those behind the centre's component; two of the latter need not meet.
    mine = F.when(F.col("central"), F.col("rest") + F.pmod(F.xxhash64("id"), F.greatest("mid", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("central"), F.col("rest")).otherwise(F.col("rest") + F.col("mid")) - 1)
    pairs = F.transform(other, lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    dealt = own.select(key, "id", "central", F.explode(pairs).alias("p")).select(key, F.col("p.i").alias("i"), F.col("p.j").alias("j"), "id", "central")
    return stars.select("a", "b"), dealt


def linked(docs: DataFrame, sketches: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """classes (fp1, fp2, n, doc_id: the smallest that has the set) and node, label over doc_ids that have links."""
    spark = docs.sparkSession
    whole = sketches.where("n > 0 and doc_id is not null")
    first = whole.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "text_hash", "registers")).alias("m"))
    # The numbers are those that were written, whatever becomes of the task that gave them.
    classes = kept(first.select(F.monotonically_increasing_id().alias("id"), "fp1", "fp2", "n", "m.*"), spark, "classes")
    width = 2 * ROWS
    bands = classes.select("id", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + i * width, width)) for i in range(BANDS)])).alias("bucket"))
    ties = kept(_forests(bands, "bucket", classes.select("id", "n", "registers"), Registers(percent), "bucket").distinct(), spark, "ties")
    clusters = components(ties).select(F.col("label").alias("cluster"), F.col("node").alias("id"))
    sets = kept(_sets(docs, classes.join(clusters, "id").select("id", "doc_id", "text_hash"), size), spark, "sets")
    found = kept(_forests(clusters, "cluster", sets, Sets(percent), "cluster"), spark, "confirmed")
    names = classes.select("id", "doc_id")
    links = found.join(names.select(F.col("id").alias("a"), F.col("doc_id").alias("da")), "a").join(names.select(F.col("id").alias("b"), F.col("doc_id").alias("db")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    # A doc_id with several sets ties their classes.
    several = kept(whole.groupBy("doc_id").agg(F.min("fp1").alias("f1"), F.max("fp1").alias("f2"), F.min("fp2").alias("f3"), F.max("fp2").alias("f4")).where("f1 <> f2 or f3 <> f4").select("doc_id"), spark, "several")
    if several.limit(1).count():
        own = whole.select("doc_id", "fp1", "fp2", "n").join(several, "doc_id").distinct()
        links = links.unionByName(own.join(classes.select("fp1", "fp2", "n", F.col("doc_id").alias("b")), ["fp1", "fp2", "n"]).select(F.col("doc_id").alias("a"), "b"))
    return classes, components(links)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    with owned(spark) as owner:
        sketches = owner.result(sketch(docs, size), "sketch")
        classes, labels = linked(docs, sketches, size, percent)
        named = classes.join(labels, classes["doc_id"] == labels["node"], "left").select(F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.col("n").alias("c_n"), F.coalesce("label", "doc_id").alias("label"))
        named = owner.result(named, "named")
    own = sketches.select("doc_id", "n", "fp1", "fp2")
    joined = own.join(named, (own["fp1"] == named["c1"]) & (own["fp2"] == named["c2"]) & (own["n"] == named["c_n"]) & own["doc_id"].isNotNull(), "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, one of each component, with all their columns as they were; of rows that share a doc_id one stays, that
    whose columns hash lowest.  Rows without a doc_id stay."""
    spark = docs.sparkSession
    gone, row, own = (fresh(docs, c) for c in ("_gone", "_row", "_own"))
    ids = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(ids, docs["doc_id"] == F.col(gone), "left_anti")
    # Only ids and hashes are exchanged to see whether any id repeats.
    plain = [F.to_json(F.struct(c)) if isinstance(t, (T.MapType, T.VariantType)) else F.col(f"`{c}`") for c, t in ((f.name, f.dataType) for f in docs.schema.fields)]
    of_row = F.xxhash64(*plain)
    twice = docs.where("doc_id is not null").select("doc_id", of_row.alias("h")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n > 1")
    twice, path = written(twice.select(F.col("doc_id").alias(gone), F.col("h").alias(row)), spark, "twice")
    if not twice.limit(1).count():
        drop(spark, path)
        return left
    once = left.join(twice.select(gone), left["doc_id"] == F.col(gone), "left_anti")
    rest = left.withColumn(own, of_row).join(twice, (left["doc_id"] == F.col(gone)) & (F.col(own) == F.col(row)), "left_semi").drop(own)
    return once.unionByName(rest.dropDuplicates(["doc_id"]))
