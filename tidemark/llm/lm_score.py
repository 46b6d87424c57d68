"""Scoring whole documents with a gated recurrent language model and with smoothed unigram counts.

1. Counts of all words of all training documents: partial counts in each task, one exchange.  They grow with the corpus and stay in a
   written table; the ``TIER`` most frequent words alone (and three sums) reach the driver.
2. The model knows the end of a text, ``WORDS`` frequent words and one place for all others; its output layer starts from the counts.  It
   is learned by data-parallel rounds: a hash deals every training document (coded once, for learning and scoring) to one round and one shard of it (of ``SHARD_WORDS``
   words on average, so their number follows from the corpus alone, not from its partitions); each shard trains a replica of the current weights,
   longer documents first and else in order of the hash, by truncated backpropagation over all windows of ``WINDOW`` words, the state running on from window to window, and the
   replicas are averaged, weighted by words, in two exchanges of weight blocks.
3. Scoring carries the state across windows through each whole document.  Words of the broadcast tier have their counts at hand; the
   others are joined with the count table and summed by document.

The model's probability of a word it has no place for is that of its place for all others, times the word's smoothed share
(c + 0.5) / (N' + 0.5 (V' + 1)) of the words without a place, so that probabilities sum to one over the known words and one unknown.

Null and empty texts are the end alone.  No training rows: N = V = 0 and the base score is 0 for the sole smoothed outcome.  Repeated rows
are scored alike; null ids are training rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, let_go, remainder, texts, utf8
from .recurrent import Adam, Model, one_thread, score, train

#: The end of a text; no word is empty.
END = b""
TIER, WORDS, HIDDEN, CLASSES = 100_000, 2048, 24, 48
ROUNDS, WINDOW, RATE, LANES = 2, 32, 0.01, 128
#: Words of a shard on average; beyond so many shards in a round they grow with the corpus.
SHARD_WORDS, MOST_SHARDS = 2_000_000, 65_536
BLOCKS, FLUSH, CHUNK = 128, 400_000, 5 << 20


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes, END too), c: over all documents."""

    def run(batches):
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for b in batches:
            seen[END] += b.num_rows
            for t in utf8(b.column("text")):
                seen.update(words(t))
                if len(seen) > FLUSH:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return texts(docs).select("text").mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


class Rows(dict):
    """word -> row; others -> the number of rows"""

    def __init__(self, found: dict):
        super().__init__((w, i) for i, w in enumerate(found))
        self.n = len(self)

    def __missing__(self, word: bytes) -> int:
        return self.n

    def __reduce__(self):
        return Rows, (list(self),)


class Vocabulary:
    """The frequent tier: counts by word, and places in the model (0 the end, 1 all others, then frequent words)."""

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.counts = dict(rows)
        own = [w for w, _ in rows if w != END][: WORDS - 2]
        self.placed = len(own) + (END in self.counts)
        inside = sum(self.counts[w] for w in own) + self.counts.get(END, 0)
        self.outside, self.outside_distinct = total - inside, distinct - self.placed
        # Places in order of frequency: the classes are made along it.
        order = sorted([(self.counts.get(END, 0), 0, END), (self.outside, 1, None), *((self.counts[w], 2 + i, w) for i, w in enumerate(own))], key=lambda x: (-x[0], x[1]))
        self.model_counts = np.array([max(0, c) for c, _, _ in order])
        place = {w: i for i, (_, _, w) in enumerate(order)}
        self.end, self.other = place[END], place[None]
        # One lookup gives a word's row in the tier; the row behind the last stands for words that the tier lacks.
        self.rows = Rows(self.counts)
        self.place = np.array([*(place.get(w, self.other) for w in self.counts), self.other], np.uint16)
        self.logs = np.array([*(math.log10(c + 0.5) for c in self.counts.values()), 0.0])

    def model(self) -> Model:
        return Model(self.model_counts, HIDDEN, CLASSES)

    def lookup(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, own), np.int32, len(own))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The TIER most frequent words: a histogram of the counts' logarithms (a few hundred rows) gives the least count that stays within
    TIER, so no task sends more than its share of those words to the driver."""
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 16)
    least, so_far, cut = None, 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if so_far + r[1] > TIER:
            cut = r[0]
            break
        least, so_far = r[0], so_far + r[1]
    top = counts.where(level >= least).collect() if least is not None else []
    if cut is not None and so_far < TIER:
        # The level that does not fit whole fills the tier up, by count and then by a hash of the word.
        top += counts.where(level == cut).orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(TIER - so_far).collect()
    # The end always has its row.
    top += counts.where(F.col("word") == F.lit(END)).collect()
    rows = sorted({bytes(r[0]): r[1] for r in top}.items(), key=lambda x: (-x[1], x[0]))
    return Vocabulary(rows, n[0], n[1])


CODED = "row long, doc_id long, held_out boolean, h long, n_tokens long, n_known long, base double, outside double, n_outside long, ids binary, misses array<binary>, times array<int>"


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every document once as places in the model (two bytes each, the end last), with what the tier alone says of it: the sum of
    log10(c + 0.5) of its words and of those without a place, and the words that the tier lacks."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        from pyspark import TaskContext

        let_go()
        v = known.value
        row, none, end = TaskContext.get().partitionId() << 33, v.rows.n, np.array([v.end], np.uint16).tobytes()
        end_log, end_known = math.log10(v.counts.get(END, 0) + 0.5), int(END in v.counts)
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for t in utf8(b.column("text")):
                w = words(t)
                at = v.lookup(w)
                place, logs = v.place[at], v.logs[at]
                missing, out = np.flatnonzero(at == none), place == v.other
                left = Counter(w[i] for i in missing)
                found = (row, len(w) + 1, len(w) - len(missing) + end_known, float(logs.sum()) + end_log, float(logs[out].sum()), np.count_nonzero(out), place.tobytes() + end, list(left.keys()), list(left.values()))
                for c, x in zip(cols, found, strict=True):
                    c.append(x)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            first, *rest = (pa.array(c, k) for c, k in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([first, b.column("doc_id"), b.column("held_out"), b.column("h"), *rest], ["row", "doc_id", "held_out", "h", "n_tokens", "n_known", "base", "outside", "n_outside", "ids", "misses", "times"])

    own = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return kept(own.mapInArrow(run, CODED), docs.sparkSession, "coded")


def _chunks(batches, columns: tuple[str, ...]):
    """Rows of the batches in lists of about CHUNK bytes of the last column."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def learn(training: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """The averaged weights after all rounds."""
    spark = training.sparkSession
    weights = vocab.model().flat()
    known = spark.sparkContext.broadcast(vocab)
    shards = max(1, min(MOST_SHARDS, math.ceil(vocab.total / ROUNDS / SHARD_WORDS)))
    slots = math.ceil(math.sqrt(shards))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def replicas(batches, start=start):
            one_thread()
            v = known.value
            coded = ((shard, x) for b in batches for shard, x in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True))
            for shard, rows in groupby(coded, lambda r: r[0]):
                model = v.model()
                model.load(start.value)
                n = train(model, Adam(model, RATE), (np.frombuffer(x, np.uint16).astype(np.int32) for _, x in rows), LANES, WINDOW, v.end)[1]
                parts = np.array_split(model.flat().astype(np.float64) * n, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard % slots] * BLOCKS, pa.int32()), pa.array([shard] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * BLOCKS, pa.int64())], ["block", "slot", "rank", "v", "n"])

        def total(table: pa.Table) -> pa.Table:
            # In one order, whatever the exchange made of it: sums of floats depend on it.
            table = table.sort_by("rank")
            v = np.sum([np.frombuffer(x) for x in table.column("v").to_pylist()], 0)
            return pa.table({"block": table.column("block")[:1], "rank": table.column("slot")[:1], "v": pa.array([v.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

        # Every document trains once, in the round and the shard that its hash gives; longer ones first, so that lanes end together.
        mine = training.where(F.pmod("h", F.lit(ROUNDS)) == turn).select(F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int").alias("shard"), "h", "n_tokens", "ids")
        dealt = mine.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n_tokens"), "h")
        rows = dealt.select("shard", "ids").mapInArrow(replicas, "block int, slot int, rank int, v binary, n long")
        schema = "block int, rank int, v binary, n long"
        part = rows.groupBy("block", "slot").applyInArrow(total, schema).withColumn("slot", F.lit(0))
        got = {r[0]: (np.frombuffer(bytes(r[2])), r[3]) for r in part.groupBy("block").applyInArrow(total, schema).collect()}
        if got:
            weights = np.concatenate([got[i][0] / got[i][1] for i in range(BLOCKS)]).astype(np.float32)
    return weights


def score_documents(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    own = texts(docs).select("doc_id", "text")
    counts = kept(word_counts(own.where(remainder(F.col("doc_id"), 5) != 1)), spark, "counts")
    vocab = vocabulary(counts)
    rows = coded(own, vocab)
    weights = spark.sparkContext.broadcast(learn(rows.where("not held_out"), vocab))
    known = spark.sparkContext.broadcast(vocab)
    log_all = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))
    log_outside = math.log10(max(0, vocab.outside) + 0.5 * (max(0, vocab.outside_distinct) + 1))

    def run(batches):
        one_thread()
        v = known.value
        model = v.model()
        model.load(weights.value)
        table = model.table()
        for found in _chunks(batches, ("row", "ids")):
            got = _scored(model, table, [np.frombuffer(x, np.uint16).astype(np.int32) for _, x in found], v.end)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x / math.log(10) for x in got], pa.float64())], ["row", "model"])

    passed = rows.select("row", "ids").mapInArrow(run, "row long, model double")
    missed = rows.select("row", F.explode(F.arrays_zip("misses", "times")).alias("m"))
    rare = missed.select("row", F.col("m.misses").alias("word"), F.col("m.times").alias("tf")).join(counts, "word", "left")
    sums = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    out = rows.drop("ids", "misses", "times").join(passed, "row").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model") + F.col("outside") + logs - F.col("n_outside") * F.lit(log_outside)).alias("score"),
    )


def _scored(model: Model, table: np.ndarray, ids: list[np.ndarray], end: int) -> list[float]:
    return [float(x.sum(dtype=np.float64)) for x in score(model, table, ids, first=end)]
