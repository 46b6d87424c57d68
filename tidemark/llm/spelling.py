"""Grouping spelling variants: each word's distance-one automaton against broadcast shards of a trie.

Words are counted in one aggregation, written in ranges of the alphabet, and each stretch of ``SHARD`` words in order becomes one compact trie:
nodes in breadth-first order, a letter of one byte each (words hold code points below 256), the first child of each node, and the counts of the
words that end there.  Shards are broadcast in rounds of at most ``ROUND`` bytes; in a round every word meets every shard.  The Levenshtein
automaton of distance one is walked depth-first along with the trie: while no error is made, one state; after an error, only the rest of the word
leads to acceptance.  As a shard holds a stretch of the order, words far from it leave it at the first or second letter.  Accepted words other than
the word itself are its near words; each shard gives their number and the best of them, an aggregation the rest.

Null text has no word; a null doc_id is written as nothing before the colon of the hash; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, let_go, shared_path, texts

RUN = "[A-Za-zÀ-ÿ]+"
#: Fixed by the operator's contract: one run in so many loses a code point; shortest word, fewest occurrences.
ODD, SHORTEST, FEWEST = 97, 5, 3
#: Words of one trie; bytes of the tries of one round.
SHARD, ROUND = 50_000, 48_000_000


def runs(docs: DataFrame) -> DataFrame:
    """word: the runs of all documents, lower-cased, some with a code point gone."""
    run = F.col("run")
    # lower() also takes accented capitals, which stay as they are
    low = F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    own = texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select("doc_id", low.alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return own.select(F.when(h % ODD == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))


def counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n of the words long and frequent enough."""
    return runs(docs).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


class Trie:
    """Words of one stretch of the order with their counts; children of a node stand together, in order."""

    def __init__(self, letters: bytes, first, n):
        self.letters, self.first, self.n = letters, first, n

    @classmethod
    def of(cls, words: list[bytes], n: list[int]) -> Trie:
        """words: in order, different."""
        letters, first, ends, at = bytearray(b"\0"), array("I"), array("q"), 0
        nodes = [(0, len(words))]
        while nodes:
            below = []
            for low, high in nodes:
                first.append(len(letters))
                whole = len(words[low]) == at if high > low else False
                ends.append(n[low] if whole else 0)
                low += whole
                while low < high:
                    letter, start = words[low][at], low
                    while low < high and words[low][at] == letter:
                        low += 1
                    letters.append(letter)
                    below.append((start, low))
            nodes, at = below, at + 1
        first.append(len(letters))
        return cls(bytes(letters), first, ends)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        narrow = array("I", self.n) if max(self.n) < 1 << 32 else self.n
        return self.letters, self.first.tobytes(), narrow.tobytes()

    @classmethod
    def unpacked(cls, letters: bytes, first: bytes, n: bytes) -> Trie:
        return cls(letters, memoryview(first).cast("I"), memoryview(n).cast("I" if len(n) == 4 * len(letters) else "q"))

    def near(self, word: bytes) -> dict[bytes, int]:
        """The words at distance one and their counts: the automaton's run over the trie, depth-first.

        A state is (place in the word, errors).  Without an error the walk follows the word's own path; every child met beside it starts a
        branch whose single error is a replaced or an inserted letter, and leaving out a letter of the word starts one at the same node.
        """
        letters, first, n, found = self.letters, self.first, self.n, {}
        find, size = letters.find, len(word)

        def accept(node: int, rest: int, head: bytes) -> None:
            """One error made: only word[rest:] is still accepted."""
            for i in range(rest, size):
                node = find(word[i], first[node], first[node + 1])
                if node < 0:
                    return
            if n[node]:
                found[head + word[rest:]] = n[node]

        node = 0
        for at in range(size + 1):
            low, high = first[node], first[node + 1]
            head = word[:at]
            own = word[at] if at < size else -1
            after = word[at + 1] if at + 1 < size else -1
            if at < size:
                accept(node, at + 1, head)
            for child in range(low, high):
                letter = letters[child]
                a, z = first[child], first[child + 1]
                # one look for the letter that must follow saves most branches
                if own < 0:
                    if n[child]:
                        found[head + letters[child : child + 1]] = n[child]
                    continue
                if letter != own and (n[child] if after < 0 else find(after, a, z) >= 0):
                    accept(child, at + 1, head + letters[child : child + 1])
                if find(own, a, z) >= 0:
                    accept(child, at, head + letters[child : child + 1])
            if at == size:
                break
            node = find(own, low, high)
            if node < 0:
                break
        found.pop(word, None)
        return found


_SHARD_SCHEMA = pa.schema([("letters", pa.binary()), ("first", pa.binary()), ("n", pa.binary())])


def tries(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """letters, first, n: the tries of stretches of the words, whose partitions hold ranges of the alphabet, each in order."""

    def build(batches):
        let_go()
        own: list[tuple[bytes, int]] = []

        def row():
            own.sort()  # a task may read several stretches, in any order
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in Trie.of([w for w, _ in own], [n for _, n in own]).packed()], schema=_SHARD_SCHEMA)

        for b in batches:
            for word, times in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                own.append((word.encode("latin-1"), times))
                if len(own) == shard:
                    yield row()
                    own.clear()
        if own:
            yield row()

    return words.select("word", "n").mapInArrow(build, "letters binary, first binary, n binary")


def neighbours(words: DataFrame, shards: list[tuple]) -> DataFrame:
    """word, n_near, form_n, form: what each word finds in a round's shards (a row per word that finds something)."""
    shared = words.sparkSession.sparkContext.broadcast(shards)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def walk(batches):
        let_go()
        own = [Trie.unpacked(*s) for s in shared.value]
        for b in batches:
            out = []
            for word in b.column("word").to_pylist():
                data, n_near, best = word.encode("latin-1"), 0, None
                for trie in own:
                    near = trie.near(data)
                    if near:
                        n_near += len(near)
                        first = min((-n, w) for w, n in near.items())
                        best = first if best is None or first < best else best
                if best is not None:
                    out.append((word, n_near, -best[0], best[1].decode("latin-1")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], [], []), schema, strict=True)], schema=schema)

    return words.select("word").mapInArrow(walk, "word string, n_near long, form_n long, form string")


def _rounds(places: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards by number, in rounds of at most so many bytes (a round holds one shard at least)."""
    out, size = [], most + 1
    for number, n_bytes in places:
        if size + n_bytes > most:
            out.append([])
            size = 0
        out[-1].append(number)
        size += n_bytes
    return out


def near_words(words: DataFrame, scratch: Scratch, parts: int, shard: int = SHARD, most: int = ROUND) -> DataFrame:
    """word, n_near, form_n, form: of all words, those that have a near one; the best is of largest count, then first in order."""
    spark = words.sparkSession
    built = scratch.keep(tries(words, shard).withColumn("number", F.monotonically_increasing_id()), "tries")
    places = built.select("number", F.length("letters") + F.length("first") + F.length("n")).orderBy("number").collect()
    # walking is the work: words are dealt evenly, whatever their stretch
    dealt = scratch.keep(words.select("word").repartition(parts, "word"), "dealt")
    path = shared_path(spark, "near")
    scratch.paths.append(path)
    found = spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    found.write.parquet(path)
    for numbers in _rounds([tuple(r) for r in places], most):
        own = built.where(F.col("number").between(numbers[0], numbers[-1])).orderBy("number").select("letters", "first", "n").collect()
        neighbours(dealt, [tuple(bytes(c) for c in r) for r in own]).write.mode("append").parquet(path)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return spark.read.schema(found.schema).parquet(path).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def followed(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of the words that have a form (word, form): forms followed to the last.

    Pointers double: each round a word takes the pointer of the word it points to, so forms in a row of 2^k take k rounds; as a form has twice the
    count of its word, there are few.
    """
    pointers = scratch.keep(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = pointers.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.keep(pointers.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        pointers = step.select("word", "root")
        if step.where("moved").isEmpty():
            return pointers


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, shard: int = SHARD, most: int = ROUND) -> DataFrame:
    """word, n, form, form_n, root, n_near of each word; a form has at least twice the word's count."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counted = scratch.keep(counts(docs, shortest, fewest), "counted")
        parts = max(spark.sparkContext.defaultParallelism, -(-counted.count() // shard))
        words = scratch.keep(counted.repartitionByRange(parts, "word").sortWithinPartitions("word"), "words")
        near = scratch.keep(near_words(words, scratch, parts, shard, most), "near-words")
        twice = F.col("form_n") >= 2 * F.col("n")
        formed = words.join(near, "word", "left").select("word", "n", F.when(twice, F.col("form")).alias("form"), F.when(twice, F.col("form_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
        formed = scratch.keep(formed, "formed")
        roots = followed(formed.where("form IS NOT NULL"), scratch)
        return scratch.result(formed.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near"), "variants")
