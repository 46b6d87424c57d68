"""Exact ranked search over dual-sorted wavelet trees, one a shard.

A shard holds the postings of a stretch of documents as one sequence: the lists of its terms one behind another, each by falling impact.
A wavelet tree over the documents' places (in doc_id order) stores that sequence: each level splits every node's documents in two halves and
keeps the order within, so a term's part of any node is a range that starts with its greatest impact there.  Search takes nodes best bound first;
a node's bound is the sum of its ranges' first impacts times the weights of their terms, which for a node of one document is its score.  Nodes below
the item's worst kept score are dropped, equal ones are not, so ties come out by doc_id and the result is exact.

A term's impact in a document is (1000000000 * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * N) div L; N counts documents with a term, L all terms,
n the document's.  The weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))) is not part of the index.  Shards are made where the documents are read,
with no exchange; a task keeps the best of all its shards, and a window picks the best of the tasks' rows.

Null text has no term and is not indexed; so has an item with no term no row, and a null doc_id ranks behind others of its score.  Repeated rows are documents of
their own, items of one item_id are items of their own only where their texts differ; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, let_go, texts, utf8

#: Documents a search returns; postings after which a shard is closed; items searched in one pass over the index.
K, POSTINGS, ITEMS = 20, 600_000, 2048
#: Nodes that are opened at once.
OPENED = 64
#: ASCII letters and digits and all bytes of other characters stay, capitals are lowered, the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "doc_ids array<long>, terms array<binary>, starts binary, impacts binary, levels array<binary>"
_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("starts", pa.binary()), ("impacts", pa.binary()), ("levels", pa.list_(pa.binary()))])


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all."""

    def count(batches):
        n_docs = n_terms = 0
        for b in batches:
            sizes = [len(terms_of(x)) for x in utf8(b.column("text"))]
            n_docs, n_terms = n_docs + sum(map(bool, sizes)), n_terms + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], ["docs", "terms"])

    row = texts(docs).select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _shard(ids: list, tokens: list[bytes], sizes: list[int], n_docs: int, n_terms: int) -> list:
    """One shard's columns; tokens: of all its documents, one behind another, of which each has sizes[i]."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    order = np.asarray(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    names = np.asarray(coded.dictionary.to_pylist(), object)
    by_name = np.argsort(names, kind="stable")
    rank = np.empty_like(by_name)
    rank[by_name] = np.arange(len(by_name))
    key, tf = np.unique(rank[coded.indices.to_numpy()] * len(ids) + np.repeat(place, sizes), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    m = (75 + 25 * sizes * n_docs // n_terms)[order]
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    best = np.lexsort((doc, -impact, term))
    doc, impact = doc[best], impact[best]
    levels, depth = [], max(1, int(len(ids) - 1).bit_length())
    for level in range(depth):
        bit = depth - 1 - level
        above = doc >> (bit + 1)
        node = np.argsort(above.astype(np.uint16) if depth <= 16 else above, kind="stable")
        levels.append(np.packbits((doc[node] >> bit & 1).astype(bool)).tobytes())
    starts = np.searchsorted(term, np.arange(len(names) + 1)).astype("<i4").tobytes()
    return [[ids[i] for i in order.tolist()], names[by_name].tolist(), starts, impact.astype("<i4").tobytes(), levels]


def index(docs: DataFrame, n_docs: int, n_terms: int, postings: int = POSTINGS) -> DataFrame:
    """A row per shard; ``n_docs`` and ``n_terms`` are the ``totals`` of the whole corpus."""

    def rows(ids, tokens, sizes):
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(_shard(ids, tokens, sizes, n_docs, n_terms), _INDEX, strict=True)], schema=_INDEX)

    def build(batches):
        let_go()
        ids, tokens, sizes = [], [], []
        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                own = terms_of(data)
                if own:
                    ids.append(doc_id)
                    tokens += own
                    sizes.append(len(own))
                if len(tokens) >= postings:
                    yield rows(ids, tokens, sizes)
                    ids, tokens, sizes = [], [], []
        if ids:
            yield rows(ids, tokens, sizes)
        let_go()

    return texts(docs).mapInArrow(build, INDEX)


class Tree:
    """A shard opened for search: for each level ranks, where its nodes begin, and the impacts in its order."""

    def __init__(self, impacts: bytes, levels: list[bytes]):
        import numpy as np

        impact = np.frombuffer(impacts, "<i4")
        self.depth, size, places = len(levels), len(impact), np.arange(len(impact))
        #: ones: before each place of a level; first: the first place of each node of a level, and the end.
        self.ones, self.first, self.impacts = [], [np.array([0, size])], [impact]
        for packed in levels:
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=size).astype(bool)
            ones, first = np.zeros(size + 1, np.int32), self.first[-1]
            np.cumsum(bits, out=ones[1:])
            start, count = first[:-1], np.diff(first)
            units = np.diff(ones[first])
            below = np.concatenate(([0], np.cumsum(np.stack((count - units, units), 1))))
            # where each place goes: behind the zeros, or the ones, of its node
            zero, one = below[:-1:2] - start + ones[start], below[1::2] - ones[start]
            to = np.where(bits, np.repeat(one, count) + ones[:-1], np.repeat(zero, count) + places - ones[:-1])
            after = np.empty_like(impact)
            after[to] = impact
            impact = after
            self.ones.append(ones)
            self.first.append(below)
            self.impacts.append(impact)

    def search(self, low, high, weight, k: int, least: int):
        """The best (score, place) pairs, at most k, of scores of at least ``least`` and above 0; low and high: the terms' ranges at the root."""
        import numpy as np

        found: list[tuple[int, int]] = []
        # the open nodes: level, number, bound, and the ranges of all terms
        level, number, lows, highs = np.zeros(1, np.int64), np.zeros(1, np.int64), low[None], high[None]
        bound = self._bounds(level, lows, highs, weight)
        while len(bound):
            keep = (bound >= max(least, 1)).nonzero()[0]
            place = number[keep] << (self.depth - level[keep])
            take = keep[np.lexsort((place, -bound[keep]))]
            # leaves before every inner node are final; the first inner nodes are opened together
            leaf = level[take] == self.depth
            final = len(take) if leaf.all() else int(np.argmin(leaf))
            for i in take[:final]:
                found.append((int(bound[i]), int(number[i])))
                if len(found) == k:
                    return found
            rest = take[final:]
            if not len(rest):
                return found
            leaf = leaf[final:]
            if leaf.sum() > k:  # no later leaf than the k-th can be among the best
                cut = int(bound[rest[leaf.nonzero()[0][k - 1]]])
                least = max(least, cut)
            inner = rest[~leaf]
            opened, others = inner[:OPENED], np.concatenate((inner[OPENED:], rest[leaf]))
            parts = [(level[others], number[others], bound[others], lows[others], highs[others])]
            for at in np.unique(level[opened]).tolist():
                own = opened[level[opened] == at]
                nodes, ones, first = number[own], self.ones[at], self.first[at][number[own]]
                a, z = ones[lows[own]], ones[highs[own]]
                before = ones[first][:, None]
                zeros = self.first[at + 1][2 * nodes][:, None]
                units = self.first[at + 1][2 * nodes + 1][:, None]
                start = first[:, None]
                for bit, (x, y) in ((0, (zeros + lows[own] - start - (a - before), zeros + highs[own] - start - (z - before))), (1, (units + a - before, units + z - before))):
                    below = np.full(len(own), at + 1)
                    parts.append((below, 2 * nodes + bit, self._bounds(below, x, y, weight), x, y))
            level, number, bound, lows, highs = (np.concatenate(c) for c in zip(*parts, strict=True))
        return found

    def _bounds(self, level, lows, highs, weight):
        """The sums of the first impacts of the ranges that are not empty, times the weights; all nodes are of one level."""
        import numpy as np

        own = self.impacts[int(level[0])]
        there = highs > lows
        return (np.where(there, own[np.minimum(lows, len(own) - 1)], 0).astype(np.int64) * weight).sum(1)


def frequencies(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given terms stands; read from the shards' lists."""
    import numpy as np

    wanted = shards.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        value = pa.array(wanted.value, pa.binary())
        total: Counter = Counter()
        for b in batches:
            for own, starts in zip(b.column("terms"), b.column("starts").to_pylist(), strict=True):
                at = pc.index_in(value, own.values).to_numpy(zero_copy_only=False)
                first = np.frombuffer(starts, "<i4")
                there = ~np.isnan(at.astype(float))
                where = at[there].astype(np.int64)
                total.update(dict(zip(there.nonzero()[0].tolist(), (first[where + 1] - first[where]).tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    sums = shards.select("terms", "starts").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {terms[r.term]: r.df for r in sums}


def _best(shards: DataFrame, block: list[tuple], n_docs: int, k: int) -> DataFrame:
    """item_id, nth, doc_id, score: of each task's shards the k best of each item of the block (item_id, its terms)."""
    spark = shards.sparkSession
    terms = sorted({t for _, own in block for t in own})
    df = frequencies(shards, terms)
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    items = [(item, [(t, weights[t] * times) for t, times in Counter(own).items() if t in weights]) for item, own in block]
    shared = spark.sparkContext.broadcast((terms, items))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        import numpy as np

        let_go()
        terms, items = shared.value
        place = {t: i for i, t in enumerate(terms)}
        own_terms = [np.asarray([place[t] for t, _ in own], np.int64) for _, own in items]
        own_weights = [np.asarray([w for _, w in own], np.int64) for _, own in items]
        best: list[list] = [[] for _ in items]
        value = pa.array(terms, pa.binary())
        for b in batches:
            for row in range(b.num_rows):
                doc_ids = b.column("doc_ids")[row].values.to_pylist()
                tree = Tree(b.column("impacts")[row].as_py(), b.column("levels")[row].as_py())
                at = np.nan_to_num(pc.index_in(value, b.column("terms")[row].values).to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
                starts = np.append(np.frombuffer(b.column("starts")[row].as_py(), "<i4").astype(np.int64), [0, 0])
                for i, (own, weight) in enumerate(zip(own_terms, own_weights, strict=True)):
                    where = at[own]
                    here = where >= 0
                    if not here.any():
                        continue
                    least = -best[i][-1][0] if len(best[i]) == k else 1
                    hits = tree.search(starts[where[here]], starts[where[here] + 1], weight[here], k, least)
                    if hits:
                        best[i] = sorted([*best[i], *((-s, doc_ids[p] is None, doc_ids[p] or 0) for s, p in hits)])[:k]
        out = [(i, None if none else d, -s) for i, own in enumerate(best) for s, none, d in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], []), schema, strict=True)], schema=schema)
        let_go()

    return shards.mapInArrow(search, "item int, doc_id long, score long")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the different items that have a text."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K, postings: int = POSTINGS, items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of scores above 0.

    The index is written and read again; items are taken ``items`` at a time, so that the driver and a worker hold the terms of so many alone.
    """
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    order = Window.partitionBy("item_id", "nth").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    with Scratch(spark) as scratch:
        shards = scratch.keep(index(docs, n_docs, max(1, n_terms), postings), "wavelet-trees")
        queries = scratch.keep(items_of(benchmark).withColumn("nth", F.monotonically_increasing_id()), "items")
        bounds = [r[0] for r in islice(queries.select("nth").orderBy("nth").toLocalIterator(), 0, None, items)] if n_docs else []
        outs = []
        for i, low in enumerate(bounds):
            block = queries.where(F.col("nth") >= low) if i + 1 == len(bounds) else queries.where((F.col("nth") >= low) & (F.col("nth") < bounds[i + 1]))
            rows = [(r.item_id, r.nth, terms_of(r.text.encode())) for r in block.orderBy("nth").collect()]
            found = _best(shards, [((item, nth), own) for item, nth, own in rows], n_docs, k)
            names = spark.createDataFrame([(j, item, nth) for j, (item, nth, _) in enumerate(rows)], "item int, item_id long, nth long")
            best = found.join(F.broadcast(names), "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            outs.append(scratch.keep(best.select("item_id", "rank", "doc_id", "score"), "ranked"))
        if not outs:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        every = outs[0]
        for more in outs[1:]:
            every = every.unionByName(more)
        return scratch.result(every, "ranked")
