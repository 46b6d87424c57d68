"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Words are runs of letters and digits, lower-cased, hashed to 64 bits.  A *spaced seed* is a fixed mask of ``1`` (must agree) and ``0`` (ignored)
over ``SPAN`` consecutive words; every window of every text is hashed under each mask, and training hashes meet the benchmark's
in an equi-join.  Masks differ in what they ignore, so a passage with changed words still hits by one of them.  Around each hit, on its diagonal, the
item's words are held against the text's: +1 for an equal word, -1 for a different one; the best-scoring stretch is the
overlap.  A document is contaminated by an item when that score reaches ``least_score``: ``LEAST`` words, or ``SHARE`` of a short item.
Hits that follow another one on their diagonal word by word would find the same stretch, so only the first of such a run is verified.

Items of fewer than ``SPAN`` words have no window under these masks.  They are met at their own length: those of ``LEAVE_OUT`` words or more under
masks that each ignore one of their words, so that one changed word is tolerated and the same score decides; shorter ones where they stand whole.

Texts never move: windows are exploded, joined and verified in the row's own task, and only verified hits are exchanged, for a
maximum by document and item.  The benchmark's seeds go by broadcast, a few numbers each, in blocks of ``BLOCK_SEEDS`` at most, each block
against all rows; an item's seeds may lie in several blocks.  Its words go by broadcast up to ``BLOCK_WORDS`` in all items, and beyond it
hits are joined with the items by an exchange.

Null texts and texts or items without words have no windows; null ids are kept; equal items each report; repeated documents report once by
id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Weight-6 masks over 9 words.
MASKS = ("110101011", "101110011", "111001101")
SPAN = len(MASKS[0])
LEAST, SHARE, LEAVE_OUT = 10, 0.6, 4
BLOCK_SEEDS, BLOCK_WORDS = 500_000, 4_000_000


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(hashes: str, at: str) -> Column:
    """The hashes of the window at a place under all masks; plain array reads, so they stay in generated code."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(hashes, F.col(at) + k) for k, bit in enumerate(mask) if bit == "1"]) for m, mask in enumerate(MASKS)])


def _windows(rows: DataFrame, hashes: str, at: str) -> DataFrame:
    """rows with a row for each window (its place in ``at``) and mask (its number in ``mask``, its hash in ``seed``)."""
    n = F.size(hashes)
    places = rows.select("*", F.explode(F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN))).alias(at))
    return places.select("*", F.posexplode(_seeds(hashes, at)).alias("mask", "seed"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_no, item_id, item (its word hashes); the number is a hash of the two, so ids may be null or repeat."""
    own = benchmark.select("item_id", word_hashes(F.col("text")).alias("item"))
    return own.select(F.xxhash64("item_id", "item").alias("item_no"), "item_id", "item").dropDuplicates(["item_no"])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, item_no, item_at."""
    return _windows(items_of(benchmark), "item", "item_at").select("seed", "item_no", "item_at")


def _best(own: Column, item: Column, shift: Column) -> Column:
    """Score, matched words and length of the best stretch of the item on the diagonal where item word j meets text word j + shift."""
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(item), F.size(own) - shift)

    def scan(span: Column) -> Column:
        zero = F.lit(0)
        start = F.struct(zero.alias("run"), zero.alias("hits"), zero.alias("best"), zero.alias("best_hits"))

        def step(a: Column, j: Column) -> Column:
            same = F.get(own, j + shift) == F.get(item, j)
            run = a["run"] + F.when(same, 1).otherwise(-1)
            alive = run > 0
            hits = F.when(alive, a["hits"] + same.cast("int")).otherwise(zero)
            better = run > a["best"]
            return F.struct(F.when(alive, run).otherwise(zero).alias("run"), hits.alias("hits"), F.when(better, run).otherwise(a["best"]).alias("best"), F.when(better, hits).otherwise(a["best_hits"]).alias("best_hits"))

        return F.aggregate(span, start, step)

    return _let(F.sequence(low, high - 1), scan)


def least_score(n_words: Column) -> Column:
    return F.least(F.lit(LEAST), F.ceil(n_words * F.lit(SHARE)).cast("int"))


def blocks(benchmark: DataFrame, wanted: int = BLOCK_SEEDS) -> list[DataFrame]:
    """The seeds in parts small enough to broadcast; which part a seed is in depends on its item and place."""
    seeds = benchmark_seeds(benchmark)
    n = seeds.count()
    parts = max(1, -(-n // wanted))
    if parts == 1:
        return [seeds]
    return [seeds.where(F.pmod(F.xxhash64("item_no", "item_at"), F.lit(parts)) == i) for i in range(parts)]


def _first_of_run() -> Column:
    """No window one word before, and none of a mask before this one here, hits on the same diagonal.  Written with lambdas, so that the generated
    code around it stays small enough to be compiled; it is only asked of hits."""
    masks = F.array(*[F.array(*[F.lit(k) for k, bit in enumerate(m) if bit == "1"]) for m in MASKS])

    def agree(some: Column, back: int) -> Column:
        same = lambda k: F.coalesce(F.get("own", F.col("at") + (k - back)) == F.get("item", F.col("item_at") + (k - back)), F.lit(False))
        return F.exists(some, lambda m: F.forall(m, same))

    return ~((F.least("at", "item_at") > 0) & agree(masks, 1)) & ~agree(F.slice(masks, F.lit(1), F.col("mask")), 0)


def _long_hits(docs: DataFrame, keys: list[str], benchmark: DataFrame) -> DataFrame:
    """keys, item_id, score, matched, item_words of every verified run of hits."""
    windows = _windows(docs, "own", "at")
    items = items_of(benchmark)
    words = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    found = None
    for part in blocks(benchmark):
        hits = windows.join(F.broadcast(part), "seed")
        if words > BLOCK_WORDS:
            # Only a stretch of the text as long as the item leaves for the exchange.
            sizes = items.select("item_no", F.size("item").alias("item_size"))
            first = F.greatest(F.lit(0), F.col("at") - F.col("item_at") - 1)
            hits = hits.join(sizes, "item_no").select(*keys, "mask", "item_no", "item_at", F.slice("own", first + 1, F.col("item_size") + 2).alias("own"), (F.col("at") - first).alias("at"))
            hits = hits.join(items, "item_no")
        else:
            hits = hits.join(F.broadcast(items), "item_no")
        # Only the stretch of the text beside the item leaves the join, whatever the text's length.
        first = F.greatest(F.lit(0), F.col("at") - F.col("item_at"))
        near = hits.select(*keys, "item_id", "item", F.slice("own", first + 1, F.size("item")).alias("beside"), (F.col("at") - F.col("item_at") - first).alias("shift"), _first_of_run().alias("starts"))
        # No filter on it: the optimizer would move one into the join.
        scored = near.select(*keys, "item_id", F.size("item").alias("item_words"), F.when(F.col("starts"), _best(F.col("beside"), F.col("item"), F.col("shift"))).alias("b"))
        scored = scored.select(*keys, "item_id", F.col("b.best").alias("score"), F.col("b.best_hits").alias("matched"), "item_words")
        found = scored if found is None else found.unionByName(scored)
    return found


def _short_seeds(hashes: Column, at: Column, k: int) -> Column:
    """(mask, seed, other) of a stretch of k words: each mask leaves out the word of its number, which is ``other``; below ``LEAVE_OUT`` none is."""
    word = lambda j: F.get(hashes, at + j)
    if k < LEAVE_OUT:
        return F.array(F.struct(F.lit(-1).alias("mask"), F.xxhash64(F.lit(-1), *[word(j) for j in range(k)]).alias("seed"), F.lit(0).cast("long").alias("other")))
    return F.array(*[F.struct(F.lit(m).alias("mask"), F.xxhash64(F.lit(m), *[word(j) for j in range(k) if j != m]).alias("seed"), word(m).alias("other")) for m in range(k)])


def _short_hits(docs: DataFrame, keys: list[str], benchmark: DataFrame) -> DataFrame | None:
    """Items below SPAN words at their own length; None where the benchmark has none."""
    n = F.size("item")
    items = items_of(benchmark).where((n > 0) & (n < SPAN))
    lengths = sorted(r[0] for r in items.select(n).distinct().collect())
    if not lengths:
        return None
    out, size = None, F.size("own")
    for k in lengths:
        keyed = items.where(n == k).select("item_id", F.explode(_short_seeds(F.col("item"), F.lit(0), k)).alias("s")).select("item_id", F.col("s.seed").alias("seed"), F.col("s.other").alias("item_other"))
        at = docs.select(*keys, "own", F.explode(F.when(size >= k, F.sequence(F.lit(0), size - k))).alias("at"))
        rows = at.select(*keys, F.explode(_short_seeds(F.col("own"), F.col("at"), k)).alias("s")).select(*keys, "s.mask", "s.seed", "s.other")
        m = F.col("mask")
        # with one word changed, the best stretch is the item without that word at an end, without two words at an end, or all of it
        changed = F.greatest(F.lit(k - 2), m, F.lit(k - 1) - m)
        same = F.col("other") == F.col("item_other")
        matched = F.when(same, F.lit(k)).when(m.isin(1, k - 2), F.lit(k - 2)).otherwise(F.lit(k - 1))
        hit = _joined(rows, keyed).select(*keys, "item_id", F.when(same, F.lit(k)).otherwise(changed).alias("score"), matched.alias("matched"), F.lit(k).alias("item_words"))
        out = hit if out is None else out.unionByName(hit)
    return out


def _joined(rows: DataFrame, short: DataFrame) -> DataFrame:
    n = short.count()
    parts = max(1, -(-n // BLOCK_SEEDS))
    cut = [short.where(F.pmod(F.col("seed"), F.lit(parts)) == i) if parts > 1 else short for i in range(parts)]
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(c), "seed") for c in cut])


def _found(docs: DataFrame, keys: list[str], benchmark: DataFrame) -> DataFrame:
    """docs: keys, own.  A row per verified (keys, item_id): the best overlap."""
    found = _long_hits(docs, keys, benchmark)
    short = _short_hits(docs, keys, benchmark)
    if short is not None:
        found = found.unionByName(short)
    # The test of the score stands behind the aggregation: before it, the optimizer would move it into the join, which would then leave
    # generated code and pile up every window of a long text.
    best = found.groupBy(*keys, "item_id").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", "matched", "item_words"))).alias("m")).where(F.col("m.score") >= least_score(F.col("m.item_words")))
    return best.select(*keys, "item_id", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("score", "matched", "item_words")])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per verified (doc_id, item_id): score, matched words and length of the best overlap, and words of the item."""
    return _found(docs.select("doc_id", word_hashes(F.col("text")).alias("own")), ["doc_id"], benchmark)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, as they were.  Rows are judged by their own text: one that shares its id (or a null id) with
    a contaminated row stays."""
    text, gone, gone_text = fresh(docs, "_text_hash"), fresh(docs, "_gone"), fresh(docs, "_gone_text")
    keyed = docs.withColumn(text, F.xxhash64("text"))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("own"))
    bad = _found(own, ["doc_id", "text_hash"], benchmark).select(F.col("doc_id").alias(gone), F.col("text_hash").alias(gone_text)).distinct()
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(F.col(gone)) & (F.col(text) == F.col(gone_text)), "left_anti").drop(text)
