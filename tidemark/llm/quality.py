"""Quality by divergence from language references, in DataFrame functions alone.

Two histograms of each document are held against the references of its language: character classes (``CLASSES``) and common words (the
``COMMON`` most frequent words of that language, lower-cased, and one bin for all other words).  References are sums over all documents of a
language; a document's Jensen-Shannon distance to either above its limit fails it, where it has ``LEAST_WORDS`` words at least (shorter documents
carry too little evidence).

Everything of a document is computed in its own row: words, 8-word windows as 64-bit hashes, repeated windows by sorting those
hashes, and the counts of just those common words that it holds.  The only exchanges are the aggregations of the references: words by language,
counted in each task first, and a row per language.  The join with them is a broadcast while they number at most ``BROADCAST_LANGUAGES``.

Null text counts as empty; null lang is a language of its own; a document of whitespace has 0 words; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept

CLASSES = ("lower", "upper", "digit", "space", "beyond", "mark")
#: Words of a language that have bins of their own.
COMMON = 32
LEAST_WORDS, WORD_LIMIT, CLASS_LIMIT, WINDOW = 50, 0.45, 0.25, 8
BROADCAST_LANGUAGES = 5000
SPACE = r"[ \t\n\x0B\f\r]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more."""
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), (F.get(s, k + 1)["h"] == x["h"]), F.lit(False)))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
            step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"))
            return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["total"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(ordered, places))

    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(hashes, covered))


def _counts(text: Column) -> Column:
    """Characters of each class, and of ``[#*$%&|<>]``; each step looks only at what the steps before left over."""
    less = lambda t, pattern: F.regexp_replace(t, pattern, "")
    length = F.length

    def upper(a):
        return _let(less(a, "[A-Z]+"), lambda b: digit(a, b))

    def digit(a, b):
        return _let(less(b, "[0-9]+"), lambda c: space(a, b, c))

    def space(a, b, c):
        return _let(less(c, SPACE), lambda d: beyond(a, b, c, d))

    def beyond(a, b, c, d):
        return _let(less(d, r"[^\x00-\x7F]+"), lambda e: done(a, b, c, d, e))

    def done(a, b, c, d, e):
        at = [length(text) - length(a), length(a) - length(b), length(b) - length(c), length(c) - length(d), length(d) - length(e), length(e)]
        return F.struct(F.array(*[x.cast("long") for x in at]).alias("classes"), (length(e) - length(less(e, "[#*$%&|<>]"))).cast("long").alias("symbols"))

    return _let(less(text, "[a-z]+"), upper)


def common_words(docs: DataFrame) -> DataFrame:
    """ref_lang, ref_words, ref_longest (characters of the longest), ref_counts (long; of those words), ref_total (of all words): the most frequent words of each language, ties by the word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.coalesce("lang", F.lit("")).alias("ref_lang"), F.explode(F.split(F.lower(text), SPACE, -1)).alias("word")).where("word <> ''")
    counts = words.groupBy("ref_lang", "word").agg(F.count("*").alias("n"))
    # a language's totals and its first words in one aggregation: the words beyond the first are never sorted together
    place = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).where(F.col("place") <= COMMON)
    listed = top.groupBy("ref_lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    total = counts.groupBy("ref_lang").agg(F.sum("n").alias("ref_total"))
    longest = F.array_max(F.transform("top.word", F.length)).alias("ref_longest")
    return total.join(listed, "ref_lang").select("ref_lang", F.col("top.word").alias("ref_words"), longest, F.col("top.n").alias("ref_counts"), "ref_total")


def references(docs: DataFrame) -> DataFrame:
    """A row per language: the sums of the character classes over all its documents, its common words and their counts."""
    own = docs.select("lang", "text")
    h = own.select(F.coalesce("lang", F.lit("")).alias("ref_lang"), _let(F.coalesce(F.col("text"), F.lit("")), _counts)["classes"].alias("classes"))
    wide = h.groupBy("ref_lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"a{i}") for i in range(len(CLASSES))])
    return wide.select("ref_lang", F.array(*[f"a{i}" for i in range(len(CLASSES))]).alias("ref_classes")).join(common_words(own), "ref_lang", "left")


def _half(x: Column, y: Column) -> Column:
    """A bin's part of the divergence of x from the mean of x and y."""
    return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))


def word_distance(words: Column, ref_words: Column, ref_longest: Column, ref_counts: Column, ref_total: Column) -> Column:
    """Jensen-Shannon distance of a document's words to its language's common words; 0 where it has none.

    Only bins that the document fills are computed: each bin that it lacks adds just its own share of the reference.
    """

    def found(low: Column) -> Column:
        n = F.size(words).cast("double")

        def cell(w: Column) -> Column:
            share = F.element_at(ref_counts, F.array_position(ref_words, w).cast("int")) / ref_total
            return F.struct((F.size(low) - F.size(F.array_remove(low, w))).cast("double").alias("k"), share.alias("q"))

        start = F.struct(*[F.lit(0.0).alias(c) for c in ("d", "q", "k")])

        def step(s: Column, x: Column) -> Column:
            p = x["k"] / n
            return F.struct((s["d"] + _half(p, x["q"]) + _half(x["q"], p)).alias("d"), (s["q"] + x["q"]).alias("q"), (s["k"] + x["k"]).alias("k"))

        # all other words are one bin, which the document may lack like any other
        other = (ref_total - F.aggregate(ref_counts, F.lit(0).cast("long"), lambda s, x: s + x)) / ref_total

        def done(s: Column) -> Column:
            p = (n - s["k"]) / n
            lacking = F.greatest(F.lit(0.0), 1 - s["q"] - other)
            return F.sqrt(F.greatest(F.lit(0.0), (s["d"] + _half(p, other) + _half(other, p) + lacking) / 2))

        return F.aggregate(F.transform(F.array_intersect(ref_words, low), cell), start, step, done)

    # lower case has as many characters or more, so longer words than the longest common one need no look
    short = F.filter(words, lambda w: F.length(w) <= ref_longest)
    return F.when((F.size(words) == 0) | ref_words.isNull(), F.lit(0.0)).otherwise(_let(F.transform(short, F.lower), found))


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two arrays of counts; 0 where either is empty."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def value(n: Column, m: Column) -> Column:
        def term(a: Column, b: Column) -> Column:
            p, q = a / n, b / m
            return _half(p, q) + _half(q, p)

        total = F.aggregate(F.zip_with(own, reference, term), F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(F.lit(0.0), total / 2))

    both = _let(F.struct(add(own).cast("double").alias("n"), add(reference).cast("double").alias("m")), lambda s: F.when((s["n"] > 0) & (s["m"] > 0), value(s["n"], s["m"])).otherwise(F.lit(0.0)))
    return both


def judge(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row per document: the base counts and the verdict."""
    spark = docs.sparkSession
    refs = kept(references(docs), spark, "references") if known is None else known
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), word_distance(w, *[F.col(f"ref_{c}") for c in ("words", "longest", "counts", "total")]).alias("word_distance"))

    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    joined = own.join(F.broadcast(refs) if few else refs, F.col("lang") == F.col("ref_lang"), "left")
    one = joined.select(
        "doc_id", "lang", F.length("text").alias("n_chars"), "ref_classes",
        _let(words_of(F.col("text")), measured).alias("w"),
        _let(F.col("text"), _counts).alias("c"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    facts = one.select(
        "doc_id", F.col("w.n_words").alias("n_words"), (F.col("n_chars") - F.get("c.classes", F.lit(3))).cast("long").alias("word_chars"), F.col("c.symbols").alias("n_symbols"),
        "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.coalesce(distance(F.col("c.classes"), F.col("ref_classes")), F.lit(0.0)).alias("class_distance"), F.coalesce("w.word_distance", F.lit(0.0)).alias("word_distance"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("n_words") >= LEAST_WORDS) & ((F.col("class_distance") > CLASS_LIMIT) | (F.col("word_distance") > WORD_LIMIT))
    return facts.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
