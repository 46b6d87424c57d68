"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import pytest

from tidemark.llm import lexical_search
from tidemark.llm.lexical_search import ranked

SCHEMA, ITEM = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({x: x + 32 for x in range(65, 91)}))


def brute(docs, items, k=20):
    own = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for doc_id, t in own:
            tf, m = Counter(t), 75 + (25 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms(text) if x in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [(i * 7 % 301, " ".join(f"w{(i * j * j + j) % (3 + i % 29)}" for j in range(i % 31)) + (" Straße ÉTÉ été K9" if i % 5 == 0 else "")) for i in range(300)]
DOCS += [(None, "w1 w2 w1"), (None, None), (1, ""), (2, " .,;\n"), (900, "w5 " * 5000), (3, "w1 w2"), (3, "w1 w2"), (901, "w1 w2"), (902, "w2 w1")]
ITEMS = [(1, "w1 w2, W1 w3"), (2, "STRASSE straße été ÉTÉ"), (3, None), (4, "nowhere"), (5, ""), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (7, "k9"), (None, "w5")]


@pytest.mark.parametrize(("postings", "items", "opened"), [(600_000, 2048, 64), (100, 2048, 1), (700, 2, 3)])
def test_brute_force(spark, monkeypatch, postings, items, opened):
    monkeypatch.setattr(lexical_search, "OPENED", opened)
    docs, asked = spark.createDataFrame(DOCS, SCHEMA).repartition(3), spark.createDataFrame(ITEMS, ITEM)
    assert rows_of(ranked(docs, asked, postings=postings, items=items)) == brute(DOCS, ITEMS)


def test_many_equal_scores_come_by_doc_id(spark):
    docs = [(i, "alpha beta") for i in range(500, 0, -1)] + [(0, "gamma")]
    found = rows_of(ranked(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame([(1, "beta")], ITEM), postings=64))
    assert found == brute(docs, [(1, "beta")]) and sorted(r[2] for r in found) == list(range(1, 21))


def test_odd_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", 5, 6)], SCHEMA + ", rank int, item_id long")
    asked = spark.createDataFrame([(1, "a", 7, 8)], ITEM + ", doc_id int, score int")
    assert ranked(none, asked).collect() == [] and ranked(one, spark.createDataFrame([], ITEM)).collect() == []
    assert rows_of(ranked(one, asked)) == brute([(1, "a b")], [(1, "a")])
    assert ranked(spark.createDataFrame([(1, None)], SCHEMA), asked).collect() == []
    assert rows_of(ranked(one, asked.union(asked))) == brute([(1, "a b")], [(1, "a")])


def test_terms():
    assert lexical_search.terms_of("A1-b_c ÉÀİ\n\x7fz\x00".encode()) == [x.encode() for x in ("a1", "b", "c", "ÉÀİ", "z")]
