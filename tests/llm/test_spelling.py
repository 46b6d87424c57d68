"""Spelling variants against a brute-force version over all pairs."""

import re
import zlib
from collections import Counter

import pytest

from tidemark.llm.spelling import Trie, _rounds, variants

SCHEMA = "doc_id long, text string"


def brute(rows, fewest=3):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({x: x + 32 for x in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if k >= fewest and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long_ = sorted((a, b), key=len)
        return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))

    close = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, own in close.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], form[w], n.get(form[w]), root(w), len(close[w])) for w in n)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("word", "n", "form", "form_n", "root", "n_near").collect()), key=lambda r: r[0])


WORDS = "theory theori theor theorys heory Theory THEORY ménage mÉnage menage ménages aaaaa aaaaaa aaaab baaaa abaaa ÿÿÿÿÿ ÿÿÿÿÀ house houses hous housed".split()


@pytest.mark.parametrize(("shard", "most"), [(50_000, 48_000_000), (5, 200)])
def test_brute_force(spark, shard, most):
    rows = [(None if i == 7 else i % 40, " ".join(WORDS[(i * j) % len(WORDS)] + ",;\n"[j % 3] for j in range(i % 23))) for i in range(120)]
    rows += [(200 + i, f"chain{'sé'[: i // 40]} " * (3 - 2 * (i // 40))) for i in range(64)] + [(300 + i, "chainsé" if i % 3 == 0 else "chains") for i in range(12)]
    rows += [(1, None), (2, ""), (3, "aa " * 3000 + "zzzzzy" * 400), (None, "theory"), (5, "house house"), (5, "house house")]
    got = rows_of(variants(spark.createDataFrame(rows, SCHEMA), shard=shard, most=most))
    assert got == brute(rows)
    assert any(r[4] not in (r[0], r[2]) for r in got)  # some form has a form itself


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = [tuple(r) for r in docs.collect()]
    assert rows_of(variants(spark.createDataFrame(rows, SCHEMA), shard=100)) == brute(rows)


def test_odd_tables(spark):
    assert variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants(spark.createDataFrame([(None, None)], SCHEMA)).collect() == []
    more = spark.createDataFrame([(1, "words words words wordy wordy wordy", "x", 3, 4)], SCHEMA + ", word string, n int, form int")
    assert rows_of(variants(more)) == brute([(1, "words words words wordy wordy wordy")])


def test_trie_keeps_large_counts():
    words = sorted(w.encode("latin-1") for w in ("house", "houses", "mouse", "hous\xe9"))
    trie = Trie.unpacked(*Trie.of(words, [1, 2**33, 3, 4]).packed())
    assert trie.near(b"house") == {b"houses": 2**33, b"hous\xe9": 3, b"mouse": 4}
    assert trie.near(b"") == {} and trie.near(b"ouse") == {b"house": 1, b"mouse": 4}
    assert _rounds([(0, 5), (1, 5), (2, 20), (3, 1)], 10) == [[0, 1], [2], [3]]
