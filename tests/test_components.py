import random

import pytest

from tidemark.operators import components, graph


def brute(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for n in nodes:
                if a in reach[n] and not reach[b] <= reach[n]:
                    reach[n] |= reach[b]
                    changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(12 + 14 * seed)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 103), (104, 103)]
    got = components.strong_components(spark.createDataFrame(pairs + pairs[:3], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute(pairs) and got.count() == len(brute(pairs))


def test_no_edges_nulls_and_text_keys(spark):
    assert components.strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    got = components.strong_components(spark.createDataFrame([("b", "a", 1), ("a", "b", 2), (None, "a", 3), ("c", "c", 4)], "src string, dst string, label int"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_cycles_of_any_length(spark):
    ring = [(i, i + 1) for i in range(12)] + [(12, 3), (12, 0), (5, 5), (2, 20), (20, 21)]
    found = components.closed_on_best_paths(spark.createDataFrame(ring, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert sorted((r["cycle"], r["src"], r["dst"]) for r in found.collect()) == [(list(range(13)), 12, 0), (list(range(3, 13)), 12, 3), ([5], 5, 5)]


def test_loops_say_when_they_are_not_done(spark):
    chain, first = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError, match="limit"):
        graph.depths(chain, first, limit=3)
    with pytest.raises(RuntimeError, match="max_hops"):
        graph.best_paths(chain, first, chain.selectExpr("src AS node"), max_hops=3)
    assert graph.depths(chain, first, limit=7).count() == 7
