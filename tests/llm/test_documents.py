import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, language_id, lm_score, mixing, near_dedup, quality, recurrent
from tidemark.llm.common import remainder

EN, DE = "the of and to in is was for with from that house tree water light stone".split(), "der die das und nicht mit von haus baum wasser licht stein für über schön".split()


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) + (rnd.choice(["ing", "ed", "s", ""]) if words is EN else rnd.choice(["en", "er", "e", ""])) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(i, prose(rnd, EN if i % 2 else DE, rnd.randint(30, 120)), "en" if i % 2 else "de", f"s{i % 3}", 0) for i in range(160)]
    for i in range(40):  # copies, near copies with few changed words
        words = out[i][1].split()
        if i % 2:
            words[rnd.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words).upper() if i % 4 == 0 else " ".join(words), out[i][2], "copies", 0))
    out += [(300, None, "en", "x", 0), (301, "", "en", "x", 0), (302, " \n\t ", None, "x", 0), (303, "one", "en", None, 0), (304, "One", "en", None, 0), (305, "one two", "en", "x", 0), (306, "12 34 !!", "en", "x", 0), (307, prose(rnd, EN, 30_000), "en", "x", 0), (None, "no id here", "en", "x", 0), (303, "one", "en", None, 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sets(rows):
    out = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return out


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    s = {k: v for k, v in sets(rows).items() if k is not None}
    up = {k: k for k in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(s[a] & s[b])
            if n and 100 * n >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]), r
    left = near_dedup.first_of_each(docs, 3, 85).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(str(k) for k in {k for k in keys if find(k) == k} | {None})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64), rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    both = np.concatenate([a[:2000], b[:500]])
    x, y = near_dedup.least_draws(a), near_dedup.least_draws(both)
    assert (np.minimum(near_dedup.least_draws(a[:1000]), near_dedup.least_draws(a[1000:])) == x).all()
    assert (np.maximum(near_dedup.registers(near_dedup.least_draws(a[:1000])), near_dedup.registers(near_dedup.least_draws(a[1000:]))) == near_dedup.registers(x)).all()
    j = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([3000.0]), np.array([2500.0]))[0]
    assert abs(j - 2000 / 3500) < 0.2


def test_a_rising_likelihood_means_an_estimate_above():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)
    rows = []
    for i in range(60):
        keep = rnd.random(2000) < 1 - 0.012 * i
        rows.append(near_dedup.registers(near_dedup.least_draws(np.concatenate([x[keep], rnd.integers(0, 1 << 63, int((~keep).sum()), dtype=np.uint64)]))))
    rows, n = np.array(rows), np.full(60, 2000.0)
    first = np.broadcast_to(rows[0], rows.shape)
    for least in (0.4, 0.6, 0.8):
        assert ((near_dedup.estimate(first, rows, n, n) >= least) == near_dedup.likely(first, rows, n, n, least)).all()


def test_spanning_forests_keep_components():
    rnd = np.random.default_rng(2)
    for n in (2, 3, 17, 60):
        near = rnd.random((n, n)) < 1.5 / n
        near |= near.T
        a, b = near_dedup._spanning(n, lambda c, others: others[near[c, others]])

        def comps(pairs):
            up = list(range(n))

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for x, y in pairs:
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
            return [find(i) for i in range(n)]

        want = comps([(i, j) for i in range(n) for j in range(n) if i != j and near[i, j]])
        assert comps(zip(a, b, strict=True)) == want
        # Members known to be of one component need no link between them, and lose none to others.
        known = np.array([w == want[0] for w in want])
        a, b = near_dedup._spanning(n, lambda c, others: others[near[c, others]], known)
        assert comps([*zip(a, b, strict=True), *((0, int(i)) for i in np.flatnonzero(known))]) == want


def links_of(rows, size, percent):
    up, found = {d: d for d, _ in rows if d is not None}, []
    for d, t in rows:
        w = (t or "").lower().split()
        own = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        if d is not None:
            found.append((d, own))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(found):
        for b, y in found[:i]:
            n = len(x & y)
            if a != b and n and 100 * n >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in up}


@pytest.mark.parametrize(("chunk", "size", "percent"), [(8, 3, 85), (512, 3, 85), (8, 5, 80)])
def test_large_groups_and_repeated_ids_in_any_order(spark, monkeypatch, chunk, size, percent):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rnd = random.Random(9)
    rows = []
    for start, n, words in ((0, 70, [f"w{i}" for i in range(120)]), (100, 40, [f"v{i}" for i in range(60)])):
        for i in range(n):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            rows.append((start + i, " ".join(own)))
    # One id with several texts, each of them like another row's.
    rows += [(1, "alpha beta gamma delta eps zeta"), (300, "alpha beta gamma delta eps zeta"), (301, rows[3][1]), (301, "some text of its own and no other"), (400, "some text of its own and no other"), (None, rows[3][1])]
    want = links_of(rows, size, percent)
    for order in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), size, percent).collect()
        assert len(got) == len(rows)
        assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "same id", "a"), (1, "same id", "a"), (1, "quite another text", "b"), (2, None, "c"), (2, None, "c"), (None, "x y z", "d"), (None, "x y z", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _gone", "2 AS _row", "3 AS _OWN")
    left = near_dedup.first_of_each(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "None", "None"]
    again = near_dedup.first_of_each(docs.orderBy(F.desc("source"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, left.collect()))


def test_languages(spark, docs, rows, empty):
    got = language_id.classify_held_out(docs).collect()
    assert len(got) == len(rows)
    truth = {d: (t, lang) for d, t, lang, *_ in rows}
    right = total = 0
    for r in got:
        t, lang = truth[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in t or ""):
            assert r["lang_pred"] == "und" and r["rejected"]
        elif r["held_out"] and len(t) > 100:
            total += 1
            right += r["lang_pred"] == lang
    assert total > 20 and right / total > 0.95
    assert language_id.classify_held_out(empty).count() == 0
    left = language_id.recognised(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if not r["rejected"]}
    from pyspark.sql import functions as F

    odd = language_id.classify_held_out(docs.unionByName(spark.createDataFrame([(9001, "\u00bd \u00b2 \u2460", "en", "x", 0), (9002, "12 \u00bd", "en", "x", 0)], docs.schema)))
    assert [(r["lang_pred"], r["score"]) for r in odd.where("doc_id > 9000").collect()] == [("und", 0.0)] * 2
    unlabelled = language_id.classify_held_out(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_a_language_of_long_texts_alone_is_learned(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, EN, 60), "en") for i in range(60)] + [(100 + i, prose(rnd, DE, 6000), "de") for i in range(3)] + [(200 + i, prose(rnd, DE, 40), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.dictionaries(docs)).where("doc_id >= 200")
    assert {r["lang_pred"] for r in got.collect()} == {"de"}


def test_every_language_is_learned(spark):
    rows = [(i, f"wort{i} text{i % 7} " * (2 if i else 40_000), f"l{i:03}") for i in range(530)]
    found = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(found) == 530 and list(found)[0] == "l000" and len(found["l000"]) == language_id.DICTIONARY_BYTES


def test_samples_keep_their_bound(spark):
    distinct = spark.range(20_000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "concat('text ', id) AS text", "IF(id < 19000, 'en', 'de') AS lang")
    assert common.hashed_sample(distinct, 20, "doc_id", "text").count() == 20
    hot = spark.range(100_000).selectExpr("7L AS doc_id", "'one' AS text", "'en' AS lang").unionByName(spark.range(50).selectExpr("id + 100 AS doc_id", "concat('t', id) AS text", "'de' AS lang")).repartition(4)
    got = common.hashed_sample(hot, 20, "doc_id", "text")
    assert got.columns == hot.columns and 10 <= got.count() <= 20 and got.distinct().count() == got.count()
    per = {r["lang"]: r["count"] for r in common.hashed_sample(distinct, 30, "doc_id", "text", by="lang").groupBy("lang").count().collect()}
    assert per == {"en": 30, "de": 30}
    a, b = (sorted(map(str, common.hashed_sample(d, 20, "doc_id", "text").collect())) for d in (distinct.repartition(3), distinct.repartition(7)))
    assert a == b
    assert common.hashed_sample(distinct.limit(0), 5, "doc_id", "text").count() == 0


def brute_quality(t):
    t = t or ""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, docs, rows, empty):
    rnd = random.Random(4)
    more = [(1000 + i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).replace("c a", "c\na") + rnd.choice(["", "##", "\n\nx", "\x0b$|é"]), "en", "s", 0) for i in range(200)]
    own = docs.unionByName(spark.createDataFrame(more, docs.schema))
    truth = {d: t for d, t, *_ in rows + more}
    for r in quality.judge(own).collect():
        want = brute_quality(truth[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (r, truth[r["doc_id"]])
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0


def test_distance_equals_definition(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3, 1, 0], [10, 30, 5]), ([0, 0, 0], [1, 1, 1]), ([2, 2, 2], [5, 5, 5])], "a array<long>, b array<long>")
    got = [r[0] for r in df.select(quality.distance(F.col("a"), F.col("b"))).collect()]
    p, q = np.array([3, 1, 0]) / 4, np.array([10, 30, 5]) / 45
    m = (p + q) / 2
    kl = lambda x: sum(x[i] * math.log2(x[i] / m[i]) for i in range(3) if x[i])
    assert abs(got[0] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-9 and got[1] == 0 and abs(got[2]) < 1e-6


def test_word_distance_equals_definition(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["a", "B", "c", "d", f"w{rnd.randrange(90)}"]) for _ in range(rnd.randrange(0, 90))), rnd.choice(["x", "y", None])) for i in range(60)]
    got = {r["doc_id"]: r["word_distance"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    total = defaultdict(Counter)
    for _, t, lang in rows:
        total[lang].update(t.lower().split())
    for i, t, lang in rows:
        own = Counter(t.lower().split())
        top = sorted(total[lang], key=lambda w: (-total[lang][w], w))[: quality.COMMON]
        bins = lambda c: [c[w] for w in top] + [sum(c.values()) - sum(c[w] for w in top)]
        p, q = (np.array(bins(c)) / max(1, sum(c.values())) for c in (own, total[lang]))
        kl = lambda x: sum(a * math.log2(2 * a / (b + c)) for a, b, c in zip(x, p, q, strict=True) if a)
        assert abs(got[i] - (math.sqrt(max(0, (kl(p) + kl(q)) / 2)) if own else 0)) < 1e-6, i


def test_any_language_has_its_own_words(spark):
    """A language that no list knows: its documents stay, one that shares no word with them goes."""
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("qua", "zol", "mir", "tek", "vun") for b in ("", "a", "osh", "ir", "umo", "eth")]
    rows = [(i, " ".join(rnd.choices(words, weights=range(30, 0, -1), k=120)), "xx") for i in range(60)] + [(99, " ".join(f"other{i}" for i in range(120)), "xx")]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == set(range(60))


def test_decontamination(spark, docs, empty):
    rnd = random.Random(8)
    item = [f"bench{rnd.randrange(10**6)}" for _ in range(24)]
    changed = list(item)
    for i in (4, 13, 19):
        changed[i] = "other"
    rows = [(1, "so " * 30 + " ".join(item).title() + ", then " * 9), (2, "a b c " + " ".join(changed) + " d e"), (3, " ".join(item[:9]) + " and nothing more of it at all"), (4, None), (5, ""), (6, prose(rnd, EN, 3000)), (6, " ".join(item)), (None, " ".join(item))]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as seed", "3 as _gone", "4 as _TEXT_hash")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, prose(random.Random(99), DE, 40))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(own, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 7), (None, 7)}
    assert got[(1, 7)]["matched"] == 24 and got[(2, 7)]["matched"] == 21
    left = decontaminate.clean(own, bench)
    # Rows are judged by their own texts: the clean one of the two that share an id stays.
    assert left.columns == own.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(own.limit(0), bench).count() == 0 and decontaminate.contaminated(own, bench.limit(0)).count() == 0
    blocks = decontaminate.blocks(bench, 20)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == decontaminate.benchmark_seeds(bench).count()


def brute_contamination(docs, items):
    out = {}
    for d, t in docs:
        a = (t or "").split()
        for item, u in items:
            b = (u or "").split()
            n, best = len(b), (0, 0)
            if n >= decontaminate.LEAVE_OUT:
                hits = {i for i in range(len(a) - n + 1) if sum(x != y for x, y in zip(a[i:], b, strict=False)) < 2} if n < 9 else {i - j for i in range(len(a) - 8) for j in range(n - 8) for m in decontaminate.MASKS if all(a[i + k] == b[j + k] for k, bit in enumerate(m) if bit == "1")}
                for shift in hits:
                    run = matched = 0
                    for j in range(max(0, -shift), min(n, len(a) - shift)):
                        same = a[j + shift] == b[j]
                        run += 1 if same else -1
                        run, matched = (0, 0) if run <= 0 else (run, matched + same)
                        if run > best[0]:
                            best = run, matched
            elif n and any(a[i : i + n] == b for i in range(len(a) - n + 1)):
                best = n, n
            if n and best[0] >= max(1, min(10, math.ceil(n * 0.6))):
                out[d, item] = max(out.get((d, item), (0, 0, 0)), (*best, n))
    return out


@pytest.mark.parametrize(("words", "seeds"), [(10**9, 10**9), (0, 60)])
def test_overlaps_equal_brute_force(spark, monkeypatch, words, seeds):
    whole = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    monkeypatch.setattr(decontaminate, "blocks", lambda b: whole(b, seeds))
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    docs = [(i, " ".join(text(rnd.randint(0, 60)))) for i in range(40)] + [(None, "x"), (7, "w1 w2 w3"), (8, "w1"), (9, "w1 w2")]
    items = [(i, " ".join(text(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 30])))) for i in range(24)] + [(100, None), (101, "w1"), (102, "w1 w2 w3"), (103, "w1 w2 w3"), (None, "w1 w2")]
    for i in range(14):
        own = [w if rnd.random() > 0.15 else "z" for w in items[i][1].split()]
        docs.append((500 + i, " ".join(text(rnd.randint(0, 9)) + own + text(rnd.randint(0, 9)))))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contamination(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["score"], r["matched"], r["item_words"]) for r in got} == want and len(got) == len(want) > 10


def test_contamination_sql_has_short_items(spark, tmp_path):
    from tidemark.llm.pairs_sql import CONTAMINATED

    docs = [(1, "so a b c d it is"), (2, "a b"), (3, "x a b y"), (4, " ".join(f"q{i}" for i in range(30))), (5, "as e f g x i j k l it"), (6, "e f g x y j k l"), (7, "x f g h i j k l"), (8, "x b c d b a b c y")]
    items = [(1, "a b c d"), (2, "a b"), (3, " ".join(f"q{i}" for i in range(5, 25))), (4, "e f g h i j k l")]
    con, found = duckdb.connect(), {}
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        found[name] = spark.createDataFrame(rows, f"{key} long, text string")
        found[name].write.parquet(str(tmp_path / name))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    got = sorted(map(tuple, decontaminate.contaminated(found["documents"], found["benchmark"]).collect()))
    assert got == sorted(con.execute(CONTAMINATED).fetchall()) 
    assert got == [(1, 1, 4, 4, 4), (1, 2, 2, 2, 2), (2, 2, 2, 2, 2), (3, 2, 2, 2, 2), (4, 3, 20, 20, 20), (5, 4, 6, 7, 8), (7, 4, 7, 7, 8), (8, 1, 3, 3, 4), (8, 2, 2, 2, 2)]


def test_recurrent_gradients():
    rnd = np.random.default_rng(5)
    counts = np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1])
    m = recurrent.Model(counts, 4, 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    recurrent.F32, keep = np.float64, recurrent.F32
    try:
        x, y = rnd.integers(0, 10, (5, 3)), rnd.integers(0, 10, (5, 3))
        fresh, on = np.zeros((5, 3), bool), np.ones((5, 3), bool)
        fresh[0], fresh[2, 1], on[4, 2] = True, True, False
        h = np.zeros((3, 4))
        g, loss, _ = m.slopes(x, y, fresh, on, h)
        n = on.sum()
        for k in m.p:
            flat = m.p[k].reshape(-1)
            for i in rnd.integers(0, len(flat), 4):
                was = flat[i]
                flat[i] = was + 1e-5
                up = m.slopes(x, y, fresh, on, h)[1]
                flat[i] = was - 1e-5
                down = m.slopes(x, y, fresh, on, h)[1]
                flat[i] = was
                assert abs((up - down) / 2e-5 / n - g[k].reshape(-1)[i]) < 1e-4, k
    finally:
        recurrent.F32 = keep


def test_windows_taken_together_are_windows_one_by_one():
    rnd = np.random.default_rng(5)
    m = recurrent.Model(np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1]), 4, 3)
    x, y = rnd.integers(0, 10, (12, 3)), rnd.integers(0, 10, (12, 3))
    fresh, on, h = np.zeros((12, 3), bool), np.ones((12, 3), bool), np.zeros((3, 4), np.float32)
    fresh[0], fresh[5, 1] = True, True
    g, loss, last = m.slopes(x, y, fresh, on, h, 4)
    total, losses = {k: 0 for k in g}, 0.0
    for t in range(0, 12, 4):
        own, part, h = m.slopes(x[t : t + 4], y[t : t + 4], fresh[t : t + 4], on[t : t + 4], h)
        total, losses = {k: total[k] + v / 3 for k, v in own.items()}, losses + part
    assert abs(loss - losses) < 1e-3 and np.abs(last - h).max() < 1e-5 and all(np.abs(total[k] - g[k]).max() < 1e-5 for k in g)


def test_probabilities_sum_to_one_and_state_is_carried():
    m = recurrent.Model(np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1]), 4, 3)
    states = np.random.default_rng(0).normal(size=(6, 4)).astype(np.float32)
    total = sum(np.exp(m.log_probs(states, np.full(6, w))) for w in range(10))
    assert np.abs(total - 1).max() < 1e-4
    rnd = np.random.default_rng(1)
    found = [rnd.integers(0, 10, n).astype(np.int32) for n in (3, 200, 1, 57, 9)]
    short, long = recurrent.score(m, m.table(), found, lanes=2, window=7), recurrent.score(m, m.table(), found, lanes=5, window=1000)
    for a, b in zip(short, long, strict=True):
        assert np.abs(a - b).max() < 1e-4


def test_training_takes_every_window_with_its_state():
    m = recurrent.Model(np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1]), 4, 3)
    rnd = np.random.default_rng(2)
    m.p["class_w"], m.p["word_w"] = rnd.normal(size=m.p["class_w"].shape).astype(np.float32), rnd.normal(size=m.p["word_w"].shape).astype(np.float32)
    found = [rnd.integers(0, 10, n).astype(np.int32) for n in (3, 200, 1, 57, 9, 32, 64, 33)]
    want = -sum(float(x.sum()) for x in recurrent.score(m, m.table(), found, first=4))
    for lanes in (1, 3, 20):
        # At rate 0 the weights stand, so the losses add up to what scoring gives only if no word is left out and no state is lost.
        loss, words = recurrent.train(m, recurrent.Adam(m, 0.0), found, lanes, 32, 4)
        assert words == sum(map(len, found)) and abs(loss - want) < 1e-3 * want


def test_short_documents_train(spark):
    own = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(6)], "doc_id long, text string")
    for i in range(6):
        one = own.where(f"doc_id = {i}")
        vocab = lm_score.vocabulary(lm_score.word_counts(one))
        assert np.abs(lm_score.learn(lm_score.coded(one, vocab), vocab) - vocab.model().flat()).max() > 0


@pytest.mark.parametrize("tier", [100_000, 20, 0])
def test_scores(docs, rows, empty, monkeypatch, tier):
    monkeypatch.setattr(lm_score, "TIER", tier)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c: Counter = Counter()
    for d, t, *_ in rows:
        if not held(d):
            c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split() + [b""]
        want.append((d is None, d or 0, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5), held(d)))
    got = lm_score.score_documents(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 5), r["held_out"]) for r in got) == sorted(want)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm_score.score_documents(empty).count() == 0


def test_the_tier_is_filled_by_count_and_then_by_hash(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TIER", 5)
    counts = spark.createDataFrame([(bytes([65 + i]), 9 if i < 3 else 2) for i in range(20)], "word binary, c long")
    vocab = lm_score.vocabulary(counts)
    assert len(vocab.counts) == 5 and sorted(vocab.counts.values()) == [2, 2, 9, 9, 9] and vocab.counts == lm_score.vocabulary(counts.repartition(7)).counts


def test_scores_beat_the_base_and_ignore_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 20_000)
    monkeypatch.setattr(lm_score, "LANES", 8)
    rnd = random.Random(3)
    # Words follow one another: the model can learn what the counts alone cannot.
    after = {w: [rnd.choice(EN) for _ in range(3)] for w in EN}
    rows = []
    for i in range(900):
        own = [rnd.choice(EN)]
        for _ in range(rnd.randint(40, 80)):
            own.append(rnd.choice(after[own[-1]]))
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r["doc_id"]: r for r in lm_score.score_documents(docs.repartition(n)).collect()} for n in (3, 8))
    assert max(abs(a[k]["score"] - b[k]["score"]) for k in a) < 1e-3
    held = [r for r in a.values() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert len(held) > 100 and sum(r["score"] - r["base_score"] for r in held) / n > 0.2


def test_rates_meet_targets(spark, docs, empty):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, EN, 60) if i % 4 else prose(rnd, DE, 60)) for i in range(400)] + [(900, None), (None, "x y z"), (3, prose(rnd, EN, 20))]
    own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as rate", "'x' as domain")
    domains = spark.createDataFrame([(i, "en" if i % 4 else "de") for i in range(0, 400, 2)] + [(1, "en"), (1, "en"), (5000, "de")], "doc_id long, domain string")
    got = mixing.mix(own, domains, {"en": 0.5, "de": 0.5}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    model = mixing.learn(own, domains)
    p = pd.DataFrame([(r["doc_id"], r["n_tokens"], *r["p"]) for r in mixing.memberships(own, model).collect()], columns=["doc_id", "n", *model.domains]).sort_values(["doc_id", "n"]).reset_index(drop=True)
    r = got.sort_values(["doc_id", "n_tokens"]).reset_index(drop=True).rate
    shares = np.array([(r * p.n * p[d]).sum() for d in model.domains])
    assert np.abs(shares / shares.sum() - 0.5).max() < 0.02
    assert got.converged.all() and got.gap.max() <= mixing.CLOSE
    left = mixing.mixed(own, domains, {"en": 0.5, "de": 0.5})
    assert left.columns == own.columns and 0 < left.count() < len(rows)
    assert mixing.mix(empty, domains).count() == 0 and mixing.mix(own, domains.limit(0)).where("rate = 1").count() == len(rows)


def test_filters_of_whole_texts_hold_a_slice_of_a_batch(spark, monkeypatch):
    """Spark gives batches of up to 10,000 rows and 64 MB: a worker passes them on in slices, and loses no row."""
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rnd, EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(1000)], "doc_id long, text string, lang string")
    domains = spark.createDataFrame([(i, "en" if i % 2 else "de") for i in range(0, 1000, 3)], "doc_id long, domain string")
    real, seen = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a, **b: seen.append(run) or real(self, run, *a, **b))
    for left in (mixing.mixed(docs, domains, {"en": 0.5, "de": 0.5}), language_id.recognised(docs)):
        whole = pa.Table.from_pandas(docs.toPandas(), preserve_index=False).combine_chunks().to_batches()
        out = list(seen[-1](iter(whole)))
        assert len(whole) == 1 and max(b.num_rows for b in out) <= common.PART_ROWS
        assert sorted(i for b in out for i in b.column("doc_id").to_pylist()) == sorted(r["doc_id"] for r in left.collect())


def test_rates_equal_projected_gradient_over_all_rows(spark, monkeypatch):
    """Three domains; rounds enough for the table of rates to be written anew twice."""
    monkeypatch.setattr(mixing, "CLOSE", 0.0)
    monkeypatch.setattr(mixing, "STILL", 0.0)
    monkeypatch.setattr(mixing, "ROUNDS", 9)
    monkeypatch.setattr(mixing, "REWRITE", 4)
    rnd = np.random.default_rng(4)
    n = 300
    p = rnd.dirichlet([0.4, 0.4, 0.4], n)
    words = rnd.integers(0, 90, n)
    members = spark.createDataFrame([(int(w), [float(x) for x in q]) for w, q in zip(words, p, strict=True)], "n_tokens long, p array<double>").repartition(4)
    targets = {"a": 0.7, "b": 0.2, "c": 0.1}
    for cap, shrink in ((float("inf"), False), (1.0, True)):
        residuals, gap = mixing.fit_rates(members, list(targets), targets, cap, shrink)
        r, all_words, want = np.ones(n), words.sum(), np.array([0.7, 0.2, 0.1])
        share = (words[:, None] * p).sum(0) / all_words
        goal = want * all_words * (min(1.0, (share / want).min()) if shrink else 1.0)
        for _ in range(9):
            e = ((r * words) @ p - goal) / (share * all_words)
            r = np.clip(r - (p @ e + mixing.DAMP * (r - 1)), 0.0, cap)
        assert np.abs(mixing.rates(p, residuals, cap) - r).max() < 1e-9
        assert abs(gap - (np.abs((r * words) @ p - goal) / goal).max()) < 1e-9


def test_labels_of_a_repeated_document_stay_bounded(spark):
    docs = spark.range(30_000).selectExpr("5L AS doc_id", "concat('hot text ', id) AS text").unionByName(spark.createDataFrame([(6, "cold text")], "doc_id long, text string")).repartition(4)
    domains = spark.createDataFrame([(5, "a"), (5, "b"), (6, "b")], "doc_id long, domain string")
    assert mixing.mix(docs, domains, {"a": 0.5, "b": 0.5}).count() == 30_001
    own = docs.join(domains.groupBy("doc_id").agg(F.min("domain").alias("domain")), "doc_id")
    assert own.count() == 30_001 and mixing.learn(docs, domains).domains == ["a", "b"]


def test_quality_sql(spark, tmp_path):
    from tidemark.llm.quality_sql import SQL

    rnd = random.Random(7)
    rows = [(i, prose(rnd, EN if i % 2 else DE, rnd.randint(0, 90)) + rnd.choice(["", "\na\na", " $$ ## " * 30]), "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(map(tuple, con.execute(SQL).fetchall()))
    assert sorted(map(tuple, quality.judge(df).select(*quality.COLUMNS).collect())) == want


def test_remainder(spark):
    from pyspark.sql import functions as F

    got = spark.range(50).select(remainder(F.col("id"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
