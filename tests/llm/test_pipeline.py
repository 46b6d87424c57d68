import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tmp_path):
    rnd = random.Random(1)
    words = {"en": "the house of stone and water with light from that tree".split(), "de": "der baum und das haus nicht mit von wasser über schön".split()}
    item = [f"bench{i}" for i in range(20)]
    rows = [(i, " ".join(rnd.choice(words["en" if i % 2 else "de"]) for _ in range(60)), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, "so it is " + " ".join(item) + " the end of the house", "en", "s", 0), (102, "1234", "en", "s", 0), (103, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Two domains, told apart by their words (the language here): one is wanted in nine words of ten.
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 3)] + [(i, i % 2, 0) for i in range(1, 80, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    good, other = {i for i in ids if i % 2}, {i for i in ids if not i % 2}
    assert set(ids) <= set(range(80)) and ids == sorted(ids) and good == set(range(1, 80, 2)) and len(other) < 15
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
