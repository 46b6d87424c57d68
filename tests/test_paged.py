import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import paged


def put(root, chain, **pages):
    (root / chain).mkdir(parents=True, exist_ok=True)
    for name, page in pages.items():
        (root / chain / f"{name.lstrip('_')}.json").write_text(json.dumps(page))


def item(urn, kind="DATASET", degree=1):
    return {"urn": urn, "entity_type": kind, "degree": degree, "unused": {"deep": [1]}}


ITEM = "urn string, entity_type string NOT NULL, degree int NOT NULL"


def test_cursor_chains(spark, tmp_path):
    put(tmp_path, "a", start={"items": [item("u1"), item("u2", degree=2), item("")], "next": "x"}, x={"items": [], "next": "y"}, y={"items": [item("u1"), item("j", "DATA_JOB"), item("c", "CHART"), item(None)], "next": None})
    put(tmp_path, "b", start={"items": [item("u9")], "next": None})
    read = paged.scan(spark, str(tmp_path), ITEM)
    assert read.count() == 8 and read.where("chain = 'b'").count() == 1 and read.where(F.col("chain").isin("b", "none")).count() == 1 and read.count() == 8
    assert {tuple(r) for r in paged.direct_neighbours(read, ("DATASET", "DATA_JOB")).collect()} == {("a", "DATASET", "u1"), ("a", "DATA_JOB", "j"), ("b", "DATASET", "u9")}
    assert paged.scan(spark, str(tmp_path), "urn string", chains=["nowhere"]).collect() == [] and paged.scan(spark, str(tmp_path), "urn string", chains=["b", "nowhere"]).count() == 1


def test_asked_chains_alone_are_read(spark, tmp_path):
    put(tmp_path, "good", start={"items": [item("u")], "next": None})
    put(tmp_path, "bad", start={"items": [item("u")], "next": "start"})
    assert [r.urn for r in paged.scan(spark, str(tmp_path), ITEM, chains=["good"]).collect()] == ["u"]
    with pytest.raises(Exception, match="invalid cursor"):
        paged.scan(spark, str(tmp_path), ITEM).collect()


@pytest.mark.parametrize(
    ("paging", "pages", "why"),
    [
        ("cursor", {"start": {"items": [], "next": "x"}, "x": {"items": [], "next": "x"}}, "invalid cursor"), ("cursor", {"start": {"items": [], "next": ""}}, "invalid cursor"), ("cursor", {"start": {"items": [], "next": 7}}, "invalid cursor"),
        ("cursor", {"start": {"items": [], "next": "gone"}}, "no page gone"), ("cursor", {"start": {"items": [], "next": None, "partial": True}}, "partial"), ("cursor", {"start": {"items": []}}, "incomplete page"),
        ("cursor", {"start": {"items": [{"urn": "u", "degree": 1}], "next": None}}, "incomplete item"), ("offset", {"_0": {"items": [item("u")], "start": 0, "total": 3}, "_1": {"items": [], "start": 1, "total": 3}}, "stalled"),
        ("offset", {"_0": {"items": [item("u")], "start": 0, "total": 2}, "_1": {"items": [item("v")], "start": 1, "total": 5}}, "total has changed"), ("offset", {"_0": {"items": [item("u")], "start": 4, "total": 2}}, "incomplete page"),
        ("offset", {"_0": [1]}, "no object"),
    ],
)
def test_chains_that_cannot_be_followed(spark, tmp_path, paging, pages, why):
    put(tmp_path, "a", **pages)
    with pytest.raises(Exception, match=why):
        paged.scan(spark, str(tmp_path), ITEM, paging).collect()


@pytest.mark.parametrize("paging", ["cursor", "offset"])
def test_round_trip(spark, tmp_path, paging):
    rows = [(f"c{i % 3}", i, f"näme {i}" if i % 5 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "grp string, n int, name string")
    assert paged.write_pages(df, str(tmp_path / "p"), "grp", ["n"], paging, 4) == 5 + 5 + 4
    back = paged.scan(spark, str(tmp_path / "p"), "n int, name string", paging, partitions=2)
    assert sorted(tuple(r) for r in back.select("chain", "n", "name").collect()) == sorted(rows)
    assert [r.n for r in back.where("chain = 'c1'").orderBy("page", "position").collect()] == list(range(1, 50, 3))
    assert paged.write_pages(df.limit(0), str(tmp_path / "none"), "grp", ["n"], paging) == 0


def test_later_items_win_and_values_keep_their_kind(spark, tmp_path):
    put(tmp_path, "a", _0={"items": [{"k": "x", "v": 1}, {"k": "y", "v": 2}], "start": 0, "total": 3}, _2={"items": [{"k": "x", "v": None}], "start": 2, "total": 3})
    assert {tuple(r) for r in paged.last_of_each(paged.scan(spark, str(tmp_path), "k string NOT NULL, v int", "offset"), "chain", "k").select("k", "v").collect()} == {("x", None), ("y", 2)}
    own = spark.createDataFrame([("a", "p", ['"te\\"xt"', "1.5", "7", '""'])], "chain string, property_urn string, values array<string>")
    assert [tuple(r)[2:] for r in paged.property_values(own).orderBy("position").collect()] == [(0, "STRING", 'te"xt', None), (1, "NUMBER", None, 1.5), (2, "NUMBER", None, 7.0), (3, "STRING", "", None)]
