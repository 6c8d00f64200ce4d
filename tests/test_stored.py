"""Tables that are saved, loaded and replayed, and records read from files."""

from __future__ import annotations

import pytest

from factloom.operators.stored import stored
from factloom.operators.versions import Versions
from factloom.sources import registry


def test_versions_are_appended_and_replayed(spark, tmp_path):
    saved = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(LookupError):
        saved.load()
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert [saved.save(rows(("a", 1), ("b", 1))), saved.save(rows(("a", 2))), saved.save(rows(("c", 3), ("b", None)))] == [1, 2, 3]
    (tmp_path / "v" / "version=4").mkdir()  # begun and never finished: it is no version, and its number is not free
    assert saved.numbers() == [1, 2, 3]
    told = lambda df: {(r["k"], r["v"], r["version"]) for r in df.collect()}
    assert told(saved.load()) == {("c", 3, 3), ("b", None, 3)} and told(saved.load(1)) == {("a", 1, 1), ("b", 1, 1)}
    assert told(saved.replay(["k"])) == {("a", 2, 2), ("b", None, 3), ("c", 3, 3)}
    assert told(saved.replay(["k"], upto=2)) == {("a", 2, 2), ("b", 1, 1)}
    with pytest.raises(LookupError):
        saved.load(9)
    assert saved.save(rows(("d", 5))) == 5 and told(saved.load()) == {("d", 5, 5)}


def test_a_stored_table_is_cut_from_what_made_it(spark):
    df = stored(spark.range(5).withColumnRenamed("id", "n"))
    assert sorted(r["n"] for r in df.collect()) == list(range(5)) and "Range" not in df._jdf.queryExecution().toString()


def test_records_of_files_and_of_a_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"key": 1, "name": "one", "make": {"brand": "x"}}\n\n{"key": 2, "name": "two"\n{"name": "none"}\n[1]\nnot json\n{"key": 3, "name": null, "size": 7}\n')
    held, rejects = registry.read_records(spark, str(tmp_path), "key long, name string, make struct<brand:string>", "key")
    assert {(r["key"], r["name"], r["make"] and r["make"]["brand"]) for r in held.collect()} == {(1, "one", "x"), (3, None, None)}
    reasons = [r["reason"] for r in rejects.collect()]
    assert len(reasons) == 4 and reasons.count("no key") >= 1
    over = spark.createDataFrame([(1, None), (3, "three"), (9, "nine")], "key long, name string")
    got = {r["key"]: (r["name"], r["origin"]) for r in registry.with_registry(held, over, "key").collect()}
    assert got == {1: ("one", "BOTH"), 3: ("three", "BOTH"), 9: ("nine", "REGISTRY")}
    assert {r["origin"] for r in registry.with_registry(held, over.where("false"), "key").collect()} == {"FILE"}
