"""What work may not grow with: small files that were one task, and steps that were computed again for each entry or pair."""

from __future__ import annotations

from factloom.functions import text
from factloom.operators import outline
from factloom.plans import outlines
from factloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_notices_are_dealt_over_all_tasks(spark):
    assert QUERIES["x4_notice_facts"].run(spark, SF).rdd.getNumPartitions() >= 4


def test_schemes_are_dealt_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(outlines, "stored", lambda df, label: df)
    for name in ("x29_held_papers", "x29_restated_stages"):
        assert QUERIES[name].run(spark, SF).count() > 0
    assert outlines._schemes(spark, SF).rdd.getNumPartitions() >= 4
    assert QUERIES["x30_outlines"].run(spark, SF).rdd.getNumPartitions() >= 4


def test_lines_and_figures_are_as_without_the_short_ways(spark):
    lines = ["Paper I", " a  b ", "tab\there", " x y", "", " ", "é é", "end ", "two  blanks", "cr\r"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert all(a == b for a, b in df.select(outline._squashed(df.t), text.squash(df.t)).collect())
    told = ["2 Hours 30 minutes", "90 min", "1hr", "3 h", "hour", None, "no penalty", "NO NEGATIVE marks", "minus 1 / 3", "deducted 0.25", "penalty 1/4", "5"]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    got = [tuple(r) for r in df.select(text.minutes(df.t), text.penalty(df.t)).collect()]
    assert got == [(150, None), (90, None), (60, None), (None, None), (None, None), (None, None), (None, 0.0), (None, 0.0), (None, 0.3333), (None, 0.25), (None, None), (None, None)]
