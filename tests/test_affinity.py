"""Affinities against every pair of items, scored plainly."""

from __future__ import annotations

import random

import pytest

from factloom.operators.affinity import Weights, affinities

TAGS = ["CIVIL_SERVICES", "STATE_PSC", "STAFF_SELECTION", "BANKING", "OTHER", None]


def plain(x, y):
    s = 0.35 if x[1] and x[1] == y[1] else 0
    civil, tests = set(TAGS[:2]), set(TAGS[2:4])
    if x[2] in civil and y[2] in civil:
        s += 0.5 if x[2] == y[2] else 0.4
    if x[2] in tests and y[2] in tests:
        s += 0.4
    s += 0.15 * min(2, len(set(x[3] or []) & set(y[3] or [])))
    s += 0.05 if x[4] and x[4] == y[4] else 0
    return round(min(1.0, s), 2)


def test_pairs_over_the_threshold(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "A", "B", "C", "D"]), rng.choice(TAGS), rng.choice([None, rng.sample("uvwxyz", rng.randrange(0, 5))]), rng.choice([None, "", "10", "12", "GRAD"])) for i in range(60)]
    rows.append((60, "A", "OTHER", ["u", "u"], None))
    df = spark.createDataFrame(rows, "id int, authority string, category string, fields array<string>, qualification string")
    got = {(r["a"], r["b"]): r["affinity"] for r in affinities(df).collect()}
    want = {(x[0], y[0]): plain(x, y) for x in rows for y in rows if x[0] != y[0] and plain(x, y) > 0.3}
    assert got == want and len(want) > 300
    with pytest.raises(ValueError):
        affinities(df, Weights(authority=0.2))


def test_items_that_are_alike_meet_as_one(spark):
    rows = [(i, "A", "BANKING", ["u", "v"], "10") for i in range(300)] + [(300, "B", "STAFF_SELECTION", None, None), (None, "A", None, None, None)]
    pairs = affinities(spark.createDataFrame(rows, "id int, authority string, category string, fields array<string>, qualification string"))
    got = pairs.collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 300 * 299 + 2 * 300
    assert {r["affinity"] for r in got if 300 not in (r["a"], r["b"])} == {1.0} and {r["affinity"] for r in got if 300 in (r["a"], r["b"])} == {0.4}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # pairs of items are neither made distinct nor joined with their terms
