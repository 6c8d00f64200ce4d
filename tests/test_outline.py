"""Outlines made by hand: any depth, competing structures, rules that the nearest heading above states."""

from __future__ import annotations

from factloom.operators import outline as O

FIELDS = "id int, t string"


def paths(spark, *texts):
    got = O.lines_of(spark.createDataFrame(list(enumerate(texts)), FIELDS), "id", "t").collect()
    out = [[" > ".join([*r["up"], r["title"]]) for r in sorted(got, key=lambda r: r["n"]) if r["id"] == i] for i in range(len(texts))]
    return out, {r["id"]: r["structure"] for r in got}


def test_depth_is_what_is_printed(spark):
    deep = "\n".join(f"{'.'.join(['1'] * k)} t{k}" for k in range(2, 62))
    blanks = "\n".join(" " * k + f"t{k}" for k in range(40)) + "\n last"
    got, structure = paths(spark, deep, blanks)
    assert got[0][-1] == " > ".join(f"t{k}" for k in range(2, 62)) and structure[0] == "CLAUSES"
    assert got[1][39] == " > ".join(f"t{k}" for k in range(40)) and got[1][40] == "t0 > last" and structure[1] == "INDENTED"


def test_the_structure_with_most_entries_holds(spark):
    got, structure = paths(
        spark, "Paper I: History\n1. Early\n2.1 mentioned once\n- a\n- b\nPaper II: Law\n1. Acts", "1.1 One\n1.2 Two\n1.2.1 Three\nPaper I", "nothing here\nat all", "", "Topics:", "A:\n- b\n  - c\nD:\n- e",
    )
    assert structure == {0: "HEADINGS", 1: "CLAUSES", 5: "HEADINGS"}
    assert got[0] == ["Paper I: History", "Paper I: History > Early", "Paper I: History > Early > a", "Paper I: History > Early > b", "Paper II: Law", "Paper II: Law > Acts"]
    assert got[1] == ["One", "Two", "Two > Three"]
    assert got[5] == ["A", "A > b", "A > c", "D", "D > e"]


def test_rules_come_from_the_nearest_heading_above(spark):
    rows = [(1, 1, None, 0.25), (1, 2, 1, None), (1, 3, 2, 0.0), (1, 4, 3, None), (1, 5, 2, None), (2, 1, None, None), (2, 2, 1, None)]
    got = O.inherited(spark.createDataFrame(rows, "id int, n int, parent int, rule double"), "id", "rule").collect()
    assert {(r["id"], r["n"]): (r["in_force"], r["stated_at"]) for r in got} == {(1, 1): (0.25, 1), (1, 2): (0.25, 1), (1, 3): (0.0, 3), (1, 4): (0.0, 3), (1, 5): (0.25, 1), (2, 1): (None, None), (2, 2): (None, None)}


def test_statements_again_are_one_and_differences_are_held(spark):
    titles = ["Paper - II: X", "PAPER 2", "paper b", "Stage iv.", "none"]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(O.key_of(O.F.col("t"))).collect()]
    assert keys == ["paper 2", "paper 2", "paper b", "stage 4", ""]
    rows = [("a", 1, 5), ("a", 1, None), ("b", 2, 5), ("b", 3, 5)]
    got = {r["k"]: (r["x"], r["y"], r["stated"], r["held"]) for r in O.restated(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], ["x", "y"]).collect()}
    assert got == {"a": (1, 5, 2, False), "b": (None, 5, 2, True)}
