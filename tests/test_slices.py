"""Overlays over items of records, made by hand."""

from __future__ import annotations

from factloom.operators import slices as S

ITEMS = "array<struct<id:string,value:string>>"
RECORD = f"k int, dates {ITEMS}, posts {ITEMS}, fees {ITEMS}, stages {ITEMS}, syllabus {ITEMS}, note string"


def test_overlays_change_what_they_name_and_nothing_else(spark):
    records = [
        (1, [("opens", "a"), ("closes", "b")], [("x", "1"), ("y", "2")], [("all", "9")], None, [], "kept"), (2, [("opens", "a")], [], [], [("I", "w")], [("1", "s")], None),
    ]
    told = [
        (1, "dates", "closes", "REVISE", "c", 1, True), (1, "dates", "closes", "REVISE", "d", 3, True), (1, "dates", "closes", "REVISE", "e", 4, False), (1, "posts", "x", "REMOVE", None, 5, True),
        (1, "posts", "z", "ADD", "3", 6, True), (1, "posts", "q", "ADD", "0", 7, True), (1, "fees", "all", "REMOVE", None, 8, True), (1, "fees", "none", "REVISE", "5", 9, True), (1, "stages", "II", "ADD", "i", 10, True),
        (1, "stages", "II", "REVISE", "j", 11, True), (2, "syllabus", "1", "REMOVE", None, 12, True), (2, "syllabus", "1", "ADD", "t", 13, True), (3, "dates", "opens", "REVISE", "z", 14, True), (2, "map", "1", "ADD", "z", 15, True),
    ]
    before = spark.createDataFrame(records, RECORD)
    overlays = spark.createDataFrame(told, "k int, domain string, id string, kind string, value string, seq long, active boolean")
    held = S.in_force(overlays, "k")
    after = S.lay_over(before, held, "k")
    got = {r["k"]: {d: [tuple(x) for x in r[d]] for d in S.ALLOWED} | {"note": r["note"]} for r in after.collect()}
    assert got[1] == {"dates": [("opens", "a"), ("closes", "d")], "posts": [("y", "2"), ("q", "0"), ("z", "3")], "fees": [("all", "9")], "stages": [("II", "i")], "syllabus": [], "note": "kept"}
    assert got[2] == {"dates": [("opens", "a")], "posts": [], "fees": [], "stages": [("I", "w")], "syllabus": [("1", "t")], "note": None}
    assert {(r["domain"], r["id"], r["kind"]) for r in S.refused(overlays).collect()} == {("fees", "all", "REMOVE"), ("stages", "II", "REVISE"), ("map", "1", "ADD")}
    assert {tuple(r) for r in S.changed(before, after, "k").collect()} == {(1, "dates"), (1, "posts"), (1, "stages"), (2, "syllabus")}
    assert S.isolated(before, after, held, "k").count() == 0
    assert S.changed(after, S.lay_over(after, held, "k"), "k").count() == 0
    assert {tuple(r) for r in S.isolated(before, after, held.where("domain <> 'posts'"), "k").collect()} == {(1, "posts")}
