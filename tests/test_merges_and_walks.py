"""Merges, extraction, walks and queues on small rows made by hand, where the outcome can be read off."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import notices as N
from factloom.functions import text as T
from factloom.operators import extract as X
from factloom.operators import graph, joins, ladders, reads, stateful
from factloom.operators import reconcile as R
from factloom.sources import records


def outcomes(spark, rows, extendable=("APPLICATION_WINDOW",)):
    df = spark.createDataFrame([(i, "e", *r) for i, r in enumerate(rows)], "ord long, exam string, kind string, cycle string, date string, rank int, revises boolean")
    got = R.reconcile_dates(df, ["exam", "kind"], "cycle", "ord", list(extendable), "kind").collect()
    return [r["outcome"] for r in sorted(got, key=lambda r: r["ord"])]


def test_dates_never_choose_in_silence(spark):
    assert outcomes(spark, [("K", "", "2024-01-01", 2, False)]) == ["KEPT"]
    assert outcomes(spark, [("K", "", "2024-01-01", 2, False), ("K", "2024", "2024-01-01", 1, False)]) == ["KEPT", "MERGED"]
    # two official documents, two dates, none correcting the other
    assert outcomes(spark, [("K", "", "2024-01-01", 2, False), ("K", "", "2024-02-01", 0, False)]) == ["NEEDS_REVIEW"] * 2
    # one says that it revises; a third gives the revised date too
    assert outcomes(spark, [("K", "", "2024-01-01", 2, False), ("K", "", "2024-02-01", 3, True), ("K", "", "2024-02-01", 2, False)]) == ["SUPERSEDED", "GOVERNS", "CORROBORATES"]
    # a revision without a date, or with nothing dated beside it, revises nothing
    assert outcomes(spark, [("K", "", "2024-01-01", 2, False), ("K", "", None, 2, True)]) == ["NEEDS_REVIEW"] * 2
    # an extended window: the later word of a better source governs, an earlier one does not
    window = "APPLICATION_WINDOW"
    assert outcomes(spark, [(window, "", "2024-01-01", 2, False), (window, "", "2024-02-01", 1, False)]) == ["SUPERSEDED", "GOVERNS"]
    assert outcomes(spark, [(window, "", "2024-03-01", 2, False), (window, "", "2024-02-01", 1, False)]) == ["NEEDS_REVIEW"] * 2
    assert outcomes(spark, [(window, "", "2024-01-01", 2, False), (window, "", "2024-02-01", 1, False), (window, "", "2024-01-15", 0, False)]) == ["NEEDS_REVIEW"] * 3
    # different cycles are different events; a blank one joins the first bucket that fits
    assert outcomes(spark, [("K", "2024", "2024-01-01", 2, False), ("K", "2025", "2025-01-01", 2, False), ("K", "", "2024-01-01", 2, False)]) == ["KEPT", "KEPT", "MERGED"]


def test_milestones_pair_greedily(spark):
    schema = "id long, kind string, cycle string, scope string, date string, revises boolean"
    old = spark.createDataFrame([(1, "APPLICATION_WINDOW", "", "", "2024-01-01", False), (2, "EXAM", "2024", "", "2024-05-01", False), (3, "EXAM", "2024", "II", "2024-06-01", False), (4, "RESULT", None, "", "2024-07-01", False)], schema)
    new = spark.createDataFrame(
        [(11, "APPLICATION_END", "2024", "", "2024-02-01", True), (12, "EXAM", "2025", "", "2025-05-01", False), (13, "EXAM", "", "", "2024-05-01", False), (14, "EXAM", "", "II", None, False), (15, "RESULT", "2024", "", "2024-07-02", False), (16, "RESULT", "", "", "2024-07-01", False)], schema
    )
    got = {(r["existing_id"], r["incoming_id"]): r["action"] for r in R.merge_milestones(old, new, ["scope"]).collect()}
    assert got == {(1, 11): "SUPERSEDED", (2, 13): "CONFIRMED", (3, 14): "UNCHANGED", (4, 15): "CONFLICTED", (None, 12): "ADDED", (None, 16): "ADDED"}


def test_fact_rules_in_turn(spark):
    schema = "ord long, exam string, field string, value string, kind string, source_url string, confidence double, reachable boolean"
    ok = "https://a.org/"
    rows = [
        (1, "e", "f", "5", "INTEGER", ok, 0.7, True), (2, "e", "f", "5", "INTEGER", ok, 0.7, True), (3, "e", "f", " ", "TEXT", ok, 0.7, True), (4, "e", "f", "x", "TEXT", "a.org", 0.7, True),
        (5, "e", "d", "2024-02-30", "DATE", ok, 0.7, True), (6, "e", "g", "a", "TEXT", ok, 0.7, True), (7, "e", "g", "B", "TEXT", "https://b.org/", 0.9, True), (8, "e", "g", "A ", "TEXT", "https://c.org/", 0.9, True),
        (9, "e", "h", "x", "TEXT", ok, 0.5, True), (10, "e", "i", "x", "TEXT", ok, 0.9, False), (11, "e", "j", "x", "TEXT", ok, 0.6, True),
    ]
    got = {r["ord"]: (r["status"], r["reason"]) for r in R.validate_facts(spark.createDataFrame(rows, schema), ["exam", "field"], "ord").collect()}
    assert got == {
        1: ("validated", ""), 2: ("duplicate", "duplicate"), 3: ("rejected", "required"), 4: ("rejected", "url"), 5: ("rejected", "date"), 6: ("conflicting", "rivals"), 7: ("conflicting", "rivals"),
        8: ("conflicting", "rivals"), 9: ("pending", "confidence"), 10: ("pending", "unreachable"), 11: ("validated", ""),
    }


def test_rivals_are_counted_as_pairs_would(spark):
    rows = [(i, v, s) for i, (v, s) in enumerate([("a", 1), ("a", 2), ("b", 1), ("b", 3), (None, 4), ("c", None), ("a", 1)])]
    df = spark.createDataFrame([(0, *r) for r in rows], "k int, id int, v string, s int")
    want = {i: sum(v is not None and s is not None and w is not None and t is not None and v != w and s != t for _, w, t in rows) for i, v, s in rows}
    assert {r["id"]: r["rivals"] for r in ladders.rivals(df, ["k"], "v", "s").collect()} == want
    assert ladders.rival_groups(df, ["k"], "v", "s").first()["conflicting"] is True
    alone = df.where("v = 'a' OR s = 1 OR s IS NULL").where("NOT (v = 'a' AND s = 2)")
    assert ladders.rival_groups(alone, ["k"], "v", "s").first()["conflicting"] is False


def test_decisions_by_name_alone(spark):
    rows = [("one", "a", 9.0, False), ("one", "b", 1.0, True), ("two", "a", 6.0, False), ("two", "b", 4.0, False), ("told", "a", 6.0, False), ("told", "b", 4.0, True), ("faint", "a", 0.0, False), ("faint", "b", 0.0, False)]
    got = {r["q"]: (r["decision"], r["chosen"]) for r in R.decide(spark.createDataFrame(rows, "q string, body string, score double, named boolean"), ["q"]).collect()}
    assert got == {"one": ("RESOLVED", "a"), "two": ("AMBIGUOUS", None), "told": ("RESOLVED", "b"), "faint": ("RESOLVED", "a")}


def test_passages_are_scored_and_cut_no_token(spark):
    field = X.Field("fee", "fee", "application|payable", "refund", "[0-9]+")
    text = "The fee refund refund is 77. " + "x " * 150 + "application fee payable is 500 only. " + "y" * 300 + " end"
    docs = spark.createDataFrame([(1, text), (2, "fee of nothing"), (3, None)], "id long, t string")
    found = X.extract(docs, (field,), "id", "t").collect()
    assert [(r["id"], r["value"], r["score"]) for r in found] == [(1, "500", 2.2)]
    assert X.narrowest(X.extract(docs, (field,), "id", "t"), (field,), "id").first()["span"].endswith("application fee payable is 500 only.")
    pieces = docs.where("id = 1").select(F.explode(X.passages(F.col("t"))).alias("w")).select("w.*").collect()
    assert all(set(p["piece"].split()) <= set(text.split()) for p in pieces)


def test_walks_keep_their_budgets(spark):
    links = [("w", "r", f"a{i}", i) for i in range(6)] + [("w", f"a{i}", f"b{i}{j}", j) for i in range(6) for j in range(4)] + [("w", "a0", "r", 9), ("w", "a1", "b00", 9)]
    roots = spark.createDataFrame([("w", "r")], "run string, node string")
    got = graph.walk(spark.createDataFrame(links, "run string, source string, target string, pos int"), roots, 2, 3, 12).collect()
    by = {r["node"]: r for r in got}
    assert {n for n, r in by.items() if r["opened"]} == {"r", "a0", "a1"} and len(got) == 12
    assert [r["node"] for r in sorted(got, key=lambda r: r["place"])] == ["r", *[f"a{i}" for i in range(6)], "b00", "b01", "b02", "b03", "b10"]
    assert max(r["depth"] for r in got) == 2


def test_each_budget_of_a_walk_decides(spark):
    kinds = {"p": (False, False), "q": (True, True), "f": (True, False)}
    links = [("w", "r", f"{k}{i}", n, *kinds[k]) for n, (k, i) in enumerate((k, i) for i in range(4) for k in "fpq")] + [("w", "p0", f"deep{i}", i, False, False) for i in range(5)]
    roots = spark.createDataFrame([("w", "r")], "run string, node string")
    df = spark.createDataFrame(links, "run string, source string, target string, pos int, file boolean, listed boolean")
    by = lambda **how: {r["node"]: r["state"] for r in graph.walk(df, roots, 2, **how).collect()}
    whole = by(pages=9, nodes=99, files=99)
    assert len(whole) == 18 and {n for n, s in whole.items() if s != "OPENED"} == {f"deep{i}" for i in range(5)} and whole["deep0"] == "DEPTH_LIMIT"
    files = by(pages=9, nodes=99, files=5)  # items of repositories first, then loose files in queue order
    assert {n for n, s in files.items() if s == "OPENED" and n[0] in "fq"} == {"q0", "q1", "q2", "q3", "f0"} and files["f1"] == "FILE_BUDGET"
    pages = by(pages=2, nodes=99, files=99)
    assert {n for n, s in pages.items() if s == "PAGE_BUDGET"} == {"p1", "p2", "p3"} and pages["p0"] == "OPENED"
    assert len(by(pages=9, nodes=7, files=99)) == 7


def test_trees_of_depth_fifty_are_planned_in_seconds(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, ("ALL", "ANY")[i % 2], None) for i in range(50)] + [("leaf", "n49", None, "FAIL"), *[(f"ok{i}", f"n{i}", None, "OK") for i in range(0, 50, 7)]]
    began = time.perf_counter()
    got = {r["node"]: r["state"] for r in graph.fold_rules(spark.createDataFrame(rows, "node string, parent string, op string, state string")).collect()}
    want = "FAIL"
    for i in range(49, -1, -1):
        both = [want, *(["OK"] if i % 7 == 0 else [])]
        want = min(both) if i % 2 == 0 else max(both)  # FAIL < OK
        assert got[f"n{i}"] == want
    assert time.perf_counter() - began < 90


def test_provenance_ends_at_roots_hops_and_loops(spark):
    edges = [(f"n{i}", f"n{i + 1}", 0) for i in range(12)] + [("late", "n1", 5), ("x", "y", 0), ("y", "z", 0), ("z", "x", 0)]
    got = {r["node"]: r["chain"] for r in graph.provenance(spark.createDataFrame(edges, "source string, target string, ord int")).collect()}
    assert got["n1"] == ["n0"] and got["n3"] == ["n0", "n1", "n2"] and got["n12"] == [f"n{i}" for i in range(4, 12)]
    assert len(got["x"]) == 3 and got["x"][-1] == "z"
    with pytest.raises(ValueError):
        graph.provenance(spark.createDataFrame(edges, "source string, target string, ord int"), 6)


def test_rule_trees_and_topics(spark):
    rows = [("root", None, "ALL", None), ("g", "root", "ANY", None), ("h", "root", "ALL", None), ("e", "root", "ANY", None), ("a", "g", None, "FAIL"), ("b", "g", None, "OK"), ("c", "h", None, "UNKNOWN"), ("d", "h", None, "OK")]
    got = {r["node"]: r["state"] for r in graph.fold_rules(spark.createDataFrame(rows, "node string, parent string, op string, state string")).collect()}
    assert (got["g"], got["h"], got["e"], got["root"]) == ("OK", "UNKNOWN", "UNKNOWN", "UNKNOWN")
    topics = graph.flat_topics(spark.createDataFrame([(n, p) for n, p, *_ in rows] + [("solo", None)], "node string, parent string"))
    assert {(r["topic"], r["subtopics"]) for r in topics.collect()} == {("g", 2), ("h", 2), ("e", 0), ("solo", 0)}


def test_jobs_wait_their_turn(spark):
    step = stateful.job_queue()()
    s = 1_000_000
    assert step(0, "a", 10 * s, False) == 0
    assert step(2 * s, "a", 10 * s, False) is None  # answered by the running one
    assert step(3 * s, "b", 5 * s, True) == 10 * s  # fails: 3 tries and two waits, until 50
    assert step(11 * s, "a", s, False) == 50 * s
    assert step(60 * s, "b", s, False) == 60 * s
    check = stateful.debounced(10)()
    assert [check(t) for t in (0, 5, 10, 11, 20, 22)] == [True, False, False, True, False, True]


def test_lists_scopes_and_names(spark):
    items = spark.createDataFrame([("red bolt",), ("a",), ("",)], "item string")
    asked = spark.createDataFrame([("bol",), ("t",), ("d b",), ("zzz",), ("",), ("a",)], "wanted string")
    assert {tuple(r) for r in joins.containing(items, asked, "item", "wanted").collect()} == {("red bolt", "bol"), ("red bolt", "t"), ("red bolt", "d b"), ("a", "a")}
    nodes = spark.createDataFrame([(1, "Light", "A"), (2, "light", "B"), (3, "Light", "B"), (4, "Heat", "A")], "ord int, node string, parent string")
    assert [r["id"] for r in reads.unique_ids(nodes, "node", "parent", "ord").orderBy("ord").collect()] == ["light", "light-b", "light-b-2", "heat"]
    base, log = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double"), [(1, "RETIRE", None, 1), (1, "AMEND", 9.0, 2), (2, "AMEND", 5.0, 3), (3, "AMEND", 1.0, 1), (1, "ADD", 7.0, 4), (1, "AMEND", 8.0, 5)]
    got = ladders.apply_revisions(base, spark.createDataFrame(log, "k int, kind string, value double, seq long"), "k")
    assert {(r["k"], r["value"]) for r in got.collect()} == {(1, 8.0), (2, 5.0)}


def test_notices_and_tables(spark):
    one = lambda text, column: spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]
    assert one("on 31/12/2024, 13 May 2024 and 05.25.2024; June 2024, Feb 30, 2024", N.dates) == ["2024-12-31", "2024-05-13", "2024-05-25", "2024-06"]
    assert one("fee Rs. 1,00,000/-, INR 50.5; 27 years. 3", N.amounts) == [100000.0, 50.5]
    assert [one(t, N.complete) for t in ("It ends.", "It is (open", "of the", "no mark", "")] == [True, False, False, None, False]
    assert one("exam postponed from 1 May 2024 to 2 June 2024", N.revision).asDict() == {"kind": "EXAM_DATE", "old": "2024-05-01", "new": "2024-06-02"}
    assert [one(t, T.clock) for t in ("at 12:05 am", "1.30 p.m.", "25:00", "x")] == ["00:05", "13:30", None, None]
    assert one("99999", lambda c: T.lakhs(c.cast("long"))) == "99,999" and one("12345678", lambda c: T.lakhs(c.cast("long"))) == "1,23,45,678"
    page = spark.createDataFrame([(1, "<h2>Notices</h2><p>See <a href=x>one</a></p><h3>More</h3><ul><li><a href=y>two &amp; three</a></li></ul>")], "id int, html string")
    assert [(r["text"], r["heading"]) for r in records.links_in_context(page).orderBy("pos").collect()] == [("one", "Notices"), ("two & three", "More")]
    assert [(r["text"], r["links"]) for r in records.blocks(page).orderBy("pos").collect()] == [("Notices", 0), ("See one", 1), ("More", 0), ("two & three", 1)]
    lines = spark.createDataFrame([(1, "Head\n1. red bolt 12\n2) hot gear 1,200\n9. stray 5\nTotal 7"), (2, "4. late 5")], "id int, t string")
    assert [(r["id"], r["ordinal"], r["name"], r["n"]) for r in records.numbered_rows(lines, "id", "t").orderBy("id", "ordinal").collect()] == [(1, 1, "red bolt", 12), (1, 2, "hot gear", 1200)]
