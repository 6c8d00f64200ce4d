"""Question papers, keys and clauses made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import eligibility as E
from factloom.operators import papers as P

PAPER = """General instructions: 1. is not a question
1. First?
(a) x (b) y
(c) z (d) w
3. printed out of turn
2) Second of
1. a list
2. of its own?
A. p B. q C. r D. s
Question No. 3: Third? (A) 1 (B) 2 (C) 3
4. Fourth? (A) 1 (A) 2 (B) 3 (C) 4"""


def test_questions_go_on_by_one(spark):
    df = spark.createDataFrame([("p", PAPER), ("none", None), ("text", "no numbers")], "id string, t string")
    got = P.questions(df, "id", "t").collect()
    run = {r["n"]: (r["question"], [o["label"] for o in r["options"]]) for r in got if r["in_run"]}
    assert run == {
        1: ("First?", list("ABCD")), 2: ("Second of 1. a list 2. of its own?", list("ABCD")), 3: ("Third?", list("ABC")), 4: ("Fourth?", list("AABC")),
    }
    assert sorted(r["n"] for r in got if not r["in_run"]) == [1, 2, 3] and {r["id"] for r in got} == {"p"}


def test_keys_are_aligned_and_what_does_not_fit_is_held(spark):
    df = spark.createDataFrame([("p", PAPER)], "id string, t string")
    key = spark.createDataFrame([("p", "1-B 2: *  3.(C) 4=A, 9) D 1-B"), ("q", "1-A 1-B")], "id string, t string")
    told = P.answers(key, "id", "t")
    assert {(r["id"], r["n"]): r["answer"] for r in told.collect()} == {("p", 1): "B", ("p", 2): "*", ("p", 3): "C", ("p", 4): "A", ("p", 9): "D", ("q", 1): None}
    got = {(r["id"], r["n"]): r["state"] for r in P.aligned(P.questions(df, "id", "t").where("in_run"), told, "id").collect()}
    assert got == {("p", 1): "ANSWERED", ("p", 2): "WITHDRAWN", ("p", 3): "HELD", ("p", 4): "HELD", ("p", 9): "KEY_ONLY", ("q", 1): "KEY_ONLY"}


def test_clauses_name_posts_by_codes_and_ranges(spark):
    texts = ["Post codes 01 to 03, 7 and 9-10: age", "posts 5 & 6", "post no. 4", "for all posts", "posts 9 to 3", "Post code 1 to 999", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(E.codes_of(F.col("t"))).collect()]
    assert got == [[1, 2, 3, 7, 9, 10], [5, 6], [4], [], [], [], None]


def test_what_is_told_of_a_post_wins(spark):
    text = "Age 18 to 30 years for every post.\nPosts 2, 3: maximum age 35.\nPost code 3: age 25 to 40 years; master degree."
    notices = spark.createDataFrame([("n", text), ("m", "nothing")], "id string, t string")
    posts = spark.createDataFrame([("n", 1), ("n", 2), ("n", 3), ("m", 1)], "id string, code int")
    got = {(r["id"], r["code"]): (r["low"], r["low_scope"], r["high"], r["high_scope"], r["level"]) for r in E.in_force(posts, E.rules_of(notices, "id", "t"), "id", "code").collect()}
    assert got == {
        ("n", 1): (18, "GENERAL", 30, "GENERAL", None), ("n", 2): (18, "GENERAL", 35, "POST", None),
        ("n", 3): (25, "POST", 40, "POST", "POST_GRADUATION"), ("m", 1): (None, None, None, None, None),
    }
