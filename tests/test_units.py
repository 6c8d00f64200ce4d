"""Units of texts made by hand, and values that windows cut."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import units as U
from factloom.operators import extract as X


def units(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", U.flat(F.col("t")).alias("t"))
    rows = sorted(U.sentences_of(df, "id", "t").collect(), key=lambda r: (r["id"], r["begin"]))
    whole = {r["id"]: r["t"] for r in df.collect()}
    assert all(whole[r["id"]][r["begin"] : r["end"]] == r["sentence"] for r in rows)
    return [[(r["sentence"].strip(), r["complete"]) for r in rows if r["id"] == i] for i in range(len(texts))]


def test_sentences_end_at_marks_that_end_them(spark):
    told = units(
        spark, "Apply to Dr. A. Rao at G.O.Ms. No. 5. Then wait! Is it so? (Yes.) it goes on.",
        "He must hold a degree 10.3 in law. 10.4 Any person may APPLY\n\nANNEXURE-II Posts: 5. Sd/- Secretary", "", "no end", "fee of Rs. 500 only. 2. Bring it. and go on. Done.",
    )
    assert told[0] == [("Apply to Dr. A. Rao at G.O.Ms. No. 5. Then wait!", True), ("Is it so?", True), ("(Yes.) it goes on.", True)]
    assert told[1] == [("He must hold a degree 10.3 in law.", True), ("10.4 Any person may APPLY", False), ("ANNEXURE-II Posts: 5.", False), ("Sd/- Secretary", False)]
    assert told[2] == [] and told[3] == [("no end", False)]
    assert told[4] == [("fee of Rs. 500 only.", True), ("2. Bring it. and go on.", True), ("Done.", True)]


DEGREE = X.Field("degree", "(?i)degree", "(?i)possess|must", "(?i)unless", r"(?i)must possess [^.]*\bdegree\b[^.]*")


def test_a_value_that_a_window_cuts_comes_back_whole_or_not_at_all(spark):
    filler = "Words stand here that say nothing of it at all. " * 6
    said = "Candidates must possess a degree of a university that was established by an Act of the Centre or of a Province or of a State, or an equal one as the Board may say from time to time in its own orders and notices"
    docs = [(1, filler + said + "."), (2, filler + said), (3, filler + "must possess a degree 10.2 (see below) " + filler + "All must possess a degree in law."), (4, None), (5, "degree")]
    got = {r["id"]: r for r in X.extract_units(spark.createDataFrame(docs, "id int, t string"), (DEGREE,), "id", "t").collect()}
    assert set(got) == {1, 3}
    assert got[1]["value"] == said[len("Candidates ") :] and got[1]["span"] == said + "."
    assert got[3]["value"] == "must possess a degree in law" or got[3]["value"].startswith("must possess a degree 10")
    pieces = [p["piece"] for p in spark.createDataFrame([docs[0]], "id int, t string").select(F.explode(X.passages(F.col("t"))).alias("w")).select("w.piece").collect()]
    assert not any(got[1]["value"] in p for p in pieces)  # no window holds it


def test_a_passage_whose_sentence_is_cut_gives_way_to_the_next(spark):
    filler = "Nothing is said here of what is asked for by anybody. " * 8
    text = filler + "One must possess a degree possess possess AGO ANNEXURE-I " + filler + "Each must possess a degree in law."
    (r,) = X.extract_units(spark.createDataFrame([(1, text)], "id int, t string"), (DEGREE,), "id", "t").collect()
    assert r["value"] == "must possess a degree in law" and r["span"] == "Each must possess a degree in law."


def test_windows_follow_the_length_of_a_text(spark):
    took = {}
    for n in (100_000, 100_000, 1_600_000):
        df = spark.createDataFrame([("word" * (n // 4 - 1) + "end.",)], "t string")
        began = time.perf_counter()
        rows = df.select(F.explode(X.passages(F.col("t"))).alias("w")).agg(F.count("*"), F.max("w.start")).first()
        took[n] = time.perf_counter() - began
        assert rows[0] == n // 160 - 1 or n % 160
    assert took[1_600_000] < 40 * took[100_000] + 5
    short = spark.createDataFrame([(1, ""), (2, "a" * 160), (3, "b" * 321), (4, None)], "id int, t string").select("id", T.windows(F.col("t")).alias("w"))
    assert {r["id"]: None if r["w"] is None else [(w["start"], len(w["piece"])) for w in r["w"]] for r in short.collect()} == {1: [(0, 0)], 2: [(0, 160)], 3: [(0, 320), (160, 161)], 4: None}
