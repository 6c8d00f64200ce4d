"""Functions, folds, sources and streams on small rows made by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import dates, logic, text, urls
from factloom.operators import ladders, stateful
from factloom.plans.catalog import QUERIES
from factloom.sources import records
from factloom.streaming import ingest


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r["v"] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    told = ["on 31/12/2024", "3rd March, 2021", "Feb. 29 2023 or March 5, 2023, of which each form's first counts", "5.6.24", "none", None]
    assert values(spark, told, dates.first_date) == [dt.date(2024, 12, 31), dt.date(2021, 3, 3), None, dt.date(2024, 6, 5), None, None]
    df = spark.sql("select date'2000-02-29' a, date'2018-02-28' b").select(dates.age(F.col("a"), F.col("b")).alias("v"))
    assert df.first()["v"] == 17


def test_text(spark):
    assert values(spark, [" a  \t b\n", "", None], text.squash) == ["a b", "", None]
    assert values(spark, ["-", "1 1", "2 + 2", "x", ""], text.cell_count) == [0, 11, 4, None, None]
    assert values(spark, ["1,00,000 and 7 and 100000", ""], text.figures) == [["100000", "7"], []]
    assert values(spark, ["2 hours 30 minutes", "45 min", "soon"], text.minutes) == [150, 45, None]
    assert values(spark, ["One. Two? Three 3.5!"], text.sentences) == [["One.", "Two?", "Three 3.5!"]]
    assert values(spark, ["Hello, World!"], text.slug) == ["hello-world"]
    assert [len(w) for w in values(spark, ["x" * 320, "x" * 321, "x" * 481, ""], text.windows)] == [1, 2, 3, 1]
    names = spark.createDataFrame([("red bolt", "bolt red"), ("red bolt", "red"), ("red bolt old", "red bolt"), ("red bolt", "blue nut"), ("red bolt x1", "red nut x2")], "a string, b string")
    assert [r[0] for r in names.select(text.name_score(text.words(F.col("a")), text.words(F.col("b")))).collect()] == [1.0, 0.5, 0.9, 0.0, 0.4 / 3]


def test_urls(spark):
    assert values(spark, ["HTTP://A.Example.com/x/?utm_source=f&b=1#t", "https://a.b/", None], urls.normalise) == ["http://a.example.com/x?b=1", "https://a.b/", None]
    odd = ["https://U@H.org:443//p/?A=%41&gclid=1&q=&UTM_x=2", "http://h:8080", "ftp://H/x/ ", "http://www.h.org/a"]
    assert values(spark, odd, urls.normalise) == ["https://h.org//p?A=%41&q=", "http://h:8080/", "ftp://H/x/", "http://www.h.org/a"]
    assert values(spark, odd[3:], urls.key) == ["h.org/a"]
    assert values(spark, ["http://u@WWW.a.example.org:80/p"], urls.host) == ["www.a.example.org"]


def test_kleene(spark):
    states = ["OK", "FAIL", "UNKNOWN"]
    df = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    got = {(r["a"], r["b"]): (r["x"], r["y"]) for r in df.select("a", "b", logic.all_of(F.col("a"), F.col("b")).alias("x"), logic.any_of(F.col("a"), F.col("b")).alias("y")).collect()}
    rank = {"FAIL": 0, "UNKNOWN": 1, "OK": 2}
    for (a, b), (x, y) in got.items():
        assert rank[x] == min(rank[a], rank[b]) and rank[y] == max(rank[a], rank[b])


def test_budget_folds():
    taken, batch = stateful.budget(100)(), stateful.batches(55)()
    assert [taken(s) for s in (5, 60, 50, 40, 5)] == [True, True, False, False, True][:3] + [False, True]
    assert [batch(s) for s in (5, 60, 50, 40, 5)] == [0, -1, 0, 1, 1]


def test_limiters_against_a_plain_loop(spark):
    for name, make in (("k4_sliding_limiter", stateful.sliding_limiter(3, 24 * 3_600_000_000)), ("k3_token_bucket", stateful.token_bucket(4.0, 48 * 3_600_000_000))):
        rows = sorted((r["user_id"], r["at"], r["event_id"], r["allowed"]) for r in QUERIES[name].run(spark, "/root/testdata/sf0.001").collect())
        steps = {}
        for user, at, _, allowed in rows:
            assert steps.setdefault(user, make())(at) == allowed
        assert {a for *_, a in rows} == {True, False}


def test_overlays_are_idempotent(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, value double")
    log = spark.createDataFrame([(1, "AMEND", 5.0, 1, True), (3, "AMEND", 9.0, 1, True), (3, "ADD", 7.0, 2, True), (2, "RETIRE", None, 3, True), (2, "SUPERSEDE", 8.0, 4, False)], "k long, kind string, value double, seq long, active boolean")
    once = ladders.apply_overlays(base, log, "k").select("k", "value")
    assert {tuple(r) for r in once.collect()} == {(1, 5.0), (2, 2.0), (3, 7.0)}
    assert {tuple(r) for r in ladders.apply_overlays(once, log, "k").select("k", "value").collect()} == {(1, 5.0), (2, 2.0), (3, 7.0)}


def test_sources(spark):
    raw = spark.createDataFrame([(1, '{"data": [{"a": 1}, {"a": 2}]}'), (2, '{"data": {"a": 1}}'), (3, "broken"), (4, '{"data": []}')], "id int, body string")
    good, bad = records.feed_items(raw, "body", StructType.fromDDL("a int"))
    assert [(r["id"], r["a"]) for r in good.orderBy("id", "pos").collect()] == [(1, 1), (1, 2)]
    assert {r["id"] for r in bad.collect()} == {2, 3}
    page = spark.createDataFrame([(1, "<table><tr><th>A</th><td>b &amp; c</td></tr></table><script>x</script>")], "id int, html string")
    assert records.table_rows(page).first()["cells"] == ["A", "b & c"]
    assert page.select(records.visible_text(F.col("html"))).first()[0] == "A b & c"
    xml = spark.createDataFrame([(1, "<feed>" + "".join(f'<entry><title>t{i}</title><link href="u{i}"/></entry>' for i in range(6)) + "</feed>")], "id int, xml string")
    assert [r["title"] for r in records.feed_entries(xml, "xml").orderBy("pos").collect()] == ["t0", "t1", "t2", "t3"]
    ok, rejects = records.checked(page, {"has id": F.col("id") > 1})
    assert ok.count() == 0 and rejects.first()["problems"] == ["has id"]


def test_unreadable(spark):
    few, many = "brwn fxjmps " * 10, "the brown fox jumps over " * 10
    texts = [few, "Brwn fxjmps the lzy dg " * 12, many, "CRPF NTPC SSC " * 40, many + "xkcd " * 9, many + "xkcd " * 14, None]
    assert values(spark, texts, records.unreadable) == [False, True, False, False, False, True, None]


def test_streams(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, 10), (2, 1, 10)], [(1, 2, 20), (1, 3, 15)]]):
        spark.createDataFrame(rows, "user_id long, seq long, at long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("user_id long, seq long, at long").parquet(f"{tmp_path}/in/*")
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/c1", ["user_id"], ["at", "seq"]).awaitTermination()
    assert {tuple(r) for r in ingest.snapshot(spark, f"{tmp_path}/out", ["user_id"], ["at", "seq"]).select("user_id", "seq", "at").collect()} == {(1, 2, 20), (2, 1, 10)}
    q = ingest.limited(stream.select("user_id", "at"), 2.0, 3600.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select user_id, sum(calls), sum(allowed) from limited group by 1").collect()} == {(1, 3, 2), (2, 1, 1)}
