"""What a query must not leave out, on the smallest tables or on rows made by hand."""

from __future__ import annotations

import duckdb

from factloom.operators import cues, graph, stateful
from factloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_folds_cover_every_event(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    users = {}
    for user, event, size in con.execute("SELECT user_id, event_id, CAST(round(value) AS BIGINT) FROM events ORDER BY user_id, ts DESC, event_id DESC").fetchall():
        users.setdefault(user, []).append((event, size))
    taken, batch = {}, {}
    for own in users.values():
        used, now, filled, held = 0, 0, 0, 0
        for event, size in own:
            taken[event] = used + size <= 100
            used += size * taken[event]
            if size > 60:
                batch[event] = -1
                continue
            if held and filled + size > 40:
                now, filled, held = now + 1, 0, 0
            batch[event], filled, held = now, filled + size, held + 1
    assert max(map(len, users.values())) > 50
    for name, out, want in (("n7_within_budget", "taken", taken), ("w24_sync_batches", "batch", batch)):
        rows = [tuple(r) for r in QUERIES[name].run(spark, SF).select("user_id", "event_id", out).collect()]
        assert len(rows) == len(want) == 1000 and {e: x for _, e, x in rows} == want
        assert set(con.execute(f"SELECT user_id, event_id, {out} FROM ({QUERIES[name].sql})").fetchall()) == set(rows)


def test_fold_keys_are_null_safe_and_exact(spark):
    rows = [(9007199254740993, i, i) for i in range(3)] + [(9007199254740992, i, 10 + i) for i in range(3)] + [(None, i, 20 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id long, at long, event_id long")
    got = stateful.fold(df, "user_id", ["at", "event_id"], stateful.sliding_limiter(3, 100), ["at"], "allowed", "boolean").collect()
    assert sorted((str(r["user_id"]), r["event_id"]) for r in got) == sorted((str(k), e) for k, _, e in rows)
    assert sum(r["allowed"] for r in got if r["user_id"] is None) == 3 and all(r["allowed"] for r in got if r["user_id"] is not None)


def test_ancestors_of_any_depth(spark):
    rows = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(50)] + [("x", "y"), ("y", "z"), ("z", "x"), ("own", "own"), ("kid", "stranger")]
    got = {r["node"]: (r["root"], r["level"]) for r in graph.ancestors(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert {n: x for n, x in got.items() if n.startswith("n")} == {f"n{i:03d}": ("n000", i) for i in range(50)}
    assert got["kid"] == ("stranger", 1) and got["own"][0] == "own" and len(got) == len(rows) and {"x", "y", "z"} <= set(got)


def test_over_the_budget_but_within_the_limit_goes_alone():
    sizes = [10, 80, 10, 45, 120, 5, 60, None]
    step = stateful.batches(60, 100)()
    assert [step(s) for s in sizes] == [0, 1, 2, 2, -1, 2, 3, None]
    assert stateful.budget(100)()(None) is None


def test_facts_have_values(spark):
    texts = [
        "call us, license, http and last date unknown.",
        "Total vacancies: 1,250 posts. Last date to apply is 31st March 2026; closing date 1/4/26.",
        "The exam is held on 31/02/2025 or May 5, 2025. Official website below.\n" + "x " * 200 + "see https://a.example.org/x.",
        "Last date soon, closing date 05-06-2027" + " y" * 150,
        "last date" + " z" * 120 + " closing date 07.08.2027",
        "vacancy" + " w" * 120 + " 12",
        None,
    ]
    got = cues.typed_facts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["field"], r["value"], r["cue"], r["confidence"]) for r in got} == {
        (1, "vacancies", "1250", "total vacancies", 0.7), (1, "application_last_date", "2026-04-01", "last date", 0.7),
        (2, "exam_date", "2025-05-05", "held on", 0.7), (2, "official_website", "https://a.example.org/x", "official website", 0.7),
        (3, "application_last_date", "2027-06-05", "last date", 0.7), (4, "application_last_date", "2027-08-07", "closing date", 0.7),
    }
    assert all(r["value"] and r["raw_value"] in r["evidence"] for r in got if r["value_type"] != "URL") and all(len(r["evidence"]) <= 200 for r in got)
    assert len(cues.FIELDS) == 18
    ids = spark.createDataFrame([(2**53 + 1, "last date 1/2/2030"), (None, "last date 1/2/2030"), (3, "")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in cues.typed_facts(ids).collect()} == {2**53 + 1, None}
    out = QUERIES["x4_cue_facts"].run(spark, SF)
    assert "value" in out.columns and out.count() > 0 and out.where("value IS NULL").count() == 0


def test_links_as_pages_write_them(spark):
    html = """<a href='one'>1</a> <A HREF="/two?a=1&amp;b=2">2</A> <a class=x href ="three">3</a> <a href=/four>4</a> <a
    title="it's" href = 'five&#x2f;&eacute;'>5</a> <a name="none">none</a> <abbr href="no">x</abbr> <a href="">6</a> <a id=i's href=" seven ">7</a> <a href="mailto:a@b">8</a>"""
    got = graph.page_links(spark.createDataFrame([(1, "https://h.example.org/d/p", html), (2, "https://h.example.org/", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [r["href"] for r in got] == ["one", "/two?a=1&b=2", "three", "/four", "five/é", "", "seven", "mailto:a@b"]
    assert got[1]["target"] == "https://h.example.org/two?a=1&b=2" and got[0]["target"] == "https://h.example.org/d/one"


def test_lookups_and_overlays_take_whole_tables(spark):
    con = duckdb.connect()
    for name in ("part", "customer", "nation", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name in ("x17_overlay_fold", "j15_label_then_code", "a15_transfer"):
        assert "WHERE p_partkey" not in QUERIES[name].sql and "c_acctbal" not in QUERIES[name].sql
        got = QUERIES[name].run(spark, SF).collect()
        if name == "j15_label_then_code":
            assert {r["tier"] for r in got} == {"LABEL", "CODE", "AMBIGUOUS", "NONE"}
        if name == "x17_overlay_fold":
            assert {r[0] for r in con.execute("SELECT p_partkey FROM part").fetchall()} <= {r["k"] for r in got}


def test_only_system_turns_vouch_for_figures(spark, tmp_path):
    rows = [(1, 0, "system", "The fee is 500."), (1, 1, "user", "Is the fee 750?"), (1, 2, "assistant", "Yes, 750, not 500; see https://a.example.org/07-2031.pdf"), (2, 0, "user", "4?"), (2, 1, "assistant", "4 and 5."), (2, 2, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["x47_answer_figures"].run(spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"], r["n_unsupported"]) for r in got} == {(1, 2, 1), (2, 1, 2), (2, 2, 0)}
