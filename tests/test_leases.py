"""Jobs that lose their worker: one by one, and as a stream whose timers end leases."""

from __future__ import annotations

import datetime as dt
import json
import time

from factloom.operators.stateful import Lease, leases
from factloom.streaming import ingest

S = 1_000_000


def test_a_lost_worker_gives_its_job_back():
    step = leases(90 * S, (5 * S, 20 * S))()
    told = [
        (0, "CLAIM", "a"), (1, "SUBMIT", ""), (2, "SUBMIT", ""), (3, "CLAIM", "a"), (4, "CLAIM", "b"), (60, "HEARTBEAT", "a"), (100, "HEARTBEAT", "b"), (150, "HEARTBEAT", "a"), (241, "CLAIM", "b"), (242, "DONE", "a"), (243, "FAIL", "b"),
        (250, "CLAIM", "b"), (263, "CLAIM", "b"), (300, "DONE", "b"), (301, "FAIL", "b"), (302, "SUBMIT", ""), (303, "CLAIM", "c"),
    ]
    assert [step(at * S, kind, who) for at, kind, who in told] == [
        "NONE:0:", "QUEUED:0:", "QUEUED:0:", "RUNNING:0:", "RUNNING:0:", "RUNNING:0:", "RUNNING:0:", "RUNNING:0:", "RUNNING:1:RECOVERED", "RUNNING:1:", "QUEUED:2:",
        "QUEUED:2:", "RUNNING:2:", "SUCCEEDED:2:", "SUCCEEDED:2:", "QUEUED:0:", "RUNNING:0:",
    ]


def test_attempts_end():
    job = Lease(90 * S, (5 * S,))
    for at, kind in ((0, "SUBMIT"), (1, "CLAIM")):
        job.step(at * S, kind, "a")
    assert job.ends == 91 * S and job.expire(91 * S) == "" and job.expire(91 * S + 1) == "RECOVERED"
    assert job.step(100 * S, "CLAIM", "b") == "RUNNING:1:" and job.step(300 * S, "HEARTBEAT", "b") == "FAILED:1:INTERRUPTED"
    assert Lease(held=job.held).held == job.held and job.ends is None


def test_a_stream_recovers_the_job_of_a_worker_that_is_never_heard_of_again(spark, tmp_path):
    def batch(n, *rows):
        lines = [json.dumps({"job": j, "at": (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at)).isoformat(), "kind": kind, "worker": w}) for j, at, kind, w in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        time.sleep(1.1)  # files are read in the order of their times

    batch(1, ("a", 0, "SUBMIT", ""), ("a", 1, "CLAIM", "w1"), ("a", 20, "HEARTBEAT", "w1"))
    batch(2, ("b", 400, "SUBMIT", ""), ("b", 401, "CLAIM", "w2"))  # the watermark passes the lease of a
    batch(3, ("b", 410, "DONE", "w2"))
    batch(4, ("a", 420, "DONE", "w1"), ("a", 421, "CLAIM", "w2"), ("a", 430, "DONE", "w2"))
    stream = spark.readStream.schema("job string, at timestamp, kind string, worker string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = ingest.leased(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("job", "at").collect()
    a = [(r["kind"], r["worker"], r["status"], r["retries"], r["note"]) for r in rows if r["job"] == "a"]
    assert a == [
        ("SUBMIT", "", "QUEUED", 0, ""), ("CLAIM", "w1", "RUNNING", 0, ""), ("HEARTBEAT", "w1", "RUNNING", 0, ""), ("EXPIRED", "", "QUEUED", 1, "RECOVERED"),
        ("DONE", "w1", "QUEUED", 1, ""), ("CLAIM", "w2", "RUNNING", 1, ""), ("DONE", "w2", "SUCCEEDED", 1, ""),
    ]
    assert [r["status"] for r in rows if r["job"] == "b"] == ["QUEUED", "RUNNING", "SUCCEEDED"]
