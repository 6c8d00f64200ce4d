"""Runs of words against a search of every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import periodic_runs as pr
from factloom.llm import queries


def brute(x, least=24, times=3):
    n, found = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)  # periods ascend: the first is the smallest
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, letters):
    out = []
    while len(out) < rng.choice([10, 60, 200]):
        root = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
        out += (root * rng.randrange(1, 9))[: rng.randrange(1, 80)]
        if len(out) > 30 and rng.random() < 0.4:  # what stood before comes again, so that runs are copied
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(5, 90)]
    return out


def test_runs_of_periodic_sequences():
    rng = random.Random(5)
    many = 0
    for _ in range(1500):
        x = periodic(rng, rng.choice([1, 2, 3, 9]))
        want = brute(x)
        many += len(want)
        assert pr.runs_of(x) == want
        assert pr.text_runs([b"w%d" % c for c in x]) == want
    assert many > 1000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_runs_of_any_binary_sequence(x):
    assert pr.runs_of(x) == brute(x)


def test_factors_are_the_longest_that_began_before():
    rng = random.Random(6)
    for _ in range(200):
        x = periodic(rng, 3)
        at = 0
        for i, size, source in pr.factors(x):
            began = [k for j in range(i) for k in [next((k for k in range(len(x) - i) if x[j + k] != x[i + k]), len(x) - i)]]
            assert i == at and size == max(1, max(began, default=0))
            assert source == -1 or (source < i and x[source : source + size] == x[i : i + size])
            at += size
        assert at == len(x)


def test_a_copied_run_is_found_without_its_border():
    run = [1, 2, 3] * 10
    x = [*range(10, 40), *run, *range(50, 90), *range(25, 40), *run, *range(50, 80), 999]
    assert pr.runs_of(x) == brute(x) and len(pr.runs_of(x)) == 2


def row_by_hand(doc_id, text, rewrite=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if rewrite and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(told), sha(kept))


def test_rows_of_the_smallest_table_and_of_hard_ones(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    hard = [
        (None, "a b " * 30), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (2**53 + 1, "x " * 24), (-7, "x " * 23), (8, "y" * 100_000), (9, "é ü " * 40), (9, "é ü " * 40),
        *[(i, " ".join(f"w{k}" for k in range(90))) for i in ids], (ids[0], "one"), (ids[1], "w " * 50),
    ]
    fields = "doc_id long, text string, runs string, start long"
    extra = spark.createDataFrame([(i, t, "r", 5) for i, t in hard], fields)
    got = sorted(map(str, (tuple(r) for df in (small.repartition(3), extra) for r in pr.find_runs(df, rewrite=True).collect())))
    want = sorted(str(row_by_hand(r["doc_id"], r["text"])) for df in (small, extra) for r in df.select("doc_id", "text").collect())
    assert got == want
    assert sum(r.count("None") < 4 for r in got) > 10
    assert pr.find_runs(extra.where("false")).count() == 0
    told = {r["doc_id"]: r for r in pr.find_runs(extra.where("doc_id = -7 or doc_id > 1000000"), spans=True).collect()}
    assert [tuple(r) for r in told[2**53 + 1]["runs"]] == [(0, 24, 1)] and told[2**53 + 1]["collapsed"] == "x" and told[-7]["collapsed"] == " ".join("x" * 23)


def test_the_query_reads_the_whole_table(spark):
    got = queries.op11_kolpakov_kucherov(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.columns[:3] == ["doc_id", "n_runs", "start"]


def test_a_very_long_text_takes_linear_time():
    rng = np.random.default_rng(1)
    took = []
    for n in (40_000, 160_000):
        root = [b"r%d" % i for i in rng.integers(0, 10**9, n // 6)]
        words = [b"u%d" % i for i in rng.integers(0, 10**9, n // 2)] + root * 3
        began = time.perf_counter()
        (run,) = pr.text_runs(words)
        took.append(time.perf_counter() - began)
        assert run == (n // 2, 3 * len(root), len(root))
    assert took[1] < 10 * took[0] + 1
