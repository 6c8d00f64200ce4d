"""Codes by heaps against plain rounds over all parts and entries, in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import heap_lloyd as hl
from factloom.llm import queries

FIELDS = "vec_id long, embedding array<double>, label int, x string, code string"


def plain(rows, rounds=6, entries=16):
    """rows: (vec_id, components, label), all of one length; in Python's whole numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * v) if abs(v) < 2**40 else int(v) * 4096 for v in x] for _, x, _ in rows]
    ends = hl.cuts(len(ints[0]))
    parts = [[x[ends[p] : ends[p + 1]] for x in ints] for p in range(8)]
    books = [own[:entries] for own in parts]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for x in own] for p, own in enumerate(parts)]
        if turn < rounds:
            for p, own in enumerate(parts):
                new = []
                for e, c in enumerate(books[p]):
                    mine = [x for x, k in zip(own, codes[p], strict=True) if k == e]
                    new.append([sum(v) // len(mine) for v in zip(*mine, strict=True)] if mine else c)
                books[p] = new
    errors = [sum(far(parts[p][i], books[p][codes[p][i]]) for p in range(8)) for i in range(len(rows))]
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return [(r[0], "".join(f"{codes[p][i]:02x}" for p in range(8)), min(errors[i], most), min(labels[r[2]], most), sha) for i, r in enumerate(rows)]


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, x, label, "x", "y") for i, x, label in rows], FIELDS).repartition(3)
    kept = [(i, x, label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    first = min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(first[1])]
    got = [tuple(r) for r in hl.compress(df, **how).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(kept)))


def vectors(seed, n, dim=16, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [(int(i), (centres[i % 7] + rng.normal(size=dim) * spread * 0.2).tolist(), int(i % 5) if i % 11 else None) for i in rng.permutation(n)]


def test_codes_of_clustered_vectors(spark):
    measures = []
    compare(spark, vectors(1, 700), chunk=100, measures=measures)
    assert measures[0] == (700 * 8, 700 * 8) and len(measures) == 7
    assert measures[-1][0] < measures[-1][1] * 0.6  # heaps leave parts alone that bounds decide


def test_hard_rows(spark):
    rows = vectors(2, 40, 9)
    rows += [(100, None, 1), (101, [], 1), (102, [1.0] * 8 + [float("nan")], 1), (103, [None] + [1.0] * 8, 1), (104, [1.0] * 7, 1), (105, [float("inf")] * 9, 1)]
    rows += [(None, [0.5] * 9, None), (3, [0.25] * 9, 7), (3, [0.25] * 9, 7), (2**53 + 1, [-0.5] * 9, 7), (2**53 + 2, [0.1] * 9, None)]
    compare(spark, rows, chunk=16)


def test_ties_repeated_rows_and_few_rows(spark):
    compare(spark, [(i, [float(i % 3)] * 8, i % 2) for i in range(60)], chunk=7)
    compare(spark, [(5, [1.0] * 8, 1)])
    compare(spark, [(i, [1.0, 0.0, 0.0, 0.0], 1) for i in range(3)])


def test_numbers_beyond_longs(spark):
    rows = vectors(3, 30, 8) + [(1000 + i, [3e38 * (-1) ** i, -1e30 * i, 2.0**60, 1e9 * i, 0.1, 8192.1, -8192.1, 1e300], i % 3) for i in range(9)]
    compare(spark, rows, chunk=8)


def test_an_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], FIELDS)
    assert hl.compress(df).count() == 0
    assert hl.compress(df).dtypes == queries.op13_heap_lloyd(spark, "/root/testdata/sf0.001").dtypes


def test_labels_are_joined_alike_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(hl, "MOST_LABELS", 2)
    compare(spark, vectors(4, 60, 8))


def test_codes_of_the_smallest_table(spark):
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.op13_heap_lloyd(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(plain(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 20), min_size=2, max_size=2), min_size=3, max_size=3), st.lists(st.lists(st.integers(-20, 20), min_size=2, max_size=2), min_size=3, max_size=3))
def test_drifts_bound_how_slacks_shrink(old, new):
    (bound,) = hl.drifts([old], [new])
    far = lambda a, b: math.dist(a, b)
    for point in ([0, 0], [7, -3], [-20, 20]):
        for a in range(3):
            slack = lambda book: min(far(point, book[b]) for b in range(3) if b != a) - far(point, book[a])  # noqa: B023, E731
            assert slack(new) >= slack(old) - bound[a] - 1e-9


@pytest.mark.parametrize("numbers", [[0, -1, 5], [10**45, -(10**45), 2**40], [-(2**120), 1, -7]])
def test_digits_hold_whole_numbers(numbers):
    limbs = hl.limbs_for(max(map(abs, numbers)) / 4096, 1)
    digits = []
    for v in numbers:
        for i in range(limbs):
            digits.append(v & ((1 << hl.LIMB) - 1) if i < limbs - 1 else v)
            assert abs(digits[-1]) <= 1 << hl.LIMB
            v >>= hl.LIMB
    assert hl.from_digits(digits, limbs) == numbers
