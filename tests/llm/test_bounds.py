"""What corpus operators must keep whole, and what their work must not grow with."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import best_fit_packing, dart_minhash, exact_dedup, hilbert_shards, license_scan, pii_crf, sampled_pieces, string_kernel_lang, topk_nra, url_filter

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def ids(spark):
    rows = [(BIG, "mail a.b@c.de now", "en", "s", 1), (None, "no number here", "en", "s", 2), (3, "ring +49 30 1234567", "de", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.mark.parametrize(
    "run",
    [pii_crf.find_pii, pii_crf.redact, license_scan.license_scan, exact_dedup.exact_dedup, dart_minhash.near_dedup, sampled_pieces.pieces_query, hilbert_shards.shard, best_fit_packing.pack, string_kernel_lang.identify],
    ids=lambda f: f.__module__.rsplit(".", 1)[1] + "." + f.__name__,
)
def test_ids_beside_a_null_stay_whole(ids, run):
    assert {r["doc_id"] for r in run(ids).collect()} == {BIG, None, 3}


def test_license_scans_follow_the_length_of_a_text(spark):
    took = {}
    for n in (40_000, 40_000, 640_000):  # the first warms up
        text = " ".join(f"w{i}" for i in range(n)) + " mit license"
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
        began = time.perf_counter()
        (r,) = license_scan.license_scan(df).collect()
        took[n] = time.perf_counter() - began
        assert (r["n_words"], r["n_base"], r["first_word"], r["base_labels"]) == (n + 2, 1, n, "mit")
    assert took[640_000] < 12 * took[40_000]


def keys(spark, universe, listed):
    return spark.range(universe).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), (F.col("id") < listed).alias("block"))


def test_levels_of_a_cascade_follow_the_list_and_not_the_corpus(spark):
    listed = 500
    small, large = (url_filter.build_cascade(keys(spark, n, listed), "block") for n in (5_000, 400_000))
    assert max(len(x) for x in large.levels[1:]) * 64 <= 2 * listed * url_filter.BITS_PER_KEY
    assert large.nbytes < 3 * small.nbytes
    table = keys(spark, 400_000, listed).toPandas()
    assert (large.listed(table[["h1", "h2"]].to_numpy().view(np.uint64)) == table["block"].to_numpy()).all()


def test_no_level_is_longer_than_it_may_be(spark):
    with pytest.raises(url_filter.TooLong):
        url_filter.build_cascade(keys(spark, 3_000, 1_000), "block", max_bytes=1_000)
    hosts = [f"h{i}.example" for i in range(300)]
    rules = spark.createDataFrame([(h + "/", "block") for h in hosts[::2]], "key string, verdict string")
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages, rules, max_bytes=80).collect()}
    assert got == {i: "block" if i % 2 == 0 else "allow" for i in range(300)}


def test_bounds_of_a_search_cost_a_small_multiple_of_its_products():
    r = np.random.default_rng(0)
    anywhere = r.normal(size=(4096, 64))
    close = r.normal(size=(40, 64))[r.integers(0, 40, 4096)] + r.normal(size=(4096, 64)) * 0.05
    share, ids = {}, np.arange(4096)
    for name, x in (("anywhere", anywhere), ("close", close)):
        x, q = topk_nra.quantised(x), topk_nra.quantised(x[:80])
        began = time.perf_counter()
        best, entries, every = topk_nra.search_block(ids, x, ids[:80], q)
        took = time.perf_counter() - began
        scores = q @ x.T
        scores[np.arange(80), np.arange(80)] = -np.inf
        assert best == [sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5] for s in scores]
        share[name] = entries / every
        assert took < 0.6
    assert share["anywhere"] <= 1.0 and share["close"] < 0.4


def test_rows_have_the_links_of_their_texts(spark):
    words = [f"w{i}" for i in range(100)]
    one, two, far = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"z{i}" for i in range(60))
    df = spark.createDataFrame([(1, one), (2, two), (3, one), (4, far), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in dart_minhash.near_dedup(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (5, 0)}


def test_a_search_for_packings_goes_on_while_it_saves_bins():
    r = random.Random(4)
    sizes = [r.randrange(300, 1400) for _ in range(600)]
    did = best_fit_packing.Search()
    best_fit_packing.evolve(sizes, 2048, 1, [], did=did)
    assert did.crossovers + did.mutations >= best_fit_packing.OFFSPRING >= 12
