"""The pipeline's rows against its stages done plainly on the smallest table."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from factloom.llm import best_fit_packing, pii_crf, string_kernel_lang
from test_operators import HARD, SMALL, classes_of


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = {r["doc_id"]: r for r in string_kernel_lang.identify(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= string_kernel_lang.LEAST_SCORE]
    equal = defaultdict(list)
    for i, t in rows:
        equal[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
    rows = [min(own, key=lambda r: (-len(r[1] or ""), r[0])) for own in equal.values()]
    rows = [min(rows[i] for i in own) for own in classes_of(rows)]
    field, whole, want = pii_crf.train(pii_crf.training_table()), Tokenizer.from_file(best_fit_packing.tokenizer_path()), Counter()
    for i, t in rows:
        spans = sorted(pii_crf.all_spans(field, [t])[0][1], key=lambda s: (s[1], -s[2]))
        out, at = "", 0
        for kind, a, b in spans:
            if a >= at:
                out += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        ids = np.array([*whole.encode(out + t[at:], add_special_tokens=False).ids, 0], dtype="<u4")
        for nth, (a, n) in enumerate(best_fit_packing.cuts(len(ids))):
            want[i, nth, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert len(want) > 100


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, p string, _sha string, _rank long, kept boolean, digest string, uid long, row string"


def test_stages_on_hard_rows_and_clashing_names(spark):
    rows = [(i, t, lang, s, len(t or ""), "p", "sha", 3, False, "d", 9, "r") for i, t, lang, s in HARD]
    rows += rows[:4] + rows[-3:] + [(None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(6)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), FIELDS)
    left = docs.collect()
    assert 10 < len(left) < len(HARD)
    assert {(r["p"], r["_sha"], r["_rank"], r["kept"], r["digest"], r["uid"], r["row"]) for r in left} == {("p", "sha", 3, False, "d", 9, "r")}
    assert all(any(c.isalpha() for c in r["text"]) for r in left)
    assert len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in left}) == len(left)
    assert any("[EMAIL]" in r["text"] for r in left) and not any("a.b+c@d-e" in r["text"] for r in left)
    packed = corpus_pipeline.packing(spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in left}


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
