"""What the corpus operators must not leave out or let in, on rows made by hand beside the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import string_kernel_lang, topk_nra


def test_language_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    words = F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 3, 2))
    short = docs.where("doc_id < 200 AND size(split(text, ' ')) > 30").select((F.col("doc_id") + 3_000_000).alias("doc_id"), words.alias("text"), F.lit(None).cast("string").alias("lang"))
    foreign = ["Быстрая лиса прыгает через ленивую собаку и бежит дальше", "今天天气很好我们去公园玩", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", "xqzv kjwq pfhg zzqx", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q"]
    planted = spark.createDataFrame([(2_000_000 + i, t, None) for i, t in enumerate(foreign)], docs.schema)
    for known in (["en"], ["en", "es"], ["de", "en", "es", "fr"]):
        own = docs.where(F.col("lang").isin(known))
        near = short.join(own.select((F.col("doc_id") + 3_000_000).alias("doc_id")), "doc_id")
        other = docs.where(~F.col("lang").isin(known)).withColumn("lang", F.lit(None).cast("string"))
        kept = {r[0] for r in string_kernel_lang.keep_known(own.union(near).union(other).union(planted)).select("doc_id").collect()}
        ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
        assert not ids(planted) & kept
        assert len(ids(own) & kept) >= 0.98 * own.count()
        assert len(ids(near) & kept) >= 0.98 * near.count()
        if len(known) < 4:
            assert len(ids(other) & kept) <= 0.05 * other.count()
    unlabelled = planted.union(spark.createDataFrame([(1, "12 34", None)], docs.schema))
    assert string_kernel_lang.keep_known(unlabelled).count() == len(foreign)


def test_each_query_row_has_its_own_neighbours(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (None, [9.0, 0.5]), *[(i, [float(i), 8.0 - i]) for i in range(1, 9)]]
    got = topk_nra.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=3).collect()
    by = sorted((r["query_id"], r["rank"], -1 if r["vec_id"] is None else r["vec_id"]) for r in got)
    want = [(50, rank, i) for own in ([-1, 8, 7, 6, 5], [-1, 8, 7, 6, 5], [1, 2, 3, 4, 5]) for rank, i in enumerate(own, 1)]
    assert by == sorted(want)
