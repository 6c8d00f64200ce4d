"""Joins that need more than an equality: wildcards, nearest earlier row, names that agree, passages in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

from .stored import stored


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last row of right with the same keys not after it (null: none).

    Both sides meet in one sort instead of a range join, so no pairs arise.  At one instant right stands first.
    """
    side = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_left", F.lit(True))
    other = right.select(*keys, at, F.col(value).alias("_value")).withColumn("_left", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = side.unionByName(other, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_left").drop("_left", "_value")


def wildcard_counts(left: DataFrame, right: DataFrame, key: str, tag: str) -> DataFrame:
    """right with how many rows of left have its key and its tag, where a blank tag on either side fits any.

    left is aggregated first, so the join meets one row for each tag instead of every pair.
    """
    tally = left.groupBy(F.col(key).alias("_key"), F.lower(tag).alias("_tag")).agg(F.count("*").alias("n"))
    own = F.lower(tag)
    fits = (F.col(key) == F.col("_key")) & ((F.col("_tag") == "") | (own == "") | (own == F.col("_tag")))
    return right.join(tally, fits, "left").groupBy(*right.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def best_names(left: DataFrame, right: DataFrame, name: str, least: float = 0.85) -> DataFrame:
    """For each distinct name of left: the best name of right, its score and the verdict.

    UNCHANGED: none reaches least (the score is 0); CONFLICTED: several do; else MATCHED.  Only two kinds of pairs can
    reach it: names of the same words, and names of which one holds all words of the other, two or more.  The former
    meet by their words, the latter by the two rarest words of the shorter name; so a word that most names have makes no pairs.
    """
    if least <= 0.5:
        raise ValueError("pairs that share one word or a part of their words are not looked for")
    words = lambda df, out: df.select(F.col(name).alias(out)).distinct().withColumn(f"{out}_words", T.words(F.col(out)))
    a, b = stored(words(left, "a"), "names"), stored(words(right, "b"), "names")
    each = a.select(F.explode("a_words").alias("w")).unionByName(b.select(F.explode("b_words").alias("w")))
    often = stored(each.groupBy("w").agg(F.count("*").alias("df")), "words")

    def rarest(df: DataFrame, out: str) -> DataFrame:
        ranked = df.select(out, F.explode(f"{out}_words").alias("w")).join(often, "w")
        two = ranked.groupBy(out).agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), 1, 2).alias("two"))  # a name's words
        return two.where(F.size("two") == 2).select(out, F.array_join(F.array_sort(F.transform("two", lambda x: x["w"])), " ").alias("pair"))

    def pairs(df: DataFrame, out: str) -> DataFrame:
        own = F.array_sort(F.col(f"{out}_words"))
        every = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.concat(x, F.lit(" "), y))))
        return df.select(out, F.explode(every).alias("pair"))

    set_of = lambda c: F.array_join(F.array_sort(F.col(f"{c}_words")), " ")
    equal = a.where(F.size("a_words") > 0).withColumn("w", set_of("a")).join(b.withColumn("w", set_of("b")), "w").select("a", "b")
    met = equal.unionByName(rarest(a, "a").join(pairs(b, "b"), "pair").select("a", "b")).unionByName(rarest(b, "b").join(pairs(a, "a"), "pair").select("a", "b")).distinct()
    scored = met.join(a, "a").join(b, "b").withColumn("score", T.name_score(F.col("a_words"), F.col("b_words"))).where(F.col("score") >= least)
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("best"), F.count("*").alias("good"))
    verdict = F.when(F.coalesce("good", F.lit(0)) == 0, "UNCHANGED").when(F.col("good") > 1, "CONFLICTED").otherwise("MATCHED")
    return a.select("a").join(best, "a", "left").select(
        F.col("a").alias("name"), F.when(F.col("good") == 1, F.col("best.b")).alias("match"), F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("score"), verdict.alias("verdict")
    )


def verbatim(docs: DataFrame, passages: DataFrame, doc_id: str, passage_id: str, words: int = 4) -> DataFrame:
    """Pairs of a document and a passage (both: text) that it holds word for word, spacing apart.

    The hash of a passage's first words is joined with the rolling hashes of the documents; only passages of fewer
    words are looked for by their first word.  Hashes travel with ids alone: texts are joined to the pairs that meet,
    to be verified there.
    """
    split = lambda c: F.split(T.squash(c), " ")
    blank = F.lit(" ")
    p = passages.select(passage_id, F.concat(blank, T.squash(F.col("text")), blank).alias("passage"), split(F.col("text")).alias("_w")).where("passage != '  '")
    short = F.size("_w") < words
    first = F.when(short, F.get("_w", F.lit(0))).otherwise(F.array_join(F.slice("_w", 1, words), " "))
    p = p.select(passage_id, "passage", F.xxhash64(short, first).alias("_anchor"))
    d = docs.select(doc_id, split(F.col("text")).alias("_d"))
    run = lambda n, few: F.transform("_d", lambda _, i: F.xxhash64(F.lit(few), F.array_join(F.slice("_d", i + 1, F.lit(n)), " ")))
    anchors = F.array_distinct(run(words, False))
    if passages.where(F.size(split(F.col("text"))) < words).limit(1).count():
        anchors = F.array_union(anchors, run(1, True))
    met = d.select(doc_id, F.explode(anchors).alias("_anchor")).join(p.select(passage_id, "_anchor"), "_anchor").select(doc_id, passage_id).distinct()
    texts = docs.select(doc_id, F.concat(blank, T.squash(F.col("text")), blank).alias("squashed"))
    return met.join(p.select(passage_id, "passage"), passage_id).join(texts, doc_id).where(F.contains("squashed", "passage")).select(doc_id, passage_id).distinct()


def label_then_code(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (label, code) with tier and found, an id of known (id, label, code).

    An equal label decides (tier LABEL, the smallest id); else a code that one row alone has (CODE); a code of several
    is AMBIGUOUS and finds none.  known is reduced to a row for each label and each code before it is joined.
    """
    by_label = known.groupBy("label").agg(F.min("id").alias("_by_label"))
    by_code = known.groupBy("code").agg(F.min("id").alias("_by_code"), F.count("*").alias("_n"))
    tier = F.when(F.col("_by_label").isNotNull(), "LABEL").when(F.col("_n") == 1, "CODE").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("NONE")
    found = F.when(tier == "LABEL", F.col("_by_label")).when(tier == "CODE", F.col("_by_code"))
    met = asked.join(by_label, "label", "left").join(by_code, "code", "left")
    return met.select(*asked.columns, tier.alias("tier"), found.alias("found"))


def most_specific(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (category, post) with the rule that fits best: of its own post, else of no post (blank), else its category's first."""
    own = rules.where("post != ''").groupBy("category", "post").agg(F.min("rule").alias("_own"))
    rest = rules.groupBy("category").agg(F.min(F.when(F.col("post") == "", F.col("rule"))).alias("_general"), F.min("rule").alias("_first"))
    met = asked.join(own, ["category", "post"], "left").join(rest, "category", "left")
    return met.select(*asked.columns, F.coalesce("_own", "_general", "_first").alias("rule"))


def containing(items: DataFrame, queries: DataFrame, item: str, wanted: str, width: int = 3) -> DataFrame:
    """Pairs of an item and a query text that it contains, without meeting every pair.

    A query is looked for at its first letters (up to width) among the runs of letters that an item has, and what
    meets is verified.  Blank queries find nothing.
    """
    q = queries.select(wanted).where(F.length(wanted) > 0).distinct().withColumn("_gram", F.substring(wanted, 1, width))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(item) - n + 1)), lambda i: F.substring(item, i, F.lit(n)))
    grams = F.array_distinct(F.flatten(F.array(*[runs(n) for n in range(1, width + 1)])))
    met = items.select(item).distinct().withColumn("_gram", F.explode(grams)).join(q, "_gram")
    return met.where(F.contains(item, wanted)).select(item, wanted)
