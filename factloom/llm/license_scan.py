r"""Operator 3, license scans by diagonal voting, in DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.  The hash of every rolling word
bigram of every document is joined to the bigram positions of the templates (a fixed table of a few thousand rows, so
it is broadcast).  A meeting with a base phrase is confirmed on its two words, one with a notice or licence on the GRAM
words that stand there, so words that any text has beside each other do not count.  A meeting votes for the diagonal
``position in document - position in template``.  A diagonal that has every vote of its template is a verbatim span:
that is how base phrases are found, all places of them.

For notices and whole licences, diagonals of one template that lie within MERGE words of each other are neighbours
(words were put in or left out).  A chain of neighbours is cut into tiles of DRIFT diagonals, twice, the second time
half a tile on, so a copy whose words moved by up to half of DRIFT lies in one tile, and no tile lets words drift
further.  The votes of a tile are one span: at most the template and DRIFT words long, in the template's order but for
DRIFT words.  It is verified by the share of the template's places that it holds, each counted once: LEAST_SHARE or
more, and all of them where a template has no more than SHORT.  Spans that overlap are readings of one place, by whatever
template: those with the greatest share stay.

Votes are aggregated by (document, template, diagonal), so a phrase that all documents hold makes no hot group.

Cases: null or empty texts and texts without words have n_words 0 and empty labels; overlapping places all count;
repeated rows are judged row by row; other columns of any name are ignored; an empty table gives none.  A text of any
length is read whole, in time that grows in proportion.  All steps are joins and aggregations over written votes, so a
lost executor costs recomputed tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .license_texts import LICENSES
from .shared import materialize, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that the contract fixes.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that confirm a meeting with a notice or licence.
GRAM = 3
MERGE = 3
DRIFT = 24
LEAST_SHARE = 0.6
SHORT = 12


#: Every document also meets this mark once, which carries its number of words: one pass over the texts does all.
SELF = -1


def templates(spark: SparkSession, base: dict[str, str] = BASE, notices: tuple[tuple[str, str], ...] = LICENSES) -> DataFrame:
    """A row for each place of each template (the words that stand there, null beyond a base phrase's two), and the mark that every document meets."""
    rows = [(SELF, None, False, 0, 0, None, None, None)]
    every = [(p, n, True, 2) for p, n in base.items()] + [(p, n, False, GRAM) for n, p in notices]
    for number, (phrase, label, fixed, gram) in enumerate(every):
        words = phrase.lower().split()
        for at in range(len(words) - gram + 1):
            rows.append((number, label, fixed, len(words) - gram + 1, at, words[at], words[at + 1], None if fixed else words[at + 2]))
    marks = spark.createDataFrame(rows, "template int, label string, fixed boolean, places int, t_pos int, w1 string, w2 string, w3 string")
    return marks.withColumn("t_hash", F.when(F.col("template") == SELF, F.lit(SELF).cast("long")).otherwise(F.xxhash64("w1", "w2")))


def votes(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Of rows with uid, doc_id and words: a row for each (uid, template, diagonal) with its votes' template positions and places."""
    word = lambda i: F.get("words", i)
    gram = lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, word(i + 1)).alias("gram"), w.alias("d1"), word(i + 1).alias("d2"), word(i + 2).alias("d3"))
    none = F.lit(None).cast("string")
    mark = F.struct(F.size("words").alias("pos"), F.lit(SELF).cast("long").alias("gram"), none.alias("d1"), none.alias("d2"), none.alias("d3"))
    # each row carries its own three words and no more, so the rows of a text are as long as the text, thrice
    at = rows.select("uid", "doc_id", F.explode(F.concat(F.transform("words", gram), F.array(mark))).alias("at")).select("uid", "doc_id", "at.*")
    same = (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2")) & (F.col("w3").isNull() | (F.col("d3") == F.col("w3")))
    met = at.join(F.broadcast(marks), (F.col("gram") == F.col("t_hash")) & (same | (F.col("template") == SELF)))
    return met.groupBy("uid", "template", "label", "fixed", "places", (F.col("pos") - F.col("t_pos")).cast("long").alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"),
        F.collect_set("t_pos").alias("t_set"),
        F.min("pos").cast("long").alias("first_pos"),
        F.max("pos").cast("long").alias("last_pos"),
    )


def merged(diagonals: DataFrame) -> DataFrame:
    """Verified spans of notices and licences: neighbouring diagonals of one document and template joined in tiles."""
    w = Window.partitionBy("uid", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > MERGE, F.lit(True))
    chains = diagonals.withColumn("chain", F.sum(new.cast("long")).over(w))
    first = F.min("diagonal").over(Window.partitionBy("uid", "template", "chain"))
    tiles = chains.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(DRIFT // 2)))).withColumn("tile", F.floor((F.col("diagonal") - first + F.col("shift")) / DRIFT))
    spans = tiles.groupBy("uid", "template", "label", "places", "chain", "shift", "tile").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("t_set")))).alias("held"), F.min("first_pos").alias("span_first"), (F.max("last_pos") + GRAM - 1).alias("span_last")
    )
    least = F.when(F.col("places") <= SHORT, 1.0).otherwise(LEAST_SHARE)
    good = spans.withColumn("share", F.col("held") / F.col("places")).where(F.col("share") >= least).select("uid", "label", "span_first", "span_last", "share").distinct()
    along = Window.partitionBy("uid").orderBy("span_first", "span_last", "label", "share")
    ended = F.max("span_last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    placed = good.withColumn("place", F.sum(F.coalesce(F.col("span_first") > ended, F.lit(True)).cast("long")).over(along))
    most = F.max("share").over(Window.partitionBy("uid", "place"))
    return placed.withColumn("most", most).where(F.col("share") == F.col("most")).select("uid", "label", "span_first", "span_last", "share")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of the method's own."""
    lowered = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")
    )
    held = materialize(votes(rows, templates(docs.sparkSession)), "votes")
    every = held.where(F.col("template") == SELF).select("uid", "doc_id", F.col("diagonal").alias("n_words"))
    met = held.where(F.col("template") != SELF)
    base = met.where("fixed").where(F.size("t_set") == F.col("places")).groupBy("uid").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("fixed_labels")
    )
    own = merged(met.where("not fixed")).groupBy("uid").agg(
        F.collect_set("label").alias("own_labels"),
        F.max("share").alias("share"),
        F.sort_array(F.collect_list(F.struct("span_first", "span_last", "label", "share"))).alias("spans"),
    )
    found = base.join(own, "uid", "full")
    none = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("fixed_labels", none), F.coalesce("own_labels", none))
    return (
        every.join(found, "uid", "left").select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.concat_ws(",", F.sort_array(F.coalesce("fixed_labels", none))).alias("base_labels"),
            F.concat_ws(",", F.sort_array(both)).alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
            F.transform(F.coalesce("spans", F.array().cast("array<struct<span_first:bigint,span_last:bigint,label:string,share:double>>")),
                        lambda s: F.concat_ws(":", s["label"], s["span_first"].cast("string"), s["span_last"].cast("string"))).alias("spans"),
        )
    )
