"""Values read from passages of texts at cues: scored windows, the first that holds a value, the sentence that says it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import units as U

from . import joins as J

#: Characters that a window moves on, half of its width; passages of a field that are looked at.
STEP, BEST = 160, 25


@dataclass(frozen=True)
class Field:
    """What a field is found by: an anchor that must stand there, words for it and against it, and the form of its value."""

    name: str
    anchor: str
    support: str
    against: str
    value: str


def passages(t: Column) -> Column:
    """Overlapping windows of a text that cut no token (but tokens longer than a window): start, piece and where the piece begins."""

    def window(blocks: Column, i: Column) -> Column:
        before = F.concat(*[F.coalesce(F.get(blocks, i - k), F.lit("")) for k in (2, 1)])
        lead = F.regexp_extract(F.when(i > 0, before).otherwise(""), r"\S*\z", 0)
        tail = F.regexp_extract(T.joined(blocks, i + 2, 2), r"\A\S*", 0)
        return F.struct((i * STEP).alias("start"), F.concat(lead, T.joined(blocks, i, 2), tail).alias("piece"), (i * STEP - F.length(lead)).alias("begin"))

    each = lambda blocks: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(blocks) - 2)), lambda i: window(blocks, i))
    return T.in_blocks(t, STEP, each)


def best_passages(docs: DataFrame, fields: tuple[Field, ...], doc_id: str, text: str) -> DataFrame:
    """doc_id, field, place, start, score, piece, where it begins, and value (blank: none) of the BEST passages of each document and field.

    A passage scores 1, 0.6 more for each word of support and 1.2 less for each against, and not below 0; it must hold
    the anchor.
    """
    cut = docs.select(doc_id, F.explode(passages(F.col(text))).alias("w")).select(doc_id, "w.start", "w.begin", "w.piece")
    n = lambda pattern: F.regexp_count("piece", F.lit(pattern))
    each = [
        F.when(F.col("piece").rlike(f.anchor), F.struct(F.lit(f.name).alias("field"), F.greatest(F.lit(0.0), 1 + 0.6 * n(f.support) - 1.2 * n(f.against)).alias("score"), F.regexp_extract("piece", f.value, 0).alias("value")))
        for f in fields
    ]
    scored = cut.select(doc_id, "start", "begin", "piece", F.explode(F.array_compact(F.array(*each))).alias("x")).select(doc_id, "start", "begin", "piece", "x.*")
    w = Window.partitionBy(doc_id, "field").orderBy(F.desc("score"), "start")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= BEST)


def extract(docs: DataFrame, fields: tuple[Field, ...], doc_id: str, text: str) -> DataFrame:
    """doc_id, field, value, start, score, confidence and piece: of each field the first of the best passages that holds a value."""
    top = best_passages(docs, fields, doc_id, text)
    first = top.where("value != ''").groupBy(doc_id, "field").agg(F.min_by(F.struct("value", "start", "score", "piece"), "place").alias("x")).select(doc_id, "field", "x.*")
    return first.select(doc_id, "field", "value", "start", F.round("score", 2).alias("score"), F.round(F.least(F.lit(1.0), F.col("score") / 3), 4).alias("confidence"), "piece")


def narrowest(found: DataFrame, fields: tuple[Field, ...], doc_id: str) -> DataFrame:
    """found with the shortest sentence of its piece that says the same value (the piece where none does)."""
    same = F.lit(False)
    for f in fields:
        same = same | ((F.col("field") == f.name) & (F.regexp_extract("sentence", f.value, 0) == F.col("value")))
    told = found.select(doc_id, "field", "value", F.explode(T.sentences(F.col("piece"))).alias("sentence")).where(same)
    short = told.groupBy(doc_id, "field").agg(F.min(F.struct(F.length("sentence").alias("n"), "sentence"))["sentence"].alias("span"))
    return found.join(short, [doc_id, "field"], "left").withColumn("span", F.coalesce("span", T.squash(F.col("piece"))))


def extract_units(docs: DataFrame, fields: tuple[Field, ...], doc_id: str, text: str) -> DataFrame:
    """doc_id, field, value, at, span, score and confidence: values in the whole sentence that says them.

    The best passages of a field are taken in turn.  A passage's value is looked up in the sentence of the document in
    which it begins, read on to its own end there (a window may have cut it), and counts only if the sentence is complete
    and holds all of it; else the next passage is tried.  The span is the sentence as the flat text has it, so a quotation of
    it is verbatim.
    """
    whole = docs.select(F.col(doc_id), U.flat(F.col(text)).alias("_flat"))
    top = best_passages(whole, fields, doc_id, "_flat").where("value <> ''")
    top = top.select(doc_id, "field", "place", "score", "value", (F.col("begin") + F.position(F.col("value"), F.col("piece")) - 1).cast("long").alias("at"))
    units = U.sentences_of(whole, doc_id, "_flat").select(doc_id, F.col("begin").cast("long").alias("at"), F.struct("begin", "end", "complete", "sentence").alias("unit"))
    met = J.latest_before(top, units, [doc_id], "at", "unit")
    rest = F.substring(F.col("unit.sentence"), (F.col("at") - F.col("unit.begin") + 1).cast("int"), F.length("unit.sentence"))
    read = F.lit("")
    for f in fields:
        read = F.when(F.col("field") == f.name, F.regexp_extract(rest, rf"\A(?:{f.value})", 0)).otherwise(read)
    held = met.withColumn("whole", read).where(F.col("unit.complete") & (F.col("whole") != "") & F.startswith("whole", "value"))
    first = held.groupBy(doc_id, "field").agg(F.min_by(F.struct(F.col("whole").alias("value"), "at", F.col("unit.sentence").alias("span"), "score"), "place").alias("x"))
    return first.select(doc_id, "field", "x.value", "x.at", F.trim("x.span").alias("span"), F.round("x.score", 2).alias("score"), F.round(F.least(F.lit(1.0), F.col("x.score") / 3), 4).alias("confidence"))
