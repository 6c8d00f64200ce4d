"""Units of a text: sentences and numbered clauses, with their places, as marks that every later step reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import squash

#: Words that a full stop shortens and does not end a sentence.
SHORT = ("no", "nos", "dr", "mr", "mrs", "ms", "smt", "sri", "st", "rs", "vs", "viz", "etc", "govt", "dept", "approx", "sl", "art", "para", "sec", "fig", "dt")
#: What ends a unit whatever stands before: a heading that no sentence goes on to, a clause's number after a mark, a signature.
BOUNDS = (
    r"(^|[^a-z,;(] )((?:ANNEXURE|APPENDIX|SECTION|CHAPTER|SCHEDULE|PARA)[ -](?:[IVX]+|[0-9]+|[A-Z])\b)",
    r"(^|[.;:?!)] )([0-9]{1,2}\.[0-9]{1,2}(?:\.[0-9]{1,2})? [A-Z(])",
    r"(^| )(Sd ?/-)",
)
#: A mark that may end a sentence, with what closes behind it.
STOP = r"([.?!][)\]”\"’']{0,2})( |$)"
_WORD = r"([^\s(\[{“\"‘']*)[.?!][)\]”\"’']{0,2}\z"
_OPENS = r"^ ?(?:\z|[A-Z0-9(\[“\"‘'•–—-])"


def flat(text: Column) -> Column:
    """A text with single blanks, in which marks have a place of their own."""
    return F.translate(squash(F.coalesce(text, F.lit(""))), "\u0001\u0002", "  ")


def _marked(c: Column) -> Column:
    """A flat text with \\u0001 before each bound and \\u0002 after each mark that may end a sentence."""
    for bound in BOUNDS:
        c = F.regexp_replace(c, bound, "$1\u0001$2")
    return F.regexp_replace(c, STOP, "$1\u0002$2")


def ends_sentence(piece: Column, rest: Column) -> Column:
    """Whether the mark at the end of a piece ends a sentence: no shortened word, serial number or initial before it, and an opening after it."""
    word = F.lower(F.regexp_extract(piece, _WORD, 1))
    plain = (word != "") & ~word.isin(*SHORT) & ~F.contains(word, F.lit(".")) & ~word.rlike(r"^(?:[0-9]{1,3}|[a-z])\z")
    return piece.rlike(r"[?!][)\]”\"’']{0,2}\z") | (plain & F.coalesce(rest, F.lit("")).rlike(_OPENS))


def sentences_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, begin, end (from 0, exclusive), complete and sentence of each unit of flat texts.

    A unit is complete if it ends in a sentence's end; one that a bound or the end of the text cuts is not.  A text is
    cut once, and its pieces are numbered and summed as rows, so time grows with the text and not with its square.
    """
    pieces = F.regexp_extract_all(_marked(F.col(text)), F.lit("(?s)[^\u0001\u0002]*[\u0001\u0002]|[^\u0001\u0002]+"), F.lit(0))
    own = docs.select(F.col(doc_id), F.monotonically_increasing_id().alias("_d"), pieces.alias("_ps"))  # numbered before texts become rows
    rows = own.select(doc_id, "_d", F.posexplode("_ps").alias("_n", "_p"))
    along = Window.partitionBy("_d").orderBy("_n")
    bare = F.regexp_replace("_p", "[\u0001\u0002]\\z", "")
    rows = rows.select(doc_id, "_d", "_n", bare.alias("_t"), F.when(F.col("_p").endswith("\u0001"), 1).when(F.col("_p").endswith("\u0002"), 2).otherwise(0).alias("_cut"))
    rows = rows.withColumns({"_rest": F.lead("_t").over(along), "_end": F.sum(F.length("_t")).over(along.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_real", (F.col("_cut") == 2) & ends_sentence(F.col("_t"), F.col("_rest")))
    cuts = F.sum(F.when(F.col("_real") | (F.col("_cut") == 1), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    unit = rows.withColumn("_u", F.coalesce(cuts, F.lit(0))).groupBy(doc_id, "_d", "_u")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "")
    out = unit.agg(F.max("_end").alias("end"), F.max_by("_real", "_n").alias("complete"), told.alias("sentence")).where("trim(sentence) <> ''")
    return out.select(doc_id, (F.col("end") - F.length("sentence")).alias("begin"), "end", "complete", "sentence")
