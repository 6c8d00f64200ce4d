"""Rules of eligibility with their scope: clauses name posts by codes and ranges, and what is told of a post wins over what is told of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import notices as N
from factloom.functions import text as T

_CODES = r"(?i)\bposts?\s+(?:codes?\s+)?(?:nos?\.?\s*)?((?:[0-9]{1,3}(?:\s*(?:to|-|–)\s*[0-9]{1,3})?)(?:\s*(?:,|&|and)\s*[0-9]{1,3}(?:\s*(?:to|-|–)\s*[0-9]{1,3})?)*)\b"
_RANGE = r"[0-9]{1,3}(?:\s*(?:to|-|–)\s*[0-9]{1,3})?"
#: A range over more posts is a misprint and names none.
WIDEST = 200


def codes_of(clause: Column) -> Column:
    """The codes of the posts that a clause names, ranges told out, ascending; empty where it names none."""
    parts = F.regexp_extract_all(F.regexp_extract(clause, _CODES, 1), F.lit(_RANGE), F.lit(0))

    def told(p: Column) -> Column:
        ends = F.regexp_extract_all(p, F.lit("[0-9]+"), F.lit(0))
        a, b = F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when((b >= a) & (b - a < WIDEST), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, told))))


def rules_of(notices: DataFrame, notice: str, text: str) -> DataFrame:
    """notice, place, codes, low, high, level and relaxations of each clause (a line) that states a rule."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    at = notices.select(F.col(notice), F.posexplode(lines).alias("place", "line"))
    age = N.age_band(F.col("line"))
    read = at.select(notice, "place", codes_of(F.col("line")).alias("codes"), age["low"].alias("low"), age["high"].alias("high"), T.level(F.col("line")).alias("level"), F.when(F.col("line").rlike("(?i)relax"), N.relaxations(F.col("line"))).alias("relaxations"))
    return read.where("low IS NOT NULL OR high IS NOT NULL OR level IS NOT NULL OR size(relaxations) > 0")


def in_force(posts: DataFrame, rules: DataFrame, notice: str, code: str) -> DataFrame:
    """posts (notice, code) with low, high, level, each with its scope (POST, GENERAL or null), and relaxations.

    Of the clauses that name a post the last that states a figure gives it; where none does, the last general one.
    A post is joined with the clauses that name its code, and with the general ones folded to one row a notice.
    """
    fields = ("low", "high", "level", "relaxations")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("place"))).alias(f) for f in fields]
    own = rules.where(F.size("codes") > 0).select(notice, F.explode("codes").alias("_code"), "place", *fields).groupBy(F.col(notice).alias("_notice"), "_code").agg(*last)
    every = rules.where(F.size("codes") == 0).groupBy(F.col(notice).alias("_general")).agg(*[c.alias(f"_{f}") for c, f in zip(last, fields, strict=True)])
    met = posts.join(own, (F.col(notice) == F.col("_notice")) & (F.col(code) == F.col("_code")), "left").join(every, F.col(notice) == F.col("_general"), "left")
    out = []
    for f in fields:
        out += [F.coalesce(f, f"_{f}").alias(f), F.when(F.col(f).isNotNull(), "POST").when(F.col(f"_{f}").isNotNull(), "GENERAL").alias(f"{f}_scope")]
    return met.select(*posts.columns, *out)
