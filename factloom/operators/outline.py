"""Trees printed as lines: clauses by their numbers, headings over lists, or indented lines, to any depth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from factloom.functions.text import number_of, once, squash

from .stored import stored

#: Words that a heading names its level by, the highest level first.
LEVELS = (("stage", "phase", "tier"), ("paper", "subject"), ("part", "section", "unit", "module"))
_LABELLED = "(?i)^(" + "|".join(w for words in LEVELS for w in words) + r")[ -]+([0-9]{1,2}|[ivx]{1,5}|[a-h])\b[ :.–-]*"
_CLAUSE = r"^([0-9]{1,3}(?:\.[0-9]{1,3})+)\.?\s+"
_ROMAN, _ITEM, _BULLET = r"^[IVX]{1,5}[.)]\s+", r"^[0-9]{1,3}[.)]\s+", r"^[-*•]\s+"
#: A structure needs so many lines.
LEAST = 2


def _squashed(line: Column) -> Column:
    """squash(line); a line of printed ASCII with single blanks inside is as it should be."""
    return F.when(line.rlike(r"[^ -~]|  |^ | \z"), squash(line)).otherwise(line)


def _clause(line: Column) -> Column:
    """Level and title by the parts of a clause's number; null for another line."""
    read = lambda number: F.when(number != "", F.struct((F.regexp_count(number, F.lit(r"\.")) + 1).alias("level"), F.regexp_replace(line, _CLAUSE, "").alias("title")))
    return once(F.regexp_extract(line, _CLAUSE, 1), read)


def _heading(line: Column) -> Column:
    """Level and title by what a line is: a labelled level, a title before a list (it ends in a colon), a Roman heading, an item, a bullet."""

    def level_of(label: Column) -> Column:
        return F.when(label.isin(*LEVELS[0]), 1).when(label.isin(*LEVELS[1]), 2).when(label.isin(*LEVELS[2]), 3).when(line.endswith(":"), 4).when(line.rlike(_ROMAN), 5).when(line.rlike(_ITEM), 6).when(line.rlike(_BULLET), 7)

    def read(level: Column) -> Column:
        bare = F.when(level > 4, F.regexp_replace(line, f"{_ROMAN}|{_ITEM}|{_BULLET}", "")).otherwise(F.when(line.endswith(":"), F.regexp_replace(line, r"\s*:$", "")).otherwise(line))
        return F.when(level.isNotNull(), F.struct(level.alias("level"), bare.alias("title")))

    return once(once(F.lower(F.regexp_extract(line, _LABELLED, 1)), level_of), read)


def _indented(line: Column, raw: Column) -> Column:
    """Level and title by the blanks before a line."""
    blanks = F.length(F.regexp_extract(F.regexp_replace(raw, "\t", "    "), "^ *", 0))
    return F.struct((blanks + 1).alias("level"), F.regexp_replace(line, f"{_ITEM}|{_BULLET}", "").alias("title"))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _ways_up(levels: pd.Series) -> pd.Series:
    """For each line the lines above it in the tree, the nearest first: of the lines before it the last one of a smaller level, and so on."""

    def ways(own) -> list[list[int]]:
        stack: list[int] = []
        out = []
        for i, level in enumerate(own):
            while stack and own[stack[-1]] >= level:
                stack.pop()
            out.append(stack[::-1])
            stack.append(i)
        return out

    return levels.map(lambda own: None if own is None else ways(own))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, structure, n (from 1), level, title, depth, parent (its n), up (titles above it, the root first) and raw of each entry of a document's outline.

    Three structures are read and the one with the most entries holds (CLAUSES, then HEADINGS, then INDENTED where they
    are equal); INDENTED takes every line, so it holds only where lines are indented and others find fewer than half.
    A document without LEAST entries of any has no outline.
    """
    raw = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    forms = {"c": lambda line, x: _clause(line), "h": lambda line, x: _heading(line), "i": _indented}
    each = F.transform(raw, lambda x: once(_squashed(x), lambda line: F.struct(*[form(line, x).alias(f) for f, form in forms.items()], x.alias("raw"))))

    def entries(lines: Column, f: str) -> Column:
        held = F.filter(lines, lambda y: y[f].isNotNull() & (y[f]["title"] != ""))
        return F.transform(held, lambda y: F.struct(y[f]["level"].alias("level"), y[f]["title"].alias("title"), y["raw"].alias("raw")))

    def chosen(read: Column) -> Column:
        n = {f: F.size(read[f]) for f in forms}
        levels = F.transform(read["i"], lambda x: x["level"])
        by_blanks = (F.greatest(n["c"], n["h"]) * 2 < n["i"]) & (n["i"] >= LEAST) & (F.array_max(levels) > F.array_min(levels))
        held = lambda name, f: F.struct(F.lit(name).alias("structure"), read[f].alias("lines"))
        return F.when(by_blanks, held("INDENTED", "i")).when((n["c"] >= n["h"]) & (n["c"] >= LEAST), held("CLAUSES", "c")).when(n["h"] >= LEAST, held("HEADINGS", "h"))

    best = once(once(each, lambda lines: F.struct(*[entries(lines, f).alias(f) for f in forms])), chosen)
    placed = docs.select(F.col(doc_id), best.alias("_best")).select(doc_id, "_best.structure", "_best.lines", _ways_up(F.transform("_best.lines", lambda x: x["level"])).alias("ways"))
    titles = lambda way: F.transform(F.reverse(way), lambda k: F.get("lines", k)["title"])
    entry = lambda x, k: F.struct((k + 1).alias("n"), x["level"].alias("level"), x["title"].alias("title"), F.size(F.get("ways", k)).alias("depth"), (F.get(F.get("ways", k), F.lit(0)) + 1).alias("parent"), titles(F.get("ways", k)).alias("up"), x["raw"].alias("raw"))
    return placed.select(doc_id, "structure", F.explode(F.transform("lines", entry)).alias("x")).select(doc_id, "structure", "x.*")


def inherited(tree: DataFrame, doc_id: str, rule: str) -> DataFrame:
    """tree (doc_id, n, parent and a rule, null where a node states none) with the rule in force at each node and the node that states it.

    in_force and stated_at: the nearest node above that states a rule gives it.  A level is one join with the nodes that the
    level before has decided, and is stored.
    """
    at = tree.select(doc_id, "n", "parent", rule)
    own = at.where(F.col(rule).isNotNull() | F.col("parent").isNull())
    decided = stored(own.select(doc_id, "n", F.col(rule).alias("in_force"), F.when(F.col(rule).isNotNull(), F.col("n")).alias("stated_at")), "decided")
    asking = stored(at.where(F.col(rule).isNull() & F.col("parent").isNotNull()).select(doc_id, "n", F.col("parent").alias("_at")), "asking")
    out = decided
    while asking.limit(1).count():
        above = decided.select(F.col(doc_id), F.col("n").alias("_at"), "in_force", "stated_at")
        decided = stored(asking.join(above, [doc_id, "_at"]).select(doc_id, "n", "in_force", "stated_at"), "decided")
        asking = stored(asking.join(decided.select(doc_id, "n"), [doc_id, "n"], "left_anti"), "asking")
        out = out.unionByName(decided)
    return tree.join(out, [doc_id, "n"], "left")


def key_of(title: Column) -> Column:
    """The labelled level of a heading, alike however it is printed: ``PAPER - II`` and ``Paper 2: History`` are ``paper 2``."""
    number = once(F.regexp_extract(title, _LABELLED, 2), lambda told: F.coalesce(number_of(told).cast("string"), F.lower(told)))
    return F.trim(F.concat_ws(" ", F.lower(F.regexp_extract(title, _LABELLED, 1)), number))


def restated(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key, whose entries may be stated again: a field's one value, null where entries differ; held tells that some do."""
    both = [x for f in fields for x in (F.min(f).alias(f), F.max(f).alias(f"_{f}"))]
    one = rows.groupBy(*keys).agg(F.count("*").alias("stated"), *both)
    differs = F.lit(False)
    for f in fields:
        differs = differs | F.coalesce(F.col(f) != F.col(f"_{f}"), F.lit(False))
    return one.select(*keys, "stated", *[F.when(F.col(f) == F.col(f"_{f}"), F.col(f)).alias(f) for f in fields], differs.alias("held"))
