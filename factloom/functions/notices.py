"""What a notice states, as columns: dates, amounts, ages, counts, revisions, clauses.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.dates import DATE, MONTH, dates, iso
from factloom.functions.text import squash

__all__ = ["DATE", "dates"]

AMOUNT = r"(?i)(?:\brs\.?|₹|\binr)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def amounts(text: Column) -> Column:
    """All amounts of money of a text, in order, as numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def exempt(text: Column) -> Column:
    """Whether a text frees somebody of a fee."""
    return text.rlike(r"(?i)\bno\s+(?:application\s+)?fee\b|\bexempt(?:ed|ion)?\b|\bfee\s*:?\s*nil\b")


def age_band(text: Column) -> Column:
    """The least and the greatest age that a text states, null where it states none."""
    low = F.lower(text)
    part = lambda pattern, n: F.regexp_extract(low, pattern, n).try_cast("int")
    between, over, under = r"\b([0-9]{2})\s*(?:to|-|and)\s*([0-9]{2})\s*years", r"(?:minimum age|not less than|at least)\D{0,12}([0-9]{2})\b", r"(?:maximum age|not exceed\w*|below|up ?to)\D{0,12}([0-9]{2})\b"
    return F.struct(F.coalesce(part(between, 1), part(over, 1)).alias("low"), F.coalesce(part(between, 2), part(under, 1)).alias("high"))


def bound_count(text: Column, nouns: str) -> Column:
    """The figure that stands with a noun: before it, or after it and a colon or ``is``; null if none does."""
    low = F.lower(text)
    before, after = rf"\b([0-9][0-9,]*)\s+(?:[a-z]+\s+)?(?:{nouns})\b", rf"\b(?:{nouns})\s*(?::|is|are|-)\s*([0-9][0-9,]*)\b"
    return F.replace(F.coalesce(F.nullif(F.regexp_extract(low, after, 1), F.lit("")), F.nullif(F.regexp_extract(low, before, 1), F.lit(""))), F.lit(","), F.lit("")).try_cast("int")


def ordinals(text: Column) -> Column:
    """Compounds such as ``group i`` or ``paper 2``, in lower case and order, each once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b((?:group|paper|tier|stage|part)[ -](?:[ivx]{1,4}|[0-9]{1,2}))\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("-"), F.lit(" "))))


def revision(text: Column) -> Column:
    """What a statement changes: kind, old and new value; the kind is null where it changes nothing."""
    low = F.lower(text)
    moved = rf"(?:extended|postponed|revised|rescheduled)\s+from\s+({DATE})\s+to\s+({DATE})"
    count = r"(?:vacanc\w+|posts)[^.]*?(?:revised|increased|reduced)\s+from\s+([0-9,]+)\s+to\s+([0-9,]+)"
    part = lambda pattern, n: F.regexp_extract(low, pattern, n)
    kind = F.when(low.rlike(moved), F.when(low.rlike(r"\b(?:exam|tier|prelim|written|conduct)"), "EXAM_DATE").otherwise("LAST_DATE")).when(low.rlike(count), "VACANCIES")
    old, new = (F.when(kind == "VACANCIES", F.replace(part(count, n), F.lit(","), F.lit(""))).when(kind.isNotNull(), iso(part(moved, n))) for n in (1, 2))
    return F.struct(kind.alias("kind"), old.alias("old"), new.alias("new"))


def complete(text: Column) -> Column:
    """Whether a unit of text is whole: false where it breaks off at a joining word, a comma or within brackets; null where nothing tells."""
    t = F.trim(text)
    opened = F.regexp_count(t, F.lit(r"[(\[]")) - F.regexp_count(t, F.lit(r"[)\]]"))
    cut = t.rlike(r"(?i)(?:,|;|:|\b(?:and|or|of|the|for|to|in|with|by))\z") | (opened > 0)
    return F.when((t == "") | cut, False).when(t.rlike(r"[.!?]['\")\]]*\z"), True)


def clauses(text: Column) -> Column:
    """Numbered clauses of a text, spacing apart, without their numbers."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\(?[0-9]{1,2}[.)]\s+([^\n]+)$"), F.lit(1))
    return F.transform(found, lambda c: squash(c))


#: Words that tell what a date is of; the one that ends last before a date is the date's own.
EVENTS = (("last date|closing date|apply by", "APPLICATION_END"), ("opens?|start(?:s|ing)? from", "APPLICATION_START"), ("exam(?:ination)? (?:is )?held on|exam on", "EXAM"), ("result", "RESULT"))


def milestones(text: Column) -> Column:
    """(kind, date) of every date of a text, by the nearest cue before it in its own clause; dates without one are left out."""
    clause = F.split(F.lower(text), r"[;\n]|\.\s")

    def kind(before: Column) -> Column:
        ends = F.array(*[F.struct(F.length(F.regexp_extract(before, rf"(?s)\A.*(?:{pattern})", 0)).alias("at"), F.lit(name).alias("kind")) for pattern, name in EVENTS])
        return F.array_max(F.filter(ends, lambda e: e["at"] > 0))["kind"]

    def read(c: Column) -> Column:
        pieces = F.split(c, DATE)
        return F.transform(F.regexp_extract_all(c, F.lit(DATE), F.lit(0)), lambda d, i: F.struct(kind(F.array_join(F.slice(pieces, F.lit(1), i + 1), " ")).alias("kind"), iso(d).alias("date")))

    return F.filter(F.flatten(F.transform(clause, read)), lambda m: m["kind"].isNotNull())


def relaxations(text: Column) -> Column:
    """(category, years) of every relaxation of age that a text states, in order; a list such as ``SC/ST`` is one for each."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{2,6}(?:/[a-z]{2,6})*)\s*:?\s*(?:by )?([0-9]{1,2}) years\b"), F.lit(0))
    part = lambda f, n: F.regexp_extract(f, r"^([a-z/]+)\s*:?\s*(?:by )?([0-9]{1,2})", n)
    each = F.transform(found, lambda f: F.transform(F.split(part(f, 1), "/"), lambda c: F.struct(F.upper(c).alias("category"), part(f, 2).cast("int").alias("years"))))
    return F.flatten(each)


def fee_rules(text: Column) -> Column:
    """(group, amount, exempt) of every fee that a text states for a group."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:rs\.?\s*[0-9][0-9,]*|no fee) for [A-Za-z/]+"), F.lit(0))
    return F.transform(found, lambda f: F.struct(
        F.upper(F.regexp_extract(f, r"(?i) for ([A-Za-z/]+)", 1)).alias("group"), F.get(amounts(f), F.lit(0)).cast("long").alias("amount"), f.rlike("(?i)^no fee").alias("exempt"),
    ))


def papers(text: Column) -> Column:
    """(paper, questions, marks, minutes, penalty) of every paper of a scheme; a rule of the stage holds for papers without one."""
    line = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"(?i)^\s*paper\b"))
    rule = F.regexp_extract(text, r"(?is)all papers[^.]*?negative[^.]*?([0-9]+)\s*/\s*([0-9]+)", 0)
    share = lambda c: F.round(F.regexp_extract(c, r"(?i)([0-9]+)\s*/\s*[0-9]+", 1).try_cast("double") / F.regexp_extract(c, r"(?i)[0-9]+\s*/\s*([0-9]+)", 1).try_cast("double"), 4)
    n = lambda x, noun: F.regexp_extract(x, rf"(?i)([0-9]+)\s+{noun}", 1).try_cast("int")
    return F.transform(line, lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"(?i)^\s*paper\s+([ivx0-9]+)", 1)).alias("paper"), n(x, "questions").alias("questions"), n(x, "marks").alias("marks"),
        (F.coalesce(n(x, "hours?"), F.lit(0)) * 60 + F.coalesce(n(x, "min"), F.lit(0))).alias("minutes"), F.coalesce(share(F.regexp_extract(x, r"(?i)negative.*", 0)), share(rule)).alias("penalty"),
    ))


def outline(text: Column) -> Column:
    """(node, parent) of a syllabus of headings (a line that ends in a colon) and bullets, in order."""
    line = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("under"), F.array().cast("array<struct<node:string,parent:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        head, bullet = x.endswith(":"), x.rlike(r"^[-*•]\s")
        node = F.when(head, F.regexp_replace(x, r"\s*:$", "")).otherwise(F.regexp_replace(x, r"^[-*•]\s+", ""))
        row = F.struct(node.alias("node"), F.when(head, F.lit(None).cast("string")).otherwise(F.nullif(acc["under"], F.lit(""))).alias("parent"))
        return F.struct(F.when(head, node).otherwise(acc["under"]).alias("under"), F.when(head | bullet, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(line, start, step, lambda acc: acc["out"])


def steps(text: Column) -> Column:
    """(step, what) of a procedure told by markers or by numbered headings: the reading with more steps, of equal ones the markers."""
    read = lambda form: F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, form, 1).cast("int").alias("step"), F.trim(F.regexp_extract(s, form, 2)).alias("what")))
    marked, headed = read(r"(?i)\bstep\s+([0-9]+)\s*[:.-]\s*([^.\n]+)"), read(r"(?m)^([0-9]+)\)\s+([^.\n]+)")
    return F.when(F.size(marked) >= F.greatest(F.size(headed), F.lit(2)), marked).when(F.size(headed) >= 2, headed).otherwise(F.slice(marked, 1, 0))


def released(text: Column, what: str) -> Column:
    """The date that belongs to a release: the first after the cue in its sentence, with a word of release and no other cue between."""
    low = F.lower(text)
    own = F.regexp_extract(low, rf"\b(?:{what})\b(?:(?!\b(?:admit card|result|answer key)\b)[^.;\n])*?\b(?:released?|available|declared|issued)\b(?:(?!\b(?:admit card|result|answer key)\b)[^;\n])*?({DATE})", 1)
    return F.when(own != "", iso(own))


def whole_cell(cell: Column) -> Column:
    """What a whole cell is: DATE, SPAN (two dates), SEASON (months and a year), or null."""
    c = F.lower(F.trim(cell))
    return F.when(c.rlike(rf"^{DATE}$"), F.when(c.rlike(rf"^{MONTH},? [0-9]{{4}}$"), "SEASON").otherwise("DATE")).when(c.rlike(rf"^{DATE}\s*(?:to|-|–)\s*{DATE}$"), "SPAN").when(c.rlike(rf"^{MONTH}\s*(?:to|-|/)\s*{MONTH},? [0-9]{{4}}$"), "SEASON")


def without_numbering(text: Column) -> Column:
    """Lines without the numbers that only list them."""
    return F.regexp_replace(text, r"(?m)^\s*\(?[0-9]{1,2}[.)]\s+", "")
