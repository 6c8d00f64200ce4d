"""Queries over outlines and schemes that are printed from parts, in three forms; the SQL knows what was printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import outline as O
from factloom.operators.stored import stored

from .registry import dealt, query, table

#: Outlines of depth six: (structure, level, what is printed, title); {z} is the part's size, {p} its key.
_FORMS = (
    ("CLAUSES", (
        (2, "1.1 General {z}", "General {z}"), (3, "1.1.1. Numbers", "Numbers"), (4, "1.1.1.1 Whole", "Whole"), (5, "1.1.1.1.1  Even", "Even"), (6, "1.1.1.1.1.1 Squares {p}", "Squares {p}"),
        (3, "1.1.2 Words", "Words"), (0, "All questions are compulsory.", ""), (2, "1.2 Science", "Science"), (5, "1.2.1.1.1 Light", "Light"),
    )),
    ("HEADINGS", (
        (1, "STAGE I: Preliminary", "STAGE I: Preliminary"), (2, "Paper - I: General {z}", "Paper - I: General {z}"), (3, "Section A", "Section A"), (4, "Numbers:", "Numbers"), (6, "1. Whole", "Whole"), (7, "- Even {p}", "Even {p}"), (6, "2) Odd", "Odd"),
        (0, "see below", ""), (4, "Words:", "Words"), (7, "* Nouns", "Nouns"), (2, "Paper II", "Paper II"), (5, "IV. Light", "Light"),
    )),
    ("INDENTED", (
        (1, "Syllabus {z}", "Syllabus {z}"), (3, "  General", "General"), (5, "    Numbers", "Numbers"), (7, "      Whole", "Whole"), (9, "        Even", "Even"), (11, "          Squares {p}", "Squares {p}"), (3, "  Science", "Science"), (6, "     - Light", "Light"),
    )),
)


def _filled(c: str) -> Column:
    return F.replace(F.replace(F.lit(c), F.lit("{z}"), F.col("p_size").cast("string")), F.lit("{p}"), F.col("p_partkey").cast("string"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and text: one of the forms, by the part's key."""
    text = [_filled("\n".join(printed for _, printed, _ in lines)) for _, lines in _FORMS]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.element_at(F.array(*text), (F.col("p_partkey") % len(_FORMS) + 1).cast("int")).alias("text"))


_ROWS = ", ".join(f"({k}, '{s}', {n}, {level}, '{title}')" for k, (s, lines) in enumerate(_FORMS) for n, (level, title) in enumerate([(lv, t) for lv, _, t in lines if lv], 1))
OUTLINE = f"""RECURSIVE v(form, structure, n, level, title) AS (VALUES {_ROWS}),
w AS (SELECT *, (SELECT max(u.n) FROM v u WHERE u.form = v.form AND u.n < v.n AND u.level < v.level) AS parent FROM v),
r AS (SELECT form, structure, n, title, parent, 0 AS depth, title AS path FROM w WHERE parent IS NULL UNION ALL SELECT w.form, w.structure, w.n, w.title, w.parent, r.depth + 1, r.path || ' > ' || w.title FROM w JOIN r ON w.form = r.form AND w.parent = r.n),
o AS (SELECT p_partkey, structure, CAST(n AS INTEGER) AS n, CAST(parent AS INTEGER) AS parent, CAST(depth AS INTEGER) AS depth, replace(replace(path, '{{z}}', CAST(p_size AS VARCHAR)), '{{p}}', CAST(p_partkey AS VARCHAR)) AS path FROM part JOIN r ON p_partkey % {len(_FORMS)} = form)"""


@query(f"WITH {OUTLINE} SELECT * FROM o")
def x30_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllabuses as trees, whichever of three structures they are printed in."""
    lines = O.lines_of(outlines(spark, sf_dir), "p_partkey", "text")
    return lines.select("p_partkey", "structure", "n", "parent", "depth", F.array_join(F.concat("up", F.array("title")), " > ").alias("path"))


#: A scheme of stages, papers and sections; some sections do not add up to their paper, and some schemes state a stage again.
_SCHEME = (
    "Stage I: Preliminary; negative marking 1/{d}", "Paper I: {q} questions, {m} marks, 2 hours", "Section A: 20 questions, no negative marking", "Section B: {b} questions",
    "Paper II: 40 questions, 80 marks, negative marking 1/4", "Stage II: Mains, 3 hours", "Paper I: {z} questions, 60 marks",
)
_AGAIN = ("STAGE - 1: Preliminary", "Paper 1: {m} marks, 90 minutes", "Paper 2: 80 marks")


def _schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, n, parent, key, questions, marks, minutes and penalty of each heading of each part's scheme, as stated."""
    z, p = F.col("p_size"), F.col("p_partkey")
    figures = {"d": 3 + z % 2, "q": 50 + z, "m": 100 + z, "b": 30 + z + F.when(p % 5 == 0, 1).otherwise(0), "z": z}

    def filled(lines: tuple[str, ...]):
        text = F.lit("\n".join(lines))
        for name, value in figures.items():
            text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
        return text

    text = F.concat(filled(_SCHEME), F.when(p % 2 == 1, F.concat(F.lit("\n"), filled(_AGAIN))).otherwise(""))
    lines = O.lines_of(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", text.alias("text")), "p_partkey", "text")
    said, n = F.col("raw"), lambda noun: F.when(F.contains("raw", F.lit(f" {noun}")), F.regexp_extract("raw", rf"([0-9]+) {noun}", 1).try_cast("int"))
    key = F.concat_ws(" / ", F.transform(F.concat("up", F.array("title")), O.key_of))
    return stored(lines.select("p_partkey", "n", "parent", key.alias("key"), n("questions").alias("questions"), n("marks").alias("marks"), T.minutes(said).alias("minutes"), T.penalty(said).alias("penalty")), "schemes")


#: s: what each heading states, by its place.
SCHEMES = """b AS (SELECT p_partkey, p_partkey AS p, CAST(p_size AS INTEGER) AS z FROM part),
s AS (
  SELECT p_partkey, 1 AS n, NULL AS parent, 'stage 1' AS key, NULL AS questions, NULL AS marks, NULL AS minutes, round(1.0::DOUBLE / (3 + z % 2), 4) AS penalty FROM b
  UNION ALL SELECT p_partkey, 2, 1, 'stage 1 / paper 1', 50 + z, 100 + z, 120, NULL FROM b
  UNION ALL SELECT p_partkey, 3, 2, 'stage 1 / paper 1 / section a', 20, NULL, NULL, 0.0 FROM b
  UNION ALL SELECT p_partkey, 4, 2, 'stage 1 / paper 1 / section b', 30 + z + CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END, NULL, NULL, NULL FROM b
  UNION ALL SELECT p_partkey, 5, 1, 'stage 1 / paper 2', 40, 80, NULL, 0.25 FROM b
  UNION ALL SELECT p_partkey, 6, NULL, 'stage 2', NULL, NULL, 180, NULL FROM b
  UNION ALL SELECT p_partkey, 7, 6, 'stage 2 / paper 1', z, 60, NULL, NULL FROM b
  UNION ALL SELECT p_partkey, 8, NULL, 'stage 1', NULL, NULL, NULL, NULL FROM b WHERE p % 2 = 1
  UNION ALL SELECT p_partkey, 9, 8, 'stage 1 / paper 1', NULL, 100 + z, 90, NULL FROM b WHERE p % 2 = 1
  UNION ALL SELECT p_partkey, 10, 8, 'stage 1 / paper 2', NULL, 80, NULL, NULL FROM b WHERE p % 2 = 1
)"""


@query(f"""WITH RECURSIVE {SCHEMES}, f AS (SELECT p_partkey, n, penalty AS rule, CASE WHEN penalty IS NOT NULL THEN n END AS at FROM s WHERE parent IS NULL UNION ALL SELECT s.p_partkey, s.n, coalesce(s.penalty, f.rule), CASE WHEN s.penalty IS NOT NULL THEN s.n ELSE f.at END FROM s JOIN f ON s.p_partkey = f.p_partkey AND s.parent = f.n)
SELECT s.p_partkey, CAST(s.n AS INTEGER) AS n, key, rule::DOUBLE AS in_force, CAST(f.at AS INTEGER) AS stated_at FROM s JOIN f ON s.p_partkey = f.p_partkey AND s.n = f.n""")
def x29_rules_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative marking in force at each stage, paper and section: its own, else that of the nearest above."""
    return O.inherited(_schemes(spark, sf_dir), "p_partkey", "penalty").select("p_partkey", "n", "key", "in_force", "stated_at")


@query(f"""WITH {SCHEMES}, c AS (SELECT p.p_partkey, p.n, sum(c.questions) AS added FROM s p JOIN s c ON c.p_partkey = p.p_partkey AND c.parent = p.n WHERE p.questions IS NOT NULL GROUP BY 1, 2)
SELECT s.p_partkey, CAST(s.n AS INTEGER) AS n, key, CAST(questions AS INTEGER) AS questions, CAST(added AS BIGINT) AS added, added <> questions AS held FROM s JOIN c ON s.p_partkey = c.p_partkey AND s.n = c.n""")
def x29_held_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with the questions of their sections; one whose sections do not add up is held."""
    s = _schemes(spark, sf_dir)
    added = s.where("parent IS NOT NULL").groupBy("p_partkey", F.col("parent").alias("n")).agg(F.sum("questions").alias("added"))
    return s.where("questions IS NOT NULL").join(added.where("added IS NOT NULL"), ["p_partkey", "n"]).select("p_partkey", "n", "key", "questions", "added", (F.col("added") != F.col("questions")).alias("held"))


_ONE = ", ".join(f"CAST(CASE WHEN min({f}) = max({f}) THEN min({f}) END AS {t}) AS {f}" for f, t in (("questions", "INTEGER"), ("marks", "INTEGER"), ("minutes", "INTEGER"), ("penalty", "DOUBLE")))
_DIFFERS = " OR ".join(f"coalesce(min({f}) <> max({f}), false)" for f in ("questions", "marks", "minutes", "penalty"))


@query(f"WITH {SCHEMES} SELECT p_partkey, key, count(*) AS stated, {_ONE}, {_DIFFERS} AS held FROM s GROUP BY 1, 2")
def x29_restated_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and papers that a scheme states again, as one each; what the statements disagree on is held back."""
    return O.restated(_schemes(spark, sf_dir), ["p_partkey", "key"], ["questions", "marks", "minutes", "penalty"])
