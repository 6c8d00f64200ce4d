"""Queries over question papers, keys and eligibility clauses that are printed from parts; the SQL knows what was printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import eligibility as E
from factloom.operators import papers as P

from .registry import query, table


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, paper and key: a few questions a part in two forms; some papers repeat a number, leave out an option or lack an answer."""
    p, n = F.col("p_partkey"), 3 + F.col("p_partkey") % 4
    s = lambda c: c.cast("string")

    def question(i):
        body = F.concat(F.lit("What is 1. of "), s(p + i), F.lit("?\n 9. stands in a list\n(A) one (B) two\n(C) three"), F.when((i == 2) & (p % 5 == 0), "").otherwise(" (D) four"))
        return F.concat(F.when(p % 2 == 0, F.concat(s(i), F.lit(". "))).otherwise(F.concat(F.lit("Q. "), s(i), F.lit(") "))), body)

    def answer(i):
        label = F.when((i == 1) & (p % 6 == 0), "*").otherwise(F.element_at(F.array(*map(F.lit, "ABCD")), (p + i).cast("int") % 4 + 1))
        return F.when((i == n) & (p % 3 == 0), "").otherwise(F.concat(s(i), F.lit("-"), label, F.lit("  ")))

    each = F.sequence(F.lit(1).cast("long"), n)
    paper = F.concat(F.lit("Answer all 3. of them\n"), F.array_join(F.transform(each, question), "\n"), F.when(p % 7 == 0, "\n1. printed again").otherwise(""))
    key = F.concat(F.lit("Key: "), F.array_join(F.transform(each, answer), ""), F.when(p % 4 == 1, "99-A").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", paper.alias("paper"), key.alias("key"))


#: q: the questions of each paper, in order.
PAPERS = """b AS (SELECT p_partkey, p_partkey AS p, 3 + p_partkey % 4 AS n FROM part), q AS (SELECT p_partkey, p, n, unnest(generate_series(1, n)) AS i FROM b)"""


@query(f"""WITH {PAPERS} SELECT p_partkey, CAST(i AS INTEGER) AS n, 'What is 1. of ' || (p + i) || '? 9. stands in a list' AS question, CASE WHEN i = 2 AND p % 5 = 0 THEN 'A one|B two|C three' ELSE 'A one|B two|C three|D four' END || CASE WHEN i = n AND p % 7 = 0 THEN ' 1. printed again' ELSE '' END AS options, true AS in_run FROM q
UNION ALL SELECT p_partkey, 9, 'stands in a list', '', false FROM q UNION ALL SELECT p_partkey, 1, 'printed again', '', false FROM b WHERE p % 7 = 0""")
def x35_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their options; a number that breaks the run is no question."""
    q = P.questions(_papers(spark, sf_dir), "p_partkey", "paper")
    return q.select("p_partkey", "n", "question", F.array_join(F.transform("options", lambda o: F.concat_ws(" ", o["label"], o["text"])), "|").alias("options"), "in_run")


@query(f"""WITH {PAPERS}, k AS (SELECT p_partkey, i, CASE WHEN i = 1 AND p % 6 = 0 THEN '*' ELSE substr('ABCD', CAST((p + i) % 4 + 1 AS INTEGER), 1) END AS answer FROM q WHERE NOT (i = n AND p % 3 = 0)),
j AS (SELECT q.*, answer, CASE WHEN q.i = 2 AND p % 5 = 0 THEN 3 ELSE 4 END AS options FROM q LEFT JOIN k USING (p_partkey, i))
SELECT p_partkey, CAST(i AS INTEGER) AS n, CAST(options AS INTEGER) AS options, answer, CASE WHEN options < 4 THEN 'HELD' WHEN answer IS NULL THEN 'NO_KEY' WHEN answer = '*' THEN 'WITHDRAWN' ELSE 'ANSWERED' END AS state FROM j
UNION ALL SELECT p_partkey, 99, NULL, 'A', 'KEY_ONLY' FROM b WHERE p % 4 = 1""")
def x35_aligned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its answer from the key, and what keeps either from counting."""
    papers = _papers(spark, sf_dir)
    return P.aligned(P.questions(papers, "p_partkey", "paper").where("in_run"), P.answers(papers, "p_partkey", "key"), "p_partkey")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey and text: rules for all posts, for some by codes and ranges, and one that is told twice."""
    z = F.col("p_size")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("Candidates of all posts: age 18 to "), s(30 + z % 5), F.lit(" years and a bachelor degree.\nPost codes 02 to 04, 6: age 21 to "), s(35 + z % 3), F.lit(" years.\nFor post no. 5 a master degree is asked for.\nPost codes 4 & 5: maximum age "),
        s(40 + z % 4), F.lit(".\nAge relaxation: SC/ST by 5 years.\nPost code 6: relaxation of OBC "), s(3 + z % 2), F.lit(" years.\nNothing else."),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("""WITH c AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS z, unnest(generate_series(1, 7)) AS code FROM part)
SELECT p_partkey, CAST(code AS INTEGER) AS code, CASE WHEN code IN (2, 3, 4, 6) THEN 21 ELSE 18 END AS low, CASE WHEN code IN (4, 5) THEN 40 + z % 4 WHEN code IN (2, 3, 6) THEN 35 + z % 3 ELSE 30 + z % 5 END AS high, CASE WHEN code IN (2, 3, 4, 5, 6) THEN 'POST' ELSE 'GENERAL' END AS high_scope,
  CASE WHEN code = 5 THEN 'POST_GRADUATION' ELSE 'GRADUATION' END AS level, CASE WHEN code = 6 THEN 'OBC ' || (3 + z % 2) ELSE 'SC 5,ST 5' END AS relaxations FROM c""")
def x31_rules_by_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age, level and relaxations of each post: what clauses say of its code, else what they say of all."""
    notices = _clauses(spark, sf_dir)
    posts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("code"))
    told = E.in_force(posts, E.rules_of(notices, "p_partkey", "text"), "p_partkey", "code")
    relaxed = F.array_join(F.transform("relaxations", lambda r: F.concat_ws(" ", r["category"], r["years"].cast("string"))), ",")
    return told.select("p_partkey", "code", "low", "high", "high_scope", "level", relaxed.alias("relaxations"))
