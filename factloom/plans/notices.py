"""Queries that read notices written from the orders: the SQL knows what was written, the query reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import notices as N
from factloom.functions import text as T

from .registry import query, table

#: What stands in a notice, in the words of SQL: o is the order's number, c its customer's.
WRITTEN = """n AS (SELECT o_orderkey, o_orderkey AS o, o_custkey AS c, CAST(1 + o_custkey % 900 AS INTEGER) AS posts, CAST(18 + o_orderkey % 5 AS INTEGER) AS low, CAST(27 + o_orderkey % 5 AS INTEGER) AS high, 100 * (o_custkey % 4000) AS fee,
strftime(DATE '2024-01-01' + CAST(o_orderkey % 300 AS INTEGER), '%Y-%m-%d') AS last, strftime(DATE '2024-02-01' + CAST(o_orderkey % 300 AS INTEGER), '%Y-%m-%d') AS held FROM orders)"""


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, s = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
    last, held = F.date_add(F.lit("2024-01-01").cast("date"), (o % 300).cast("int")), F.date_add(F.lit("2024-02-01").cast("date"), (o % 300).cast("int"))
    said = F.when(o % 3 == 0, F.date_format(last, "dd/MM/yyyy")).when(o % 3 == 1, F.date_format(last, "d MMMM yyyy")).otherwise(F.date_format(last, "MMM d, yyyy"))
    fee = F.concat(F.lit("Fee Rs. "), T.lakhs(100 * (c % 4000)), F.lit("/- only; "), F.when(c % 2 == 0, "no fee for women").otherwise("all pay"))
    change = F.when(o % 7 == 0, F.concat(F.lit(" The last date is extended from "), F.date_format(last, "dd.MM.yyyy"), F.lit(" to "), F.date_format(held, "dd.MM.yyyy"), F.lit("."))).when(
        o % 7 == 1, F.concat(F.lit(" Vacancies are revised from "), s(1 + c % 900), F.lit(" to "), s(2 + c % 900), F.lit("."))
    ).otherwise("")
    text = F.concat(
        F.lit("Advertisement of Group "), F.element_at(F.array(*map(F.lit, ("I", "II", "IV"))), (o % 3 + 1).cast("int")), F.lit(" services.\n1. Vacancies: "), s(1 + c % 900), F.lit(" posts.\n2. Age "), s(18 + o % 5), F.lit(" to "), s(27 + o % 5),
        F.lit(" years.\n3. "), fee, F.lit(".\nLast date to apply "), said, F.lit("; exam held on "), F.date_format(held, "yyyy-MM-dd"), F.lit(" and"), F.when(o % 2 == 0, " after.").otherwise(""),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), change.alias("change"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, last || ',' || held || CASE WHEN o % 7 = 0 THEN ',' || last || ',' || held ELSE '' END AS dates FROM n")
def f3_all_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", F.array_join(N.dates(F.concat("text", "change")), ",").alias("dates"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, last AS day FROM n")
def f4_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", F.get(N.dates(F.col("text")), F.lit(0)).alias("day"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, fee::DOUBLE AS fee, c % 2 = 0 AS exempt FROM n")
def f11_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", F.get(N.amounts(F.col("text")), F.lit(0)).alias("fee"), N.exempt(F.col("text")).alias("exempt"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, low, high, posts FROM n")
def f12_ages_and_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _notices(spark, sf_dir).select("o_orderkey", N.age_band(text).alias("age"), N.bound_count(text, "vacancies|posts").alias("posts")).select("o_orderkey", "age.low", "age.high", "posts")


@query(f"WITH {WRITTEN} SELECT o_orderkey, o % 2 = 0 AS whole FROM n")
def f14_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", N.complete(F.col("text")).alias("whole"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, (['group i', 'group ii', 'group iv'])[o % 3 + 1] AS groups FROM n")
def f18_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", F.array_join(N.ordinals(F.col("text")), ",").alias("groups"))


@query(f"WITH {WRITTEN} SELECT o_orderkey, CASE o % 7 WHEN 0 THEN 'LAST_DATE' WHEN 1 THEN 'VACANCIES' END AS kind, CASE o % 7 WHEN 0 THEN last WHEN 1 THEN CAST(posts AS VARCHAR) END AS old, CASE o % 7 WHEN 0 THEN held WHEN 1 THEN CAST(posts + 1 AS VARCHAR) END AS new FROM n")
def x20_corrigenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", N.revision(F.col("change")).alias("r")).select("o_orderkey", "r.*")


@query(f"WITH {WRITTEN} SELECT o_orderkey, 'APPLICATION_END' AS kind, last AS date FROM n UNION ALL SELECT o_orderkey, 'EXAM', held FROM n")
def x9_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notices(spark, sf_dir).select("o_orderkey", F.explode(N.milestones(F.col("text"))).alias("m")).select("o_orderkey", "m.*")


@query(f"WITH {WRITTEN} SELECT o_orderkey, 'APPLICATION_END' AS kind, CASE WHEN o % 7 = 0 THEN held ELSE last END AS date, CASE WHEN o % 7 = 0 THEN 'SUPERSEDE' ELSE 'ADD' END AS overlay FROM n")
def x41_revised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date that holds: the notice's own, or what its corrigendum states instead."""
    n = _notices(spark, sf_dir).select("o_orderkey", F.get(F.filter(N.milestones(F.col("text")), lambda m: m["kind"] == "APPLICATION_END"), F.lit(0))["date"].alias("printed"), N.revision(F.col("change")).alias("r"))
    moved = F.coalesce((F.col("r.kind") == "LAST_DATE") & (F.col("r.old") == F.col("printed")), F.lit(False))
    return n.select("o_orderkey", F.lit("APPLICATION_END").alias("kind"), F.when(moved, F.col("r.new")).otherwise(F.col("printed")).alias("date"), F.when(moved, "SUPERSEDE").otherwise("ADD").alias("overlay"))


@query(f"""WITH {WRITTEN} SELECT o_orderkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos, unnest(['Vacancies: ' || posts || ' posts.', 'Age ' || low || ' to ' || high || ' years.', 'Fee']) AS clause FROM n""")
def x37_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _notices(spark, sf_dir).select("o_orderkey", F.posexplode(N.clauses(F.col("text"))).alias("pos", "clause"))
    return each.select("o_orderkey", "pos", F.when(F.col("clause").startswith("Fee Rs."), "Fee").otherwise(F.col("clause")).alias("clause"))


@query(f"""WITH {WRITTEN} SELECT o_orderkey, 'posts' AS field, CAST(posts AS VARCHAR) AS value FROM n UNION ALL SELECT o_orderkey, 'age', low || '-' || high FROM n UNION ALL SELECT o_orderkey, 'fee', CAST(fee AS VARCHAR) FROM n UNION ALL SELECT o_orderkey, 'last_date', last FROM n UNION ALL SELECT o_orderkey, 'exam_date', held FROM n""")
def x36_notice_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value printed of each field of a notice (eligibility X31, fees X32, dates): one pass over its text."""
    text = F.col("text")
    read = _notices(spark, sf_dir).select("o_orderkey", "text", N.milestones(text).alias("m"), N.age_band(text).alias("age"))
    on = lambda kind: F.get(F.filter("m", lambda m: m["kind"] == kind), F.lit(0))["date"]
    fields = {
        "posts": N.bound_count(text, "vacancies|posts").cast("string"), "age": F.concat_ws("-", F.col("age.low").cast("string"), F.col("age.high").cast("string")),
        "fee": F.get(N.amounts(text), F.lit(0)).cast("long").cast("string"), "last_date": on("APPLICATION_END"), "exam_date": on("EXAM"),
    }
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()]), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return read.select("o_orderkey", F.explode(each).alias("x")).select("o_orderkey", "x.*")


@query(f"""WITH {WRITTEN}, f AS (SELECT o_orderkey, posts, low, high, o % 7 = 1 AS contested FROM n)
SELECT o_orderkey, CASE WHEN contested THEN 'NEEDS_REVIEW' ELSE 'FOUND' END AS posts_state, CASE WHEN high - low BETWEEN 5 AND 25 THEN 'FOUND' ELSE 'NOT_EXTRACTED' END AS age_state FROM f""")
def x40_vetted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that are withheld, never repaired: a count that a corrigendum changes, a band that no rule could mean."""
    n = _notices(spark, sf_dir).select("o_orderkey", N.bound_count(F.col("text"), "vacancies|posts").alias("posts"), N.age_band(F.col("text")).alias("age"), N.revision(F.col("change")).alias("r"))
    posts = F.when(F.col("posts").isNull(), "NOT_EXTRACTED").when(F.coalesce(F.col("r.kind") == "VACANCIES", F.lit(False)), "NEEDS_REVIEW").otherwise("FOUND")
    return n.select("o_orderkey", posts.alias("posts_state"), F.when((F.col("age.high") - F.col("age.low")).between(5, 25), "FOUND").otherwise("NOT_EXTRACTED").alias("age_state"))


SCHEME = """s AS (SELECT p_partkey, p_partkey AS p, CAST(p_size AS INTEGER) AS z FROM part)"""


def _schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, z, s = F.col("p_partkey"), F.col("p_size"), lambda x: x.cast("string")
    rules = F.concat(
        F.lit("Age relaxation: SC/ST "), s(5 + z % 3), F.lit(" years, OBC: by "), s(2 + z % 2), F.lit(" years. Fee Rs. "), T.western(100 * z), F.lit(" for General, no fee for SC/ST.\nAs printed on 120 pages."),
    )
    scheme = F.concat(
        F.lit("Scheme\nPaper I: "), s(50 + z), F.lit(" questions, "), s(100 + z), F.lit(" marks, 2 hours "), s(z % 30), F.lit(" min\nPaper II: 40 questions, 80 marks, 1 hour; negative marking 1/"), s(1 + z % 4),
        F.when(p % 2 == 0, "\nIn all papers there is negative marking of 1/3 of a mark.").otherwise(""),
    )
    syllabus = F.concat(F.lit("General:\n- Numbers\n* Words "), s(z), F.lit("\nsome prose of it\nScience :\n- Light "), s(p % 7), F.lit("\n"))
    how = F.when(p % 3 == 0, F.concat(F.lit("Step 1: Register online. Step 2: Pay "), s(z), F.lit(". Step 3: Submit."))).when(p % 3 == 1, F.concat(F.lit("How to apply\n1) Register\n2) Pay "), s(z))).otherwise("Apply. Step 1: none other.")
    news = F.concat(
        F.lit("Result of the last year stands. Admit card for Paper I will be "), F.when(p % 2 == 0, "released").otherwise("ready"), F.lit(" on "), s(1 + z % 28), F.lit("/05/2024; result to be declared on June "), s(1 + p % 28), F.lit(", 2024."),
    )
    return table(spark, sf_dir, "part").select("p_partkey", rules.alias("rules"), scheme.alias("scheme"), syllabus.alias("syllabus"), how.alias("how"), news.alias("news"))


def _each(df: DataFrame, found) -> DataFrame:
    return df.select("p_partkey", F.explode(found).alias("x")).select("p_partkey", "x.*")


@query(f"WITH {SCHEME} SELECT p_partkey, unnest(['SC', 'ST', 'OBC']) AS category, unnest([5 + z % 3, 5 + z % 3, 2 + z % 2]) AS years FROM s")
def x31_relaxations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_schemes(spark, sf_dir), N.relaxations(F.col("rules")))


@query(f"""WITH {SCHEME} SELECT p_partkey, 'GENERAL' AS "group", CAST(100 * z AS BIGINT) AS amount, false AS exempt FROM s UNION ALL SELECT p_partkey, 'SC/ST', NULL, true FROM s""")
def x32_fee_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_schemes(spark, sf_dir), N.fee_rules(F.col("rules")))


@query(f"""WITH {SCHEME} SELECT p_partkey, 'I' AS paper, 50 + z AS questions, 100 + z AS marks, 120 + z % 30 AS minutes, CASE WHEN p % 2 = 0 THEN 0.3333::DOUBLE END AS penalty FROM s UNION ALL SELECT p_partkey, 'II', 40, 80, 60, round(1.0::DOUBLE / (1 + z % 4), 4) FROM s""")
def x29_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_schemes(spark, sf_dir), N.papers(F.col("scheme")))


@query(f"""WITH {SCHEME} SELECT p_partkey, unnest(['General', 'Numbers', 'Words ' || z, 'Science', 'Light ' || p % 7]) AS node, unnest([NULL, 'General', 'General', NULL, 'Science']) AS parent FROM s""")
def x30_syllabus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_schemes(spark, sf_dir), N.outline(F.col("syllabus")))


@query(f"""WITH {SCHEME}, t AS (SELECT p_partkey, CASE p % 3 WHEN 0 THEN ['Register online', 'Pay ' || z, 'Submit'] WHEN 1 THEN ['Register', 'Pay ' || z] ELSE [] END AS w FROM s) SELECT p_partkey, CAST(generate_subscripts(w, 1) AS INTEGER) AS step, unnest(w) AS what FROM t""")
def x33_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_schemes(spark, sf_dir), N.steps(F.col("how")))


@query(f"""WITH {SCHEME} SELECT p_partkey, CASE WHEN p % 2 = 0 THEN '2024-05-' || lpad(CAST(1 + z % 28 AS VARCHAR), 2, '0') END AS admit_card, '2024-06-' || lpad(CAST(1 + p % 28 AS VARCHAR), 2, '0') AS result FROM s""")
def x34_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schemes(spark, sf_dir).select("p_partkey", N.released(F.col("news"), "admit card").alias("admit_card"), N.released(F.col("news"), "result").alias("result"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN p_size END AS posts, CASE p_size % 4 WHEN 0 THEN 120 WHEN 2 THEN p_size END AS pages, p_size % 4 < 2 AS attributed FROM part""")
def x39_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure counts for a field only where it stands with the field's own noun: pages are no posts, years no posts."""
    n = F.col("p_size").cast("string")
    forms = [F.concat(n, F.lit(" posts, printed on 120 pages")), F.concat(F.lit("Total vacancies: "), n), F.concat(F.lit("See "), n, F.lit(" pages on posts")), F.concat(F.lit("Aged "), n, F.lit(" years; posts are told later"))]
    text = F.element_at(F.array(*forms), (F.col("p_size") % 4 + 1).cast("int"))
    told = table(spark, sf_dir, "part").select("p_partkey", "p_size", N.bound_count(text, "vacancies|posts").alias("posts"), N.bound_count(text, "pages").alias("pages"))
    return told.select("p_partkey", "posts", "pages", F.coalesce(F.col("posts") == F.col("p_size"), F.lit(False)).alias("attributed"))


@query("""SELECT o_orderkey, (['DATE', 'SPAN', 'SEASON', 'SEASON', NULL])[o_orderkey % 5 + 1] AS kind FROM orders""")
def f6_whole_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    day = F.date_format(d, "dd.MM.yyyy")
    cell = F.when(k == 0, F.concat(F.lit(" "), day)).when(k == 1, F.concat(day, F.lit(" to "), F.date_format(F.date_add(d, 20), "d MMMM yyyy"))).when(k == 2, F.date_format(d, "MMMM yyyy")).when(k == 3, "May-June 2024").otherwise(F.concat(F.lit("by "), day))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.whole_cell(cell).alias("kind"))


@query(r"SELECT doc_id, regexp_replace('1. ' || coalesce(lang, '-') || chr(10) || '(2) ' || doc_id || chr(10) || 'of 3. kind', '(?m)^\s*\(?[0-9]{1,2}[.)]\s+', '', 'g') AS plain FROM documents")
def f30_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("1. "), F.coalesce("lang", F.lit("-")), F.lit("\n(2) "), F.col("doc_id").cast("string"), F.lit("\nof 3. kind"))
    return table(spark, sf_dir, "documents").select("doc_id", N.without_numbering(text).alias("plain"))
