"""Queries over units of texts: sentences with their places, and values read on to the end of the sentence that says them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import units as U
from factloom.operators import extract as X

from .facts import WHITE
from .registry import query, table

_Q = lambda pattern: pattern.replace("'", "''")


def _marked(c: str) -> str:
    for pattern in (*U.BOUNDS, U.STOP):
        sign = 2 if pattern == U.STOP else 1
        c = rf"regexp_replace({c}, '{_Q(pattern)}', '\1' || chr({sign}) || '\2', 'g')"
    return c


_SHORT = ", ".join(f"'{w}'" for w in U.SHORT)
_WORD = rf"lower(regexp_extract(t, '{_Q(U._WORD)}', 1))"
_REAL = rf"""(regexp_matches(t, '[?!][)\]”"’'']{{0,2}}\z') OR ({_WORD} <> '' AND {_WORD} NOT IN ({_SHORT}) AND NOT contains({_WORD}, '.') AND NOT regexp_matches({_WORD}, '^(?:[0-9]{{1,3}}|[a-z])\z') AND regexp_matches(coalesce(rest, ''), '{_Q(U._OPENS)}')))"""
#: u: the units of every document, as the operator says them.
UNITS = rf"""d AS MATERIALIZED (SELECT doc_id, translate(trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')), chr(1) || chr(2), '  ') AS t FROM documents),
uc AS (SELECT doc_id, regexp_extract_all({_marked("t")}, '(?s)[^' || chr(1) || chr(2) || ']*[' || chr(1) || chr(2) || ']|[^' || chr(1) || chr(2) || ']+') AS ps FROM d),
ur AS (SELECT doc_id, generate_subscripts(ps, 1) AS n, unnest(ps) AS p FROM uc),
uq AS (SELECT doc_id, n, translate(p, chr(1) || chr(2), '') AS t, CASE WHEN ends_with(p, chr(1)) THEN 1 WHEN ends_with(p, chr(2)) THEN 2 ELSE 0 END AS cut FROM ur),
uw AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY n) AS rest, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM uq),
ux AS (SELECT *, cut = 2 AND {_REAL} AS ends FROM uw),
uy AS (SELECT *, coalesce(sum(CASE WHEN ends OR cut = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ux),
u AS MATERIALIZED (SELECT doc_id, CAST(max(e) AS BIGINT) AS "end", arg_max(ends, n) AS complete, string_agg(t, '' ORDER BY n) AS sentence FROM uy GROUP BY doc_id, k HAVING trim(string_agg(t, '' ORDER BY n)) <> '')"""


@query(f"""WITH {UNITS} SELECT doc_id, "end" - length(sentence) AS begin, "end", complete, trim(sentence) AS sentence FROM u""")
def f13_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every document: where it stands, and whether it ends as a sentence ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", U.flat(F.col("text")).alias("t"))
    return U.sentences_of(docs, "doc_id", "t").select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "complete", F.trim("sentence").alias("sentence"))


FIELDS = (
    X.Field("licence", "(?i)licen[sc]e", "(?i)released|under|version|work", "(?i)unless", "(?i)(?:apache|mit|gnu general public|bsd) licen[sc]e[^.;]*"),
    X.Field("contact", "@", "(?i)mail|contact|write", "(?i)noreply", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]+"),
    X.Field("phone", "[+(][0-9]", "(?i)call|phone|ring", "(?i)card", "[+(][0-9][0-9 ()-]{7,}[0-9]"),
    X.Field("address", r"[0-9]\.[0-9]+\.[0-9]", "(?i)ip|host|server", "(?i)version", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    X.Field("card", "[0-9]{4}", "(?i)card|pay|number", "(?i)phone", "[0-9]{4}(?:[ -]?[0-9]{4}){3}"),
    X.Field("figure", "[0-9]", "(?i)total|count|number", "(?i)page", r"[0-9][0-9,.]*[0-9]|[0-9]"),
)
_PIECES = r"""s AS (SELECT doc_id, t, unnest(generate_series(0, greatest(0, length(t) - 161), 160)) AS start FROM d),
w AS (SELECT doc_id, start, CASE WHEN start = 0 THEN '' ELSE regexp_extract(substr(t, greatest(1, start - 319), least(320, start)), '\S*\z') END AS lead, substr(t, start + 1, 320) || regexp_extract(substr(t, start + 321, 320), '\A\S*') AS main FROM s)"""
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, start, lead, lead || main AS piece, '{f.name}' AS field, greatest(0.0, 1 + 0.6 * len(regexp_extract_all(lead || main, '{f.support}')) - 1.2 * len(regexp_extract_all(lead || main, '{f.against}')))::DOUBLE AS score, regexp_extract(lead || main, '{f.value}') AS value FROM w WHERE regexp_matches(lead || main, '{f.anchor}')"
    for f in FIELDS
)
_AGAIN = " ".join(rf"WHEN '{f.name}' THEN regexp_extract(rest, '\A(?:{f.value})')" for f in FIELDS)
#: h: of every document and field the first of the best passages whose value its own sentence holds whole.
HELD = f"""{UNITS}, {_PIECES}, x AS ({_EACH}), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, start) AS place FROM x QUALIFY place <= 25),
a AS (SELECT *, start - length(lead) + instr(piece, value) - 1 AS begun FROM b WHERE value <> ''),
j AS (SELECT a.*, u.complete, u.sentence, substr(u.sentence, a.begun - (u."end" - length(u.sentence)) + 1) AS rest FROM a JOIN u ON a.doc_id = u.doc_id AND a.begun >= u."end" - length(u.sentence) AND a.begun < u."end"),
v AS (SELECT *, CASE field {_AGAIN} END AS held FROM j),
h AS (SELECT * FROM v WHERE complete AND held <> '' AND starts_with(held, value) QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY place) = 1)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_units(table(spark, sf_dir, "documents").select("doc_id", "text"), FIELDS, "doc_id", "text")


@query(f"WITH {HELD} SELECT doc_id, field, held AS value, CAST(begun AS BIGINT) AS place, trim(sentence) AS span, round(score, 2) AS score, round(least(1.0, score / 3), 4) AS confidence FROM h")
def x1_whole_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six fields of every document: values in the complete sentence that says them, verbatim, or not at all."""
    return _found(spark, sf_dir).withColumnRenamed("at", "place")


@query(f"WITH {HELD} SELECT doc_id, string_agg(field, ',' ORDER BY field) AS found, {len(FIELDS)} - count(*) AS missing FROM h GROUP BY 1")
def x2_supplied_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all fields each document supplies, of those that supply any."""
    return _found(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("found"), (F.lit(len(FIELDS)) - F.count("*")).alias("missing"))


@query(f"WITH {HELD} SELECT doc_id, field, length(trim(sentence)) AS n_chars, contains(t, trim(sentence)) AS verbatim FROM h JOIN d USING (doc_id)")
def x3_verified_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest span of each value, looked up again in the text that it was read from."""
    texts = table(spark, sf_dir, "documents").select("doc_id", U.flat(F.col("text")).alias("t"))
    return _found(spark, sf_dir).join(texts, "doc_id").select("doc_id", "field", F.length("span").cast("long").alias("n_chars"), F.contains("t", F.col("span")).alias("verbatim"))
