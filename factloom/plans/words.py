"""Queries that read values out of texts, cells and dates: one row for each text, or for each thing found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators.reads import first_match
from factloom.sources import records

from .facts import WHITE
from .registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


def _squash(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WHITE}', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_squash('coalesce(text, chr(0))')}) AS digest, CAST(length({_squash('coalesce(text, chr(0))')}) AS INTEGER) AS n FROM documents")
def f1_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.squash(F.coalesce("text", F.lit("\0")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.length(t).alias("n"))


#: A sentence with the customer's number in one of the printed forms of a date.
_SAID = "CASE c_nationkey % 4 WHEN 0 THEN 'Last date: ' || (c_custkey % 31 + 1) || '/' || (c_custkey % 12 + 1) || '/20' || (10 + c_custkey % 20) WHEN 1 THEN 'held on ' || (c_custkey % 30 + 1) || 'th ' || (['January', 'Feb', 'march'])[CAST(c_custkey % 3 + 1 AS INTEGER)] || ', 2024' WHEN 2 THEN 'from May ' || (c_custkey % 28 + 1) || ', 2023 on' ELSE 'no date here' END"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), lambda x: x.cast("string")
    month = F.element_at(F.array(*map(F.lit, ("January", "Feb", "march"))), (k % 3 + 1).cast("int"))
    said = (
        F.when(F.col("c_nationkey") % 4 == 0, F.concat(F.lit("Last date: "), n(k % 31 + 1), F.lit("/"), n(k % 12 + 1), F.lit("/20"), n(10 + k % 20)))
        .when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit("held on "), n(k % 30 + 1), F.lit("th "), month, F.lit(", 2024")))
        .when(F.col("c_nationkey") % 4 == 2, F.concat(F.lit("from May "), n(k % 28 + 1), F.lit(", 2023 on"))).otherwise("no date here")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", said.alias("said"))


_MON = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], {m})"
_DAY = "strftime(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d'), '%Y-%m-%d')"


@query(f"""WITH s AS (SELECT c_custkey, lower({_SAID}) AS t FROM customer), p AS (SELECT c_custkey, regexp_extract(t, '([0-9]+)/([0-9]+)/([0-9]+)', ['d', 'm', 'y']) AS a, regexp_extract(t, '([0-9]+)th ([a-z]{{3}})[a-z]*, ([0-9]+)', ['d', 'm', 'y']) AS b, regexp_extract(t, '(may) ([0-9]+), ([0-9]+)', ['m', 'd', 'y']) AS c FROM s)
SELECT c_custkey, coalesce({_DAY.format(y='a.y', m='a.m', d='a.d')}, {_DAY.format(y='b.y', m='CAST(' + _MON.format(m='b.m') + ' AS VARCHAR)', d='b.d')}, {_DAY.format(y='c.y', m="'5'", d='c.d')}) AS day FROM p""")
def f2_first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("c_custkey", F.date_format(D.first_date(F.col("said")), "yyyy-MM-dd").alias("day"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'at ' || (o_custkey % 12 + 1) || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ' PM' WHEN 1 THEN (o_custkey % 12 + 1) || '.' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ' a.m.' WHEN 2 THEN (o_custkey % 26) || ':30 hrs' ELSE 'noon' END AS said, o_custkey AS c, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN lpad(CAST(CASE WHEN c % 12 + 1 = 12 THEN 12 ELSE c % 12 + 13 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') WHEN 1 THEN lpad(CAST(CASE WHEN c % 12 + 1 = 12 THEN 0 ELSE c % 12 + 1 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') WHEN 2 THEN CASE WHEN c % 26 <= 23 THEN lpad(CAST(c % 26 AS VARCHAR), 2, '0') || ':30' END END AS clock FROM t""")
def f5_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, n = F.col("o_orderkey") % 4, F.col("o_custkey"), lambda x: x.cast("string")
    minutes = F.lpad(n(c % 60), 2, "0")
    said = F.when(k == 0, F.concat(F.lit("at "), n(c % 12 + 1), F.lit(":"), minutes, F.lit(" PM"))).when(k == 1, F.concat(n(c % 12 + 1), F.lit("."), minutes, F.lit(" a.m."))).when(k == 2, F.concat(n(c % 26), F.lit(":30 hrs"))).otherwise("noon")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clock(said).alias("clock"))


@query("SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1997-06-15 07:00:00')) / 86400000000.0 + 0.5) AS BIGINT) AS days FROM orders")
def f8_days_to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", D.days_until(F.col("o_orderdate"), F.lit("1997-06-15 07:00:00").cast("timestamp")).alias("days"))


@query("""WITH d AS (SELECT o_custkey, min(o_orderdate) FILTER (o_orderstatus = 'O') AS opens, max(o_orderdate) FILTER (o_orderstatus = 'F') AS closes, max(o_orderdate) FILTER (o_orderstatus = 'P') AS held, TIMESTAMP '1997-06-15' AS now FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN now > held THEN 'POST_EXAM' WHEN now > closes THEN CASE WHEN held IS NOT NULL THEN 'PRE_EXAM' ELSE 'APPLICATION_CLOSED' END WHEN now >= opens THEN 'APPLICATION_OPEN' ELSE 'BEFORE_NOTIFICATION' END AS stage FROM d""")
def f9_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda pick, s: pick(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of(F.min, "O").alias("opens"), of(F.max, "F").alias("closes"), of(F.max, "P").alias("held"))
    return d.select("o_custkey", D.stage(F.col("opens"), F.col("closes"), F.col("held"), F.lit("1997-06-15").cast("timestamp")).alias("stage"))


@query("SELECT event_id, round(pow(2.0, -((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9) / 168.0), 6) AS decayed FROM events")
def f10_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (D.micros(F.lit("2024-02-01")) - D.micros(F.col("ts"))) / 3.6e9
    return table(spark, sf_dir, "events").select("event_id", F.round(D.decay(hours, F.lit(168.0)), 6).alias("decayed"))


@query(rf"""WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: {_squash('p')}), lambda p: p <> '') AS own FROM s)
SELECT doc_id, CAST(generate_subscripts(own, 1) - 1 AS INTEGER) AS ord, unnest(own) AS sentence FROM q""")
def f13_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("t"))).alias("ord", "sentence"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '://[^/?#@]*@', '://'), '#.*$', ''), '([?&][^=&]*)=[^&]*', '\1=*', 'g') AS url FROM pages")
def f16_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.redacted(F.col("url")).alias("url"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' of the ' || lower(p_brand), ' ') AS w FROM part)
SELECT p_partkey, upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS acronym, array_to_string(list_filter(w, lambda x: x NOT IN ('of', 'the', 'small')), ' ') AS distinctive FROM w""")
def f17_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" of the "), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.acronym(name).alias("acronym"), F.array_join(T.distinctive(name, ("of", "the", "small")), " ").alias("distinctive"))


@query("""WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, format('{:,}', n) AS western, CASE WHEN n >= 100000 THEN (n // 100000) || ',' || lpad(CAST(n // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') WHEN n >= 1000 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS lakhs FROM n""")
def f19_number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.western(n).alias("western"), T.lakhs(n).alias("lakhs"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size WHEN p_size <= 20 THEN p_size - 10 END AS n FROM part")
def f20_roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    roman = F.element_at(F.array(*[F.lit(x.upper()) for x in T.ROMAN]), F.greatest(F.lit(1), F.least(F.lit(10), F.col("p_size") - 10)))
    said = F.when(F.col("p_size") <= 10, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_size") <= 20, roman).otherwise("XLII")
    return table(spark, sf_dir, "part").select("p_partkey", T.number_of(said).alias("n"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def f21_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


_PLAIN = "html"
for _pattern in ("(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->", "(?s)<[^>]*>"):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', ' ', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, {_squash(_PLAIN)} AS text FROM pages")
def s15_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", records.visible_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&(amp|lt|gt|quot|nbsp|#39);', ' ', 'g')) AS title FROM pages")
def f25_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(title, "&(amp|lt|gt|quot|nbsp|#39);", " ")).alias("title"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none.deep') AS deep FROM events")
def f26_json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.none.deep").alias("deep"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md FROM documents")
def f27_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2("t", 256).alias("sha"), F.md5("t").alias("md"))


_LABEL = "(['General (UR)', 'SC/ST', 'OBC', 'PwBD-OH', 'EWS & sc', 'Unreserved, st'])[CAST(c_custkey % 6 + 1 AS INTEGER)]"


@query(f"SELECT c_custkey, (['GENERAL', 'SC,ST', 'OBC', '', 'EWS,SC', 'GENERAL,ST'])[CAST(c_custkey % 6 + 1 AS INTEGER)] AS codes FROM customer WHERE {_LABEL} IS NOT NULL")
def f28_category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("General (UR)", "SC/ST", "OBC", "PwBD-OH", "EWS & sc", "Unreserved, st"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.category_codes(label), ",").alias("codes"))


_LEVELS_SAID = ("Master of Arts", "Bachelor's degree or pursuing one", "a degree", "passed 12th", "Matriculation", "no papers", "below class 12")


@query("SELECT p_partkey, (['POST_GRADUATION', 'GRADUATION_APPEARING', 'GRADUATION', 'CLASS_12', 'CLASS_10', NULL, 'BELOW_CLASS_12'])[CAST(p_partkey % 7 + 1 AS INTEGER)] AS level FROM part")
def f29_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _LEVELS_SAID)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.level(said).alias("level"))


_HEADERS = (("(?i)total", "TOTAL"), ("(?i)price|amount", "MONEY"), ("(?i)date", "DATE"), ("(?i)key|number|no\\.", "ID"), ("(?i)name|segment|priority|status|flag", "TEXT"))
_HEADER_SQL = " ".join(f"WHEN regexp_matches(column_name, '{p}') THEN '{k}'" for p, k in _HEADERS)


@query(f"SELECT table_name, column_name, CASE {_HEADER_SQL} ELSE 'OTHER' END AS kind FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'lineitem', 'part')")
def f31_column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(t, c) for t in ("customer", "orders", "lineitem", "part") for c in table(spark, sf_dir, t).columns]
    return spark.createDataFrame(names, "table_name string, column_name string").select("table_name", "column_name", first_match(_HEADERS, [F.col("column_name")], "OTHER").alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN l_linenumber * 100 + 11 WHEN 2 THEN CAST(l_quantity AS BIGINT) + l_linenumber END AS BIGINT) AS n FROM lineitem""")
def f32_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, many = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string")
    by = F.col("l_suppkey") % 4
    cell = F.when(by == 0, " - ").when(by == 1, F.concat(line, F.lit(" 11"))).when(by == 2, F.concat(many, F.lit(" + "), line)).otherwise(F.concat(many, F.lit(" cf")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.cell_count(cell).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN round(p_size / 100.0, 2) WHEN 2 THEN round(1.0 / (p_size + 1), 4) END AS penalty FROM part")
def f33_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, size = F.col("p_partkey") % 5, F.col("p_size")
    said = (
        F.when(by == 0, "There is no negative marking").when(by == 1, F.concat(F.lit("negative marks of "), F.format_string("%.2f", size / 100.0)))
        .when(by == 2, F.concat(F.lit("1 mark each; deduction of 1/"), (size + 1).cast("string"))).when(by == 3, "penalty as stated").otherwise("negative marking applies")
    )
    return table(spark, sf_dir, "part").select("p_partkey", T.penalty(said).alias("penalty"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 5 * 60 WHEN 1 THEN p_size WHEN 2 THEN 60 + p_size END AS minutes FROM part")
def f34_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = F.when(by == 0, F.concat((F.col("p_size") % 5).cast("string"), F.lit(" Hours"))).when(by == 1, F.concat(size, F.lit(" minutes"))).when(by == 2, F.concat(F.lit("1 hr "), size, F.lit(" min"))).otherwise("soon")
    return table(spark, sf_dir, "part").select("p_partkey", T.minutes(said).alias("minutes"))


@query("SELECT page_id, CASE WHEN html[1:4] = '%PDF' THEN 'pdf' ELSE 'html' END AS kind FROM pages")
def s16_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", records.kind_of(F.encode("html", "UTF-8")).alias("kind"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda w: w <> upper(w)) AS w FROM documents)
SELECT doc_id, len(w) >= 40 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '(?i)[aeiouy]'))) > 0.2 * len(w) AS unreadable FROM w""")
def s17_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.unreadable(F.col("text")).alias("unreadable"))


@query("SELECT event_id, 0 AS pos, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def s18_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of one item an event; the bodies of errors are no lists, so they are refused and not read as empty."""
    item = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    body = F.concat(F.lit('{"data": '), F.when(F.col("event_type") == "error", item).otherwise(F.concat(F.lit("["), item, F.lit("]"))), F.lit("}"))
    good, _ = records.feed_items(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", StructType.fromDDL("kind string, k long"))
    return good.select("event_id", "pos", "kind", "k")


@query("""WITH b AS (SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d') AS day FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), n AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT user_id, event_type, coalesce(day, '2024-01-15') AS first_seen FROM n LEFT JOIN b USING (user_id, event_type)""")
def s20_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item", F.struct("user_id", "event_type"))
    before = e.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).groupBy("item").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_seen"))
    return records.carried(e.select("item").distinct(), before, "item", "first_seen", F.lit("2024-01-15")).select("item.*", "first_seen")


@query("""SELECT s_suppkey, CASE WHEN NOT s_acctbal >= 0 THEN 'balance' ELSE '' END || CASE WHEN s_acctbal < 0 AND s_nationkey >= 20 THEN ',' ELSE '' END || CASE WHEN s_nationkey >= 20 THEN 'nation' ELSE '' END AS problems FROM supplier WHERE s_acctbal < 0 OR s_nationkey >= 20""")
def s21_rejected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = records.checked(table(spark, sf_dir, "supplier"), {"balance": F.col("s_acctbal") >= 0, "nation": F.col("s_nationkey") < 20})
    return bad.select("s_suppkey", F.array_join("problems", ",").alias("problems"))


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all('<table><tr><th>id</th><td>' || doc_id || '</td></tr><TR class=x><td>' || coalesce(lang, '-') || ' &amp; more</td></TR></table>', '(?is)<tr\b[^>]*>(.*?)</tr\s*>', 1) AS rows FROM documents)
SELECT doc_id, CAST(generate_subscripts(rows, 1) - 1 AS INTEGER) AS row, CASE WHEN generate_subscripts(rows, 1) = 1 THEN 'id|' || doc_id ELSE regexp_extract(unnest(rows), '<td>(.*) &amp;', 1) || ' & more' END AS cells FROM r""")
def s10_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>id</th><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr><TR class=x><td>"), F.coalesce("lang", F.lit("-")), F.lit(" &amp; more</td></TR></table>"))
    rows = records.table_rows(table(spark, sf_dir, "documents").select("doc_id", html.alias("html")))
    return rows.select("doc_id", "row", F.array_join("cells", "|").alias("cells"))
