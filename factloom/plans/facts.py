"""Queries over facts and claims: joins that find them, ladders that reconcile them, rules that judge by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import logic as L
from factloom.functions import text as T
from factloom.operators import cues, ladders
from factloom.operators import joins as J

from .registry import dealt, query, table


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def j1_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def j2_collect_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(one)).alias("own"))
    met = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    told = F.array_join(F.transform("own", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return met.select("o_orderkey", F.coalesce(F.size("own"), F.lit(0)).cast("long").alias("n"), F.coalesce(told, F.lit("")).alias("lines"))


@query("""WITH f AS (SELECT l_partkey, l_returnflag, l_linestatus, l_suppkey FROM lineitem)
SELECT l_partkey, l_returnflag, count(*) AS n_facts, count(DISTINCT l_linestatus) AS n_values, count(DISTINCT l_suppkey) AS n_sources,
  bool_or(EXISTS (SELECT 1 FROM f g WHERE g.l_partkey = f.l_partkey AND g.l_returnflag = f.l_returnflag AND g.l_linestatus <> f.l_linestatus AND g.l_suppkey <> f.l_suppkey)) AS conflicting
FROM f GROUP BY 1, 2""")
def a9_rival_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.rival_groups(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus", "l_suppkey")


@query("""WITH c AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_quantity > 25 THEN ' ' || lower(l_returnflag) ELSE l_returnflag END AS said, CASE l_suppkey % 7 WHEN 0 THEN 'official' WHEN 1 THEN 'secondary' WHEN 2 THEN 'lead' ELSE 'unverified' END AS k FROM lineitem),
e AS (SELECT l_partkey, lower(trim(said)) AS v, count(*) FILTER (k = 'official') AS o, count(*) FILTER (k = 'secondary') AS s, count(*) FILTER (k = 'lead') AS l, (list(said ORDER BY ord, said) FILTER (k = 'official'))[1] AS said FROM c GROUP BY 1, 2),
g AS (SELECT l_partkey, count(*) FILTER (o > 0) AS n_o, count(*) FILTER (o = 0 AND s > 0) AS n_x, count(*) FILTER (o > 0 AND s > 0) AS n_a, sum(l) AS n_l, min(CASE WHEN o > 0 THEN said END) AS said, string_agg(CASE WHEN o > 0 THEN said END, ' | ' ORDER BY said) AS rivals FROM e GROUP BY 1)
SELECT l_partkey, CASE WHEN n_o = 0 AND n_x = 0 THEN CASE WHEN n_l > 0 THEN 'LEADS_ONLY' ELSE 'UNSUPPORTED' END WHEN n_o = 0 THEN 'SECONDARY_ONLY' WHEN n_o > 1 THEN 'OFFICIAL_CONFLICT' WHEN n_x > 0 THEN 'OFFICIAL_CONTESTED' WHEN n_a > 0 THEN 'CORROBORATED' ELSE 'OFFICIAL' END AS state,
  CASE WHEN n_o = 1 THEN said END AS value, CASE WHEN n_o > 1 THEN rivals END AS conflict FROM g""")
def x7_reconcile_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("l_suppkey") % 7
    said = F.when(F.col("l_quantity") > 25, F.concat(F.lit(" "), F.lower("l_returnflag"))).otherwise(F.col("l_returnflag"))
    klass = F.when(by == 0, "official").when(by == 1, "secondary").when(by == 2, "lead").otherwise("unverified")
    claims = table(spark, sf_dir, "lineitem").select("l_partkey", said.alias("said"), klass.alias("klass"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return ladders.reconcile_claims(claims, ["l_partkey"], "said", "klass", "ord")


@query("""WITH a AS (SELECT o_orderkey, epoch_us(o_orderdate) AS value FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN epoch_us(o_orderdate) + 86400000000 ELSE epoch_us(o_orderdate) END AS new_value, o_orderkey % 11 = 0 AS revises FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority <> '5-LOW'),
m AS (SELECT o_orderkey, value, new_value, CASE WHEN a.o_orderkey IS NULL THEN 'ADDED' WHEN new_value IS NULL THEN 'UNCHANGED' WHEN value = new_value THEN 'CONFIRMED' WHEN revises THEN 'SUPERSEDED' ELSE 'CONFLICTED' END AS state FROM a FULL JOIN b USING (o_orderkey))
SELECT o_orderkey, state, CASE WHEN state IN ('ADDED', 'SUPERSEDED') THEN new_value WHEN state = 'CONFLICTED' THEN NULL ELSE value END AS effective, state = 'CONFLICTED' AS needs_review FROM m""")
def x10_merge_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders: urgent ones are announced for the first time, those of low priority are not announced again, the others are on both sides."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", D.micros(F.col("o_orderdate")).alias("value"))
    key, by = F.col("o_orderkey"), F.col("o_orderpriority")
    moved = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.col("value") + 86_400_000_000).otherwise(F.col("value"))
    new = o.where(by.isNull() | (by != "5-LOW")).select("o_orderkey", moved.alias("value"), (key % 11 == 0).alias("revises"))
    return ladders.merge_dated(o.where(~by.eqNullSafe(F.lit("1-URGENT"))).drop("o_orderpriority"), new, "o_orderkey")


@query("""SELECT p_partkey, CASE WHEN new IS NULL THEN 'KEPT' WHEN old IS NULL OR old = 0 THEN 'ADDED' WHEN old = new THEN 'CONFIRMED' ELSE 'UNDER_REVIEW' END AS decision
FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END AS old, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS new FROM part)""")
def x12_figure_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    old, new = F.when(key % 6 == 0, 0).otherwise(size), F.when(key % 4 == 0, F.lit(None)).when(key % 5 == 0, size + 1).otherwise(size)
    return table(spark, sf_dir, "part").select("p_partkey", ladders.figure(old, new).alias("decision"))


@query("""WITH a AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS new FROM lineitem WHERE l_suppkey % 2 = 1 GROUP BY 1)
SELECT l_orderkey, CASE WHEN labels IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'UNCHANGED' WHEN labels = new THEN 'CONFIRMED' ELSE 'CONFLICTED' END AS state FROM a FULL JOIN b USING (l_orderkey)""")
def x14_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda odd, name: table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 2 == odd).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias(name))
    state = F.when(F.col("labels").isNull(), "ADDED").when(F.col("new").isNull(), "UNCHANGED").when(F.col("labels") == F.col("new"), "CONFIRMED").otherwise("CONFLICTED")
    return half(0, "labels").join(half(1, "new"), "l_orderkey", "full").select("l_orderkey", state.alias("state"))


@query("""WITH o AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS seq, value, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'view' THEN 'AMEND' WHEN 'purchase' THEN 'SUPERSEDE' ELSE 'RETIRE' END AS kind, value > 5 AS active FROM events),
base AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS value FROM part),
live AS (SELECT * FROM o WHERE active AND kind <> 'RETIRE'),
made AS (SELECT k, min(m) AS made FROM (SELECT k, -1 AS m FROM base UNION ALL SELECT k, seq FROM live WHERE kind <> 'AMEND') GROUP BY 1),
fits AS (SELECT live.* FROM live JOIN made USING (k) WHERE kind <> 'AMEND' OR seq > made),
last AS (SELECT k, arg_max(value, seq) AS new, count(*) AS n, bool_or(kind = 'SUPERSEDE') AS s FROM fits GROUP BY 1)
SELECT k, CASE WHEN n IS NOT NULL THEN new ELSE value END AS value, coalesce(n, 0) AS n_applied, coalesce(s, false) AS superseded FROM base FULL JOIN last USING (k)""")
def x17_overlay_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    o = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("seq"), "value",
        F.when(kind == "click", "ADD").when(kind == "view", "AMEND").when(kind == "purchase", "SUPERSEDE").otherwise("RETIRE").alias("kind"), (F.col("value") > 5).alias("active"),
    )
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("value"))
    return ladders.apply_overlays(base, o, "k")


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n, CASE WHEN cents IS NULL THEN 'NO_ROWS' WHEN cents = CAST(round(o_totalprice * 100) AS BIGINT) THEN 'VERIFIED' ELSE 'MISMATCH' END AS state FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def a12_sum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("cents"))
    state = F.when(F.col("cents").isNull(), "NO_ROWS").when(F.col("cents") == cents("o_totalprice"), "VERIFIED").otherwise("MISMATCH")
    return table(spark, sf_dir, "orders").join(t, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey AS nation, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'building' ELSE 'MACHINERY' END AS tag FROM supplier), c AS (SELECT c_nationkey AS nation, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS tag FROM customer)
SELECT s_suppkey, s.nation, s.tag, count(c.nation) AS n FROM s LEFT JOIN c ON s.nation = c.nation AND (s.tag = '' OR c.tag = '' OR lower(s.tag) = lower(c.tag)) GROUP BY 1, 2, 3""")
def j7_wildcard_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("s_suppkey") % 3
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(by == 0, "").when(by == 1, "building").otherwise("MACHINERY").alias("tag"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("tag"))
    return J.wildcard_counts(c, s, "nation", "tag")


@query("""SELECT p.event_id, p.user_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def j21_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return J.latest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view")), ["user_id"], "ts", "last_view").select("event_id", "user_id", "last_view")


@query(r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, ' ' || trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) || ' ' AS p FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM d JOIN b ON p <> '  ' AND contains(t, p)""")
def j22_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.verbatim(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


#: field, cue, type; of a field the first cue that a text has counts.
CUES = (("licence", "license", "TEXT"), ("licence", "licensed under", "TEXT"), ("contact", "contact", "TEXT"), ("call", "call ", "INTEGER"), ("link", "http", "URL"), ("mail", "@", "TEXT"))
URL = r"""'(?i)https?://[^\s<>"'')\]]+'"""
WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CUE_ROWS = ", ".join(f"('{f}', {i}, '{c}', '{t}')" for i, (f, c, t) in enumerate(CUES))


_WINDOW = "substr(t, pos, 200)"


@query(f"""WITH c(field, ord, cue, kind) AS (VALUES {_CUE_ROWS}),
d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{WHITE}|{WHITE}$', '', 'g') AS t FROM documents),
m AS (SELECT doc_id, field, ord, cue, kind, t, instr(lower(t), cue) AS pos FROM d, c WHERE instr(lower(t), cue) > 0),
v AS (SELECT *, regexp_replace(regexp_replace(split_part(regexp_replace({_WINDOW}, '([.;])({WHITE})', '\\1' || chr(1)), chr(1), 1), '^{WHITE}', ''), '{WHITE}$', '') AS clause FROM m),
f AS (SELECT *, CASE kind WHEN 'URL' THEN nullif(rtrim(coalesce(nullif(regexp_extract({_WINDOW}, {URL}), ''), regexp_extract(t, {URL})), '.,);'), '')
  WHEN 'INTEGER' THEN CAST(CAST(replace(nullif(regexp_extract({_WINDOW}, '\\b([0-9][0-9,]{{0,9}})\\b'), ''), ',', '') AS BIGINT) AS VARCHAR) ELSE CASE WHEN length(clause) >= 8 THEN clause END END AS value FROM v)
SELECT doc_id, field, kind AS value_type, value, cue, CAST(pos AS INTEGER) AS pos, CAST(round(least(0.95, 0.4 + CASE WHEN kind IN ('DATE', 'URL', 'INTEGER') THEN 0.2 ELSE 0 END + CASE WHEN contains(cue, ' ') THEN 0.1 ELSE 0 END), 2) AS DOUBLE) AS confidence
FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) = 1""")
def x4_cue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed facts with values of the fields in CUES: what a corpus without notices holds."""
    own = {(field, kind): tuple(c for f, c, _ in CUES if f == field) for field, _, kind in CUES}
    facts = cues.typed_facts(table(spark, sf_dir, "documents"), tuple((*of, c) for of, c in own.items()))
    return facts.select("doc_id", "field", "value_type", "value", "cue", "pos", "confidence")


#: A notice of each order in several printed forms; some have no count, no last date, or a cue without a value.
_HELD = "o_orderdate + INTERVAL 90 DAY"


@query(f"""WITH n AS (SELECT o_orderkey, o_custkey AS c, o_orderkey AS o, CAST(o_orderdate AS DATE) AS last, CAST({_HELD} AS DATE) AS held, 1 + o_custkey % 9000 AS posts FROM orders),
f AS (
  SELECT o_orderkey, 'exam_name' AS field, 'TEXT' AS value_type, CASE WHEN o % 2 = 0 THEN 'Name of the exam: Test ' || o || '.' ELSE 'title of the exam - Test ' || o || ';' END AS value, CASE WHEN o % 2 = 0 THEN 'name of the exam' ELSE 'title of the exam' END AS cue FROM n
  UNION ALL SELECT o_orderkey, 'vacancies', 'INTEGER', CAST(posts AS VARCHAR), CASE c % 3 WHEN 1 THEN 'total vacancies' ELSE 'number of posts' END FROM n WHERE c % 3 > 0
  UNION ALL SELECT o_orderkey, 'application_last_date', 'DATE', strftime(last, '%Y-%m-%d'), CASE o % 4 WHEN 0 THEN 'last date' WHEN 1 THEN 'closing date' ELSE 'apply by' END FROM n WHERE o % 4 < 3
  UNION ALL SELECT o_orderkey, 'exam_date', 'DATE', strftime(held, '%Y-%m-%d'), CASE WHEN o % 2 = 0 THEN 'held on' ELSE 'exam date' END FROM n
  UNION ALL SELECT o_orderkey, 'official_website', 'URL', 'https://b' || c || '.example.org/n?o=' || o, 'official site' FROM n WHERE c % 5 > 0
)
SELECT o_orderkey, field, value_type, value, cue, CAST(round(0.4 + CASE value_type WHEN 'TEXT' THEN 0 ELSE 0.2 END + CASE WHEN contains(cue, ' ') THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS confidence FROM f""")
def x4_notice_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed facts of the 18 fields, from a notice of each order in several printed forms."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    last, held, posts = F.col("o_orderdate"), F.expr(_HELD), 1 + c % 9000
    says = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    name = F.when(o % 2 == 0, says("Name of the exam: Test ", o.cast("string"), ". ")).otherwise(says("title of the exam - Test ", o.cast("string"), "; "))
    count = F.when(c % 3 == 1, says("Total vacancies: ", F.format_number(posts, 0), ". ")).when(c % 3 == 2, says("The NUMBER OF POSTS is ", posts.cast("string"), ". ")).otherwise("Number of  posts not yet known. ")
    closes = F.when(o % 4 == 0, says("Last date ", F.date_format(last, "dd/MM/yyyy"), ". ")).when(o % 4 == 1, says("The closing date is ", F.date_format(last, "d MMMM yyyy"), ". ")).when(o % 4 == 2, says("Apply by ", F.date_format(last, "MMM d, yyyy"), ". ")).otherwise("")
    takes = F.when(o % 2 == 0, says("It is held on ", F.date_format(held, "d-M-yyyy"), ". ")).otherwise(says("Exam date ", F.date_format(held, "dd.MM.yyyy"), ". "))
    site = F.when(c % 5 > 0, says("Official site: https://b", c.cast("string"), ".example.org/n?o=", o.cast("string"), ". ")).otherwise("")
    notices = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").select("o_orderkey", says("Notice ", o.cast("string"), ". ", name, takes, closes, count, site, "Admit card and result: later.").alias("text"))
    return cues.typed_facts(notices, key="o_orderkey").select("o_orderkey", "field", "value_type", "value", "cue", "confidence")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(start AS INTEGER) AS start, substr(t, start + 1, 320) AS piece FROM (SELECT doc_id, t, unnest(generate_series(0, greatest(0, length(t) - 161), 160)) AS start FROM d)""")
def n8_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.windows(F.coalesce("text", F.lit("")))).alias("w")).select("doc_id", "w.start", "w.piece")


@query("""SELECT doc_id, array_to_string(list_distinct_in_order, ' ') AS figures FROM (SELECT doc_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_in_order
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+') AS f FROM documents))""")
def f22_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.figures(F.coalesce("text", F.lit(""))), " ").alias("figures"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(0, year(l_shipdate) - year(o_orderdate) - CASE WHEN month(l_shipdate) * 100 + day(l_shipdate) < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END) AS INTEGER) AS years
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def f7_age_in_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.age(F.col("o_orderdate"), F.col("l_shipdate")).cast("int").alias("years"))


PROFILE = """p AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 18 + c_custkey % 30 END AS age, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey % 4 END AS level FROM customer)"""
POSTS = """post AS (SELECT o_orderkey, o_custkey, 20 AS low, CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '5-LOW' THEN NULL ELSE 40 END AS high, o_orderkey % 4 AS need FROM orders)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 13 != 0, 18 + key % 30).alias("age"), F.when(key % 7 != 0, F.col("c_nationkey") % 4).alias("level"))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("o_orderpriority")
    high = F.when(by == "1-URGENT", 30).when(by == "5-LOW", F.lit(None)).otherwise(40)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit(20).alias("low"), high.alias("high"), (F.col("o_orderkey") % 4).alias("need"))


def _verdict(level: str = "level"):
    age = L.all_of(L.judge(F.col("age") >= F.col("low")), F.when(F.col("high").isNull(), L.OK).otherwise(L.judge(F.col("age") <= F.col("high"))))
    return L.all_of(age, L.judge(F.col(level) >= F.col("need")))


AGE_SQL = "CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age < low OR (high IS NOT NULL AND age > high) THEN 'FAIL' ELSE 'OK' END"
ONE_SQL = "CASE WHEN a = 'FAIL' OR q = 'FAIL' THEN 'FAIL' WHEN a = 'UNKNOWN' OR q = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'OK' END"


@query(f"""WITH {PROFILE}, {POSTS}, e AS (SELECT o_orderkey, c_custkey, {AGE_SQL} AS a, CASE WHEN level IS NULL THEN 'UNKNOWN' WHEN level >= need THEN 'OK' ELSE 'FAIL' END AS q FROM post JOIN p ON o_custkey = c_custkey)
SELECT o_orderkey, c_custkey, {ONE_SQL} AS verdict FROM e""")
def r1_post_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).join(_profiles(spark, sf_dir), "c_custkey").select("o_orderkey", "c_custkey", _verdict().alias("verdict"))


@query(f"""WITH {PROFILE}, {POSTS}, e AS (SELECT c_custkey, o_orderkey, {AGE_SQL} AS a, CASE WHEN level IS NULL THEN 'UNKNOWN' WHEN level >= need THEN 'OK' ELSE 'FAIL' END AS q FROM p LEFT JOIN post ON o_custkey = c_custkey),
g AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderkey IS NOT NULL AND {ONE_SQL} = 'OK') AS ok, count(*) FILTER (o_orderkey IS NOT NULL AND {ONE_SQL} = 'UNKNOWN') AS unknown FROM e GROUP BY 1)
SELECT c_custkey, n, CASE WHEN n = 0 THEN 'NOT_EVALUABLE' WHEN ok > 0 THEN 'ELIGIBLE' WHEN unknown > 0 THEN 'CONDITIONAL' ELSE 'INELIGIBLE' END AS diagnostic FROM g""")
def r3_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _profiles(spark, sf_dir).join(_posts(spark, sf_dir), "c_custkey", "left").withColumn("v", F.when(F.col("o_orderkey").isNotNull(), _verdict()))
    g = each.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("v") == L.OK).alias("ok"), F.count_if(F.col("v") == L.UNKNOWN).alias("unknown"))
    return g.select("c_custkey", "n", F.when(F.col("n") == 0, "NOT_EVALUABLE").when(F.col("ok") > 0, "ELIGIBLE").when(F.col("unknown") > 0, "CONDITIONAL").otherwise("INELIGIBLE").alias("diagnostic"))


@query(f"""WITH {PROFILE}, {POSTS}, t AS (SELECT o_orderkey, age, low, high, need, unnest(CASE WHEN level IS NULL THEN [0, 1, 2, 3] ELSE [level] END) AS level FROM post JOIN p ON o_custkey = c_custkey),
e AS (SELECT o_orderkey, {AGE_SQL} AS a, CASE WHEN level >= need THEN 'OK' ELSE 'FAIL' END AS q FROM t), v AS (SELECT o_orderkey, {ONE_SQL} AS verdict FROM e)
SELECT o_orderkey, count(DISTINCT verdict) = 1 AS settled, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) ELSE 'UNKNOWN' END AS verdict FROM v GROUP BY 1""")
def r4_probe_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _posts(spark, sf_dir).join(_profiles(spark, sf_dir), "c_custkey")
    tried = met.withColumn("try", F.explode(F.when(F.col("level").isNull(), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.col("level").cast("int"))))).withColumn("v", _verdict("try"))
    same = F.min("v") == F.max("v")
    return tried.groupBy("o_orderkey").agg(same.alias("settled"), F.when(same, F.min("v")).otherwise(L.UNKNOWN).alias("verdict"))
