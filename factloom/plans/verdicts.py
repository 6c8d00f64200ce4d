"""Queries that count, extract and judge: coverage, passages, completeness, gates, states, reviews, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import logic as L
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators import extract as X
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import ladders, stateful
from factloom.operators import snapshots as S

from .facts import _CUE_ROWS, CUES, WHITE
from .ranking import _KIND_ROWS, KINDS, _of
from .reads import _HOST
from .registry import query, table


@query("""SELECT n_regionkey, count(*) AS n, count(o) AS covered, round(100.0 * count(o) / count(*), 4) AS percent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderstatus = 'O') ON o = c_custkey GROUP BY 1""")
def a8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("o")).distinct()
    met = table(spark, sf_dir, "customer").join(had, "c_custkey", "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.count("o").alias("covered"), F.round(F.lit(100.0) * F.count("o") / F.count("*"), 4).alias("percent"))


@query("""SELECT l_partkey, lower(l_returnflag) AS v, count(*) FILTER (l_suppkey % 5 = 0) AS official, count(*) FILTER (l_suppkey % 5 IN (1, 2)) AS secondary, count(*) FILTER (l_suppkey % 5 > 2) AS unverified FROM lineitem GROUP BY 1, 2""")
def a10_claims_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("l_suppkey") % 5
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.lower(F.trim("l_returnflag")).alias("v")).agg(F.count_if(by == 0).alias("official"), F.count_if(by.isin(1, 2)).alias("secondary"), F.count_if(by > 2).alias("unverified"))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS m, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = m AND total = CAST(floor(o_totalprice) AS BIGINT) % 150 THEN CAST(total AS BIGINT) END AS printed_total FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def a13_printed_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.cell_count(F.col("l_quantity").cast("long").cast("string"))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count(cells).alias("read"), F.count_distinct("l_linenumber").alias("m"), F.sum(cells).alias("total"))
    whole = (F.col("n") == F.col("m")) & (F.col("n") == F.col("read")) & (F.col("total") == F.floor("o_totalprice") % 150)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(t, "o_orderkey", "left").select("o_orderkey", F.when(whole, F.col("total")).alias("printed_total"))


@query(f"""WITH k(event_type, weight, half_life, strength) AS (VALUES {_KIND_ROWS})
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(sum(CAST(weight AS DOUBLE) * pow(2.0, -((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9) / CAST(half_life AS DOUBLE)) * CAST(strength AS DOUBLE)), 4) AS score, count(*) AS hits FROM events JOIN k USING (event_type) GROUP BY 1""")
def a14_decayed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, hours = F.col("event_type"), (D.micros(F.lit("2024-02-01")) - D.micros(F.col("ts"))) / 3.6e9
    one = _of(kind, 0) * D.decay(hours, _of(kind, 1)) * _of(kind, 2)
    e = table(spark, sf_dir, "events").where(kind.isin(*KINDS)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("k").agg(F.round(F.sum(one), 4).alias("score"), F.count("*").alias("hits"))


@query("""WITH s AS (SELECT o_custkey, round(sum(o_totalprice) / 1e5, 4) AS score FROM orders GROUP BY 1) SELECT o_custkey, round(100 * score / greatest((SELECT max(score) FROM s), 5.0), 2) AS normalised FROM s""")
def a16_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") / 1e5, 4).alias("score"))
    top = F.broadcast(s.agg(F.greatest(F.max("score"), F.lit(5.0)).alias("top")))  # one row
    return s.crossJoin(top).select("o_custkey", F.round(100 * F.col("score") / F.col("top"), 2).alias("normalised"))


_ASKED = ("example", "en", "news", "page")


@query(f"""SELECT {_HOST} AS host, round(sum(({' + '.join(f"CAST(contains(lower(url), '{w}') AS INT)" for w in _ASKED)}) / {len(_ASKED)}.0 + CASE WHEN '.' || {_HOST} LIKE '%.example.org' THEN 0.25 ELSE 0 END), 4) AS vote FROM pages GROUP BY 1""")
def a17_host_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    held = sum((F.contains(F.lower(u), F.lit(w)).cast("int") for w in _ASKED), F.lit(0))
    bonus = F.when(U.trust(u) == "official", 0.25).otherwise(0.0)
    return table(spark, sf_dir, "pages").groupBy(U.host(u).alias("host")).agg(F.round(F.sum(held / F.lit(float(len(_ASKED))) + bonus), 4).alias("vote"))


_MISSING = "list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'segment' END, CASE WHEN c_custkey % 97 = 5 THEN 'name' END], lambda x: x IS NOT NULL)"


@query(f"SELECT c_nationkey, array_to_string(list_sort(list_distinct(flatten(list({_MISSING})))), ',') AS missing FROM customer GROUP BY 1")
def a19_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "balance"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "segment"), F.when(F.col("c_custkey") % 97 == 5, "name")))
    each = table(spark, sf_dir, "customer").select("c_nationkey", F.explode_outer(told).alias("f"))
    return each.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("f")), ",").alias("missing"))


TREE = "t AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    )


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT node, node AS root, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.root, w.level + 1 FROM t JOIN w ON t.parent = w.node)
SELECT root, CAST(max(level) AS INTEGER) AS depth, count(*) FILTER (node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)) AS leaves FROM w GROUP BY 1""")
def a21_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    inner = tree.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    return G.ancestors(tree).join(inner, "node", "left").groupBy("root").agg(F.max("level").alias("depth"), F.count_if(F.col("inner").isNull()).alias("leaves"))


@query("""SELECT l_partkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') - count(*) FILTER (l_linestatus = 'O') AS left_over FROM lineitem GROUP BY 1, 2 HAVING left_over > 0""")
def a22_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("l_linestatus") == s)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg((n("F") - n("O")).alias("left_over")).where("left_over > 0")


_ESTATE = rf"regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1)"


@query(f"WITH u AS (SELECT page_id, {_ESTATE} AS estate FROM pages), e AS (SELECT estate, count(*) AS owned FROM u GROUP BY 1) SELECT page_id, estate, owned FROM u JOIN e USING (estate)")
def j8_by_estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", U.estate(F.col("url")).alias("estate"))
    return u.join(u.groupBy("estate").agg(F.count("*").alias("owned")), "estate").select("page_id", "estate", "owned")


@query(f"WITH u AS (SELECT page_id, length(html) AS size, {_ESTATE} AS estate FROM pages) SELECT estate, arg_max(page_id, page_id) AS latest, CAST(arg_max(size, page_id) AS INTEGER) AS size FROM u GROUP BY 1")
def j9_latest_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"), U.estate(F.col("url")).alias("estate"))
    return u.groupBy("estate").agg(F.max("page_id").alias("latest"), F.max_by("size", "page_id").alias("size"))


@query("""WITH i AS (SELECT coalesce(CASE WHEN event_type <> 'view' THEN user_id END, CAST(json_extract(props, '$.k') AS BIGINT)) AS key FROM events) SELECT c_custkey, count(key) AS n FROM customer LEFT JOIN i ON key = c_custkey GROUP BY 1""")
def j17_coalesced_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("event_type") != "view", F.col("user_id")), F.get_json_object("props", "$.k").cast("long"))
    n = table(spark, sf_dir, "events").groupBy(key.alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH q AS (SELECT DISTINCT substr(p_name, 2, 1 + p_size % 5) AS wanted FROM part) SELECT DISTINCT p_name AS item, wanted FROM part, q WHERE wanted <> '' AND contains(p_name, wanted)""")
def j18_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return J.containing(p.select(F.col("p_name").alias("item")), p.select(F.substring("p_name", F.lit(2), 1 + F.col("p_size") % 5).alias("wanted")), "item", "wanted")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j23_cited_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(bad, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT o_orderkey, CAST(days AS INTEGER) AS days, strftime(CAST(o_orderdate AS DATE) - CAST(days AS INTEGER), '%Y-%m-%d') AS due FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000, (VALUES (7), (3), (1)) w(days) WHERE o_orderstatus = 'O'""")
def j24_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    dates = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(tracked, "o_custkey", "left_semi").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    each = dates.withColumn("days", F.explode(F.array(*map(F.lit, (7, 3, 1)))))
    return each.select("o_orderkey", "days", F.date_format(F.expr("date_sub(day, days)"), "yyyy-MM-dd").alias("due"))


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events), l AS (SELECT user_id, k FROM e WHERE event_type = 'click'), r AS (SELECT user_id, k FROM e WHERE event_type = 'view')
SELECT user_id, k, 'local' AS source FROM l UNION ALL SELECT user_id, k, 'remote' FROM r ANTI JOIN l USING (user_id, k)""")
def j26_local_and_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").distinct()
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "k", F.lit(name).alias("source"))
    return S.prefer(side("click", "local"), side("view", "remote"), ["user_id", "k"])


@query("SELECT n_nationkey, r_name AS parent, count(s_suppkey) AS children FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def j27_parents_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("children"))
    up = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    return table(spark, sf_dir, "nation").join(up, "n_regionkey").join(kids, "n_nationkey", "left").select("n_nationkey", "parent", F.coalesce("children", F.lit(0)).alias("children"))


@query(f"""WITH c(field, ord, cue, kind) AS (VALUES {_CUE_ROWS}), m AS (SELECT doc_id, field, ord, cue, instr(lower(text), cue) AS pos FROM documents, c WHERE instr(lower(text), cue) > 0)
SELECT doc_id, field, cue, CAST(pos AS INTEGER) AS pos FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) = 1""")
def n5_first_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field the first cue, in the order of the fixed cue table, that a text has, and where."""
    low, by = F.lower("text"), {}
    for field, cue, _ in CUES:
        by.setdefault(field, []).append(F.when(F.contains(low, F.lit(cue)), F.struct(F.lit(field).alias("field"), F.lit(cue).alias("cue"), F.instr(low, cue).alias("pos"))))
    first = F.array_compact(F.array(*[F.coalesce(*cues) for cues in by.values()]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(first).alias("x")).select("doc_id", "x.field", "x.cue", F.col("x.pos").cast("int").alias("pos"))


FIELDS = (
    X.Field("licence", "(?i)licen[sc]e", "(?i)released|version|work", "(?i)unless", "(?i)apache|mit|general public"),
    X.Field("contact", "@", "(?i)mail|contact|call", "(?i)noreply", "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+[A-Za-z]"),
    X.Field("phone", "[+(][0-9]", "(?i)call|phone|mail", "(?i)card", "[+(][0-9][0-9 ()-]{7,}[0-9]"),
)
_PIECES = """d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, unnest(generate_series(0, greatest(0, length(t) - 161), 160)) AS start FROM d),
w AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CASE WHEN start = 0 THEN '' ELSE regexp_extract(substr(t, greatest(1, start - 319), least(320, start)), '\\S*\\z') END || substr(t, start + 1, 320) || regexp_extract(substr(t, start + 321, 320), '\\A\\S*') AS piece FROM s)"""
_EACH = " UNION ALL ".join(
    f"SELECT doc_id, start, piece, '{f.name}' AS field, greatest(0.0, 1 + 0.6 * len(regexp_extract_all(piece, '{f.support}')) - 1.2 * len(regexp_extract_all(piece, '{f.against}')))::DOUBLE AS score, regexp_extract(piece, '{f.value}') AS value FROM w WHERE regexp_matches(piece, '{f.anchor}')"
    for f in FIELDS
)
FOUND = f"""{_PIECES}, x AS ({_EACH}), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, start) AS place FROM x QUALIFY place <= 25),
e AS (SELECT * FROM p WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY place) = 1)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return X.extract(docs, FIELDS, "doc_id", "text")


@query(f"WITH {FOUND} SELECT doc_id, field, CAST(place AS INTEGER) AS place, start, round(score, 2) AS score FROM p")
def n6_best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return X.best_passages(docs, FIELDS, "doc_id", "text").select("doc_id", "field", "place", "start", F.round("score", 2).alias("score"))


@query(f"WITH {FOUND} SELECT doc_id, count(*) AS found, 3 - count(*) AS missing FROM e GROUP BY 1")
def x2_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all the fields each document gave, of those that gave any."""
    return _found(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("found"), (F.lit(len(FIELDS)) - F.count("*")).alias("missing"))


@query(f"WITH {FOUND} SELECT doc_id, field, value, start, round(score, 2) AS score, round(least(1.0, score / 3), 4) AS confidence FROM e")
def x1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all documents, each by its best passage."""
    return _found(spark, sf_dir).drop("piece")


_SQUASHED = f"trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g'))"
_SAME = " OR ".join(f"(field = '{f.name}' AND regexp_extract(sentence, '{f.value}') = value)" for f in FIELDS)


@query(f"""WITH {FOUND}, q AS (SELECT doc_id, field, value, piece, unnest(list_transform(string_split(regexp_replace(piece, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(regexp_replace(z, '{WHITE}', ' ', 'g')))) AS sentence FROM e),
b AS (SELECT doc_id, field, arg_min(sentence, (length(sentence), sentence)) AS span FROM q WHERE sentence <> '' AND ({_SAME}) GROUP BY 1, 2)
SELECT doc_id, field, coalesce(span, trim(regexp_replace(piece, '{WHITE}', ' ', 'g'))) AS span FROM e LEFT JOIN b USING (doc_id, field)""")
def x3_narrowest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.narrowest(_found(spark, sf_dir), FIELDS, "doc_id").select("doc_id", "field", "span")


@query(f"""WITH d AS (SELECT doc_id, n_chars, trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')) AS t FROM documents), e AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS cited, trim(substr(t, 11, 60)) AS span FROM d)
SELECT e.doc_id, coalesce(span <> '' AND contains(d.t, span), false) AS verified FROM e LEFT JOIN d ON d.doc_id = cited""")
def x6_verify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.squash(F.coalesce("text", F.lit(""))).alias("t"))
    e = d.select(F.col("doc_id").alias("claim"), F.when(F.col("n_chars") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("doc_id"), F.trim(F.substring("t", 11, 60)).alias("span"))
    return e.join(d.select("doc_id", "t"), "doc_id", "left").select(F.col("claim").alias("doc_id"), F.coalesce((F.col("span") != "") & F.contains("t", "span"), F.lit(False)).alias("verified"))


@query(r"""WITH t AS (SELECT DISTINCT CASE WHEN p_size > 30 THEN lower(p_brand) || ' ' || p_name ELSE lower(p_type) || ' ' || p_name END AS name FROM part), s AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
w AS (SELECT name, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS words FROM t), v AS (SELECT list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS words FROM s)
SELECT name FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE len(list_intersect(w.words, v.words)) = least(len(w.words), len(v.words)) AND (len(w.words) = len(v.words) OR least(len(w.words), len(v.words)) >= 2) AND len(list_intersect(w.words, v.words)) > 0)""")
def x13_unsupported_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics whose words no source has: those of large parts are named by their brand, which no source prints."""
    p = table(spark, sf_dir, "part")
    topics = p.select(F.concat_ws(" ", F.when(F.col("p_size") > 30, F.lower("p_brand")).otherwise(F.lower("p_type")), F.col("p_name")).alias("name"))
    return J.best_names(topics, p.select(F.concat_ws(" ", "p_name", "p_type").alias("name")), "name").where("verdict = 'UNCHANGED'").select("name")


@query("""WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS seq, value, CASE event_type WHEN 'click' THEN 'ADD' WHEN 'error' THEN 'RETIRE' ELSE 'AMEND' END AS kind FROM events UNION ALL SELECT p_partkey, -1, CAST(p_size AS DOUBLE), 'ADD' FROM part),
g AS (SELECT *, max(CASE WHEN kind = 'RETIRE' THEN seq END) OVER (PARTITION BY k) AS gone FROM e), m AS (SELECT *, min(CASE WHEN kind = 'ADD' THEN seq END) OVER (PARTITION BY k) AS made FROM g WHERE gone IS NULL OR seq > gone)
SELECT k, arg_max(value, seq) AS value, count(*) AS n_applied FROM m WHERE seq >= made AND kind <> 'RETIRE' GROUP BY 1""")
def x19_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    log = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("seq"), "value", F.when(kind == "click", "ADD").when(kind == "error", "RETIRE").otherwise("AMEND").alias("kind"))
    return ladders.apply_revisions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("value")), log, "k")


_FIELD_ROWS = """f AS (SELECT c_custkey, 'account' AS section, CASE WHEN c_acctbal < 0 THEN 'NEEDS_REVIEW' WHEN c_acctbal < 500 THEN 'EXTRACTION_FAILED' ELSE 'VERIFIED_AVAILABLE' END AS state FROM customer
UNION ALL SELECT c_custkey, 'account', CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'NOT_APPLICABLE' ELSE 'VERIFIED_AVAILABLE' END FROM customer
UNION ALL SELECT c_custkey, 'activity', CASE WHEN o IS NULL THEN 'SOURCE_NOT_FOUND_AFTER_SEARCH' WHEN o = 0 THEN 'NOT_YET_PUBLISHED' ELSE 'VERIFIED_AVAILABLE' END FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
_STATE_LIST = "[" + ", ".join(f"'{s}'" for s in ladders.STATES) + "]"


@query(f"WITH {_FIELD_ROWS} SELECT c_custkey, section, arg_min(state, list_position({_STATE_LIST}, state)) AS state, count(*) FILTER (state = 'VERIFIED_AVAILABLE') AS verified, count(*) AS fields FROM f GROUP BY 1, 2")
def x21_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    done = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("o"))
    balance = F.when(F.col("c_acctbal") < 0, "NEEDS_REVIEW").when(F.col("c_acctbal") < 500, "EXTRACTION_FAILED").otherwise("VERIFIED_AVAILABLE")
    segment = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "NOT_APPLICABLE").otherwise("VERIFIED_AVAILABLE")
    orders = F.when(F.col("o").isNull(), "SOURCE_NOT_FOUND_AFTER_SEARCH").when(F.col("o") == 0, "NOT_YET_PUBLISHED").otherwise("VERIFIED_AVAILABLE")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), x.alias("state")) for s, x in (("account", balance), ("account", segment), ("activity", orders))]))
    rows = c.join(done, "c_custkey", "left").select("c_custkey", each.alias("x")).select("c_custkey", "x.*")
    return ladders.weakest(rows, ["c_custkey", "section"])


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_discount > 0.09) AS review FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, list_filter([CASE WHEN coalesce(n, 0) = 0 THEN 'required' END, CASE WHEN coalesce(review, true) THEN 'review' END, CASE WHEN c_acctbal < 0 THEN 'mismatch' END, CASE WHEN o_orderstatus = 'P' THEN 'unpublished' END], lambda x: x IS NOT NULL) AS b FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN len(b) = 0 THEN 'PASS' ELSE 'BLOCK' END AS decision, array_to_string(b, ',') AS blockers FROM b""")
def x22_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_discount") > 0.09).alias("review"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    records = table(spark, sf_dir, "orders").join(c, "o_custkey").join(lines, "o_orderkey", "left")
    return ladders.gate(records, "o_orderkey", required=F.coalesce("n", F.lit(0)) == 0, review=F.col("review"), mismatch=F.col("c_acctbal") < 0, unpublished=F.col("o_orderstatus") == "P")


CORE = "n AS (SELECT event_id, user_id, CAST(round(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, CAST(json_extract(props, '$.k') AS BIGINT) DESC, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {CORE}, f AS (SELECT user_id, i, event_id, CASE WHEN size <= 200 THEN size ELSE 0 END AS used, size <= 200 AS taken FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.i, n.event_id, f.used + CASE WHEN f.used + n.size <= 200 THEN n.size ELSE 0 END, f.used + n.size <= 200 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, event_id, taken FROM f""")
def x46_fact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each sheet: core ones first, then the most relevant, as far as the budget goes; what does not fit is passed over."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").alias("core"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.round("value").cast("long").alias("size"))
    return stateful.fold(e, "user_id", [F.desc("core"), F.desc("k"), F.col("event_id")], stateful.budget(200), ["size"], "taken", "boolean").select("user_id", "event_id", "taken")


PROVED = """q AS (SELECT event_id, user_id, k, CAST(floor(value) AS INTEGER) AS v, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'file:x' ELSE 'https://a.example.org/' END AS url, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'the value is ' || (CAST(floor(value) AS INTEGER) + 1000) ELSE 'the value is ' || CAST(floor(value) AS INTEGER) END AS quote, event_type FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
s AS (SELECT event_id, user_id, CASE WHEN NOT coalesce(starts_with(url, 'http'), false) AND quote IS NULL THEN 'UNVERIFIED' WHEN k % 11 = 0 THEN 'UNSUPPORTED' WHEN k % 13 = 0 THEN 'SUPERSEDED' WHEN event_type = 'error' THEN 'UNDER_VERIFICATION' WHEN NOT coalesce(starts_with(url, 'http'), false) OR (v % 2 = 0 AND quote IS NULL) THEN 'UNVERIFIED' WHEN coalesce(contains(quote, CAST(v AS VARCHAR)), false) THEN 'VERIFIED' ELSE 'UNSUPPORTED' END AS state FROM q)"""


def _proved(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.floor("value").cast("int")
    quote = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("the value is "), (v + 1000).cast("string"))).otherwise(F.concat(F.lit("the value is "), v.cast("string")))
    url = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "file:x").otherwise("https://a.example.org/")
    state = ladders.fact_state(k % 11 == 0, k % 13 == 0, F.col("event_type") != "error", url, F.when(v % 2 != 0, v), quote, v.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", state.alias("state"))


@query(f"WITH {PROVED} SELECT event_id, state FROM s")
def x48_fact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proved(spark, sf_dir).select("event_id", "state")


@query(f"WITH {PROVED} SELECT user_id, CASE WHEN bool_and(state = 'VERIFIED') THEN 'VERIFIED' WHEN bool_or(state = 'VERIFIED') THEN 'PARTLY_VERIFIED' ELSE 'NOT_VERIFIED' END AS answer FROM s GROUP BY 1")
def x48_answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.col("state") == "VERIFIED"
    return _proved(spark, sf_dir).groupBy("user_id").agg(F.when(F.bool_and(sure), "VERIFIED").when(F.bool_or(sure), "PARTLY_VERIFIED").otherwise("NOT_VERIFIED").alias("answer"))


@query(f"""WITH d AS (SELECT doc_id, {_SQUASHED} AS t FROM documents), p AS (SELECT doc_id, t, substr(t, 5, 40) AS quote, regexp_extract(t, '[0-9]+') AS value FROM d)
SELECT doc_id, length(quote) >= 8 AND contains(t, quote) AND value <> '' AND list_contains(regexp_extract_all(quote, '[0-9]+'), value) AS accepted FROM p""")
def x49_quoted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals (a quote of each text, and the text's first figure) that their quote bears out."""
    p = table(spark, sf_dir, "documents").select("doc_id", T.squash(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", "t", F.substring("t", 5, 40).alias("quote"), F.regexp_extract("t", "[0-9]+", 0).alias("value"))
    figures = F.regexp_extract_all("quote", F.lit("[0-9]+"), F.lit(0))
    return p.select("doc_id", ((F.length("quote") >= 8) & F.contains("t", "quote") & (F.col("value") != "") & F.array_contains(figures, F.col("value"))).alias("accepted"))


@query("""WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id, lower(trim(coalesce(text, ''))) ORDER BY turn) AS nth FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'EMPTY' WHEN length(t) < 15 THEN 'SHORT' WHEN nth > 1 THEN 'REPEATED' WHEN NOT regexp_matches(t, '[.?!]') THEN 'UNFINISHED' ELSE '' END AS dropped FROM q""")
def x50_question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", F.lower(F.trim(t))).orderBy("turn"))
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", t.alias("t"), nth.alias("nth"))
    why = F.when(F.trim("t") == "", "EMPTY").when(F.length("t") < 15, "SHORT").when(F.col("nth") > 1, "REPEATED").when(~F.col("t").rlike("[.?!]"), "UNFINISHED").otherwise("")
    return q.select("conv_id", "turn", why.alias("dropped"))


@query("""WITH f AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, arg_min(CASE WHEN value > 30 THEN 'FOUND' WHEN value > 5 THEN 'NEEDS_REVIEW' ELSE 'NOT_PUBLISHED' END, event_id) AS status, min(event_id) % 3 > 0 AS cited FROM events GROUP BY 1, 2),
r AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'error') AS no, count(*) FILTER (event_type = 'purchase') AS yes FROM events WHERE value > 3 GROUP BY 1, 2)
SELECT user_id, k, CASE WHEN no > 0 THEN 'NOT_EXTRACTED' WHEN yes > 0 AND cited AND status IN ('FOUND', 'NEEDS_REVIEW') THEN 'FOUND' ELSE status END AS status FROM f LEFT JOIN r USING (user_id, k)""")
def x51_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    status = F.when(v > 30, "FOUND").when(v > 5, "NEEDS_REVIEW").otherwise("NOT_PUBLISHED")
    fields = e.groupBy("user_id", "k").agg(F.min_by(status, "event_id").alias("status"), (F.min("event_id") % 3 > 0).alias("cited"))
    said = F.when(F.col("event_type") == "error", "WITHHOLD").when(F.col("event_type") == "purchase", "APPROVE").otherwise("NOTE")
    reviews = e.select("user_id", "k", said.alias("decision"), F.when(v > 3, "someone").otherwise(" ").alias("reviewer"))
    return ladders.reviewed(fields, reviews, ["user_id", "k"])


_RULE = "CASE WHEN l_quantity < 3 THEN 0 WHEN l_quantity < 10 THEN 1 ELSE 2 END"


@query(f"WITH g AS (SELECT l_orderkey, l_returnflag, max({_RULE}) AS r FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, (['FAIL', 'UNKNOWN', 'OK'])[min(r) + 1] AS verdict FROM g GROUP BY 1")
def r2_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of an order must hold, and of each group any rule: two aggregates over ranked verdicts."""
    q = F.col("l_quantity")
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max(F.when(q < 3, 0).when(q < 10, 1).otherwise(2)).alias("r"))
    return groups.groupBy("l_orderkey").agg(F.element_at(F.array(F.lit(L.FAIL), F.lit(L.UNKNOWN), F.lit(L.OK)), F.min("r") + 1).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 1000 AND c_nationkey < 20 THEN 'ELIGIBLE' WHEN c_acctbal < 0 OR c_nationkey = 24 THEN 'NOT_ELIGIBLE' ELSE 'NOT_DETERMINED' END AS state FROM customer""")
def r5_post_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("c_acctbal") < 0, L.FAIL).when(F.col("c_acctbal") < 1000, L.UNKNOWN).otherwise(L.OK)
    level = F.when(F.col("c_nationkey") == 24, L.FAIL).when(F.col("c_nationkey") >= 20, L.UNKNOWN).otherwise(L.OK)
    both = L.all_of(age, level)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(both == L.OK, "ELIGIBLE").when(both == L.FAIL, "NOT_ELIGIBLE").otherwise("NOT_DETERMINED").alias("state"))


@query("""WITH c AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS one FROM supplier WHERE s_acctbal > 8000 GROUP BY 1)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NO_CATEGORY' WHEN n IS NULL THEN 'NO_ROW_FOR_CATEGORY' WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN c_acctbal >= 0 AND n = 1 THEN one END AS row_id FROM customer LEFT JOIN c ON s_nationkey = c_nationkey""")
def r6_cutoff_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("one"))
    status = F.when(F.col("c_acctbal") < 0, "NO_CATEGORY").when(F.col("n").isNull(), "NO_ROW_FOR_CATEGORY").when(F.col("n") == 1, "MATCHED").otherwise("AMBIGUOUS")
    return table(spark, sf_dir, "customer").join(rows, "c_nationkey", "left").select("c_custkey", status.alias("status"), F.when(status == "MATCHED", F.col("one")).alias("row_id"))


@query("""WITH u AS (SELECT s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS post, s_suppkey, s_acctbal > 2000 AS verified FROM supplier),
r AS (SELECT c_custkey, coalesce(min(CASE WHEN post = c_mktsegment THEN s_suppkey END), min(CASE WHEN post = '' THEN s_suppkey END), min(s_suppkey)) AS rule FROM customer LEFT JOIN u ON c_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, CAST(CASE WHEN verified THEN rule % 6 ELSE 0 END AS INTEGER) AS years FROM r LEFT JOIN (SELECT s_suppkey, verified FROM u) ON s_suppkey = rule""")
def r7_age_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("s_suppkey") % 3
    s = table(spark, sf_dir, "supplier")
    rules = s.select(F.col("s_nationkey").alias("category"), F.when(by == 0, "").when(by == 1, "BUILDING").otherwise("MACHINERY").alias("post"), F.col("s_suppkey").alias("rule"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("category"), F.col("c_mktsegment").alias("post"))
    sure = s.select(F.col("s_suppkey").alias("rule"), (F.col("s_acctbal") > 2000).alias("verified"))
    met = J.most_specific(asked, rules).join(sure, "rule", "left")
    return met.select("c_custkey", F.when(F.col("verified"), F.col("rule") % 6).otherwise(0).cast("int").alias("years"))
